"""The fatal gate, the summary record, the briefing and the public projection on small tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, briefing, gate, quality
from tidemark.sources import pages

NOTICE = "id long, source_id string, title string, url string, category string, deadline timestamp, deadline_at string, first_seen timestamp, score int, review_status string, tier string"


def test_headers_only(spark, tmp_path):
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text('﻿a,"b,c",d\n1,2,3\n', encoding="utf-8")
    (tmp_path / "many" / "b.csv").write_text("a,d\n" + "x,y\n" * 1000)
    (tmp_path / "many" / "_SUCCESS").write_text("")
    (tmp_path / "twice.csv").write_text("a,b,a,b,a\n")
    (tmp_path / "empty.csv").write_text("")
    paths = {n: f"{tmp_path}/{n}" for n in ("many", "twice.csv", "empty.csv", "absent")}
    found = gate.headers(spark, paths)
    assert sorted(found["many"].values()) == [["a", "b,c", "d"], ["a", "d"]] and list(found["empty.csv"].values()) == [[]] and found["absent"] == {}
    out = gate.fatal(spark, paths, {"many": ["a", "b,c"], "twice.csv": ["a"], "empty.csv": ["a"], "absent": ["a"]}, "2024-02-30", "2024-01-01")
    assert [tuple(r) for r in out.collect()] == [("absent", "missing_file", ""), ("empty.csv", "missing_header", ""), ("many", "missing_column", "b,c"), ("period", "invalid_date", "start"), ("twice.csv", "duplicate_header", "a"), ("twice.csv", "duplicate_header", "b")]
    assert gate.fatal(spark, paths, {"many": ["a", "d"]}, "2024-01-01", "2024-01-01").isEmpty()


def test_fatal_findings_stop_the_report(spark):
    def report():
        raise AssertionError("it must not run")

    bad = spark.createDataFrame([("t", "missing_column", "b"), ("t", "missing_column", "a")], gate.FINDING)
    assert [tuple(r) for r in gate.gated(bad, report).collect()] == [("t:missing_column", 2, "a,b")]
    assert gate.gated(bad.limit(0), lambda: "the report") == "the report"


def test_summary_record_counts_once(spark):
    base = {c: "" for c in ("bid_no", "close_date", "open_date", "notice_year", "budget", "participant_status", "participant_count", "award_status", "award_company", "contract_status", "contract_no", "request_status", "request_no", "request_name", "detail_value", "relevance_status", "categories")}
    rows = [base | {"record_id": r, "notice_date": "2024-01-01", "awards_count": n, "contracts_count": None} | x for r, n, x in (("a", 1, {"bid_no": "1", "categories": "x;y"}), ("a", 2, {"budget": "n/a", "detail_value": "v"}), ("", None, {"notice_date": "bad", "budget": "-1"}), ("b", 0, {"notice_date": "2030-01-01", "relevance_status": "core"}))]
    notices = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {'int' if c.endswith('s_count') else 'string'}" for c in rows[0]))
    details = spark.createDataFrame([("a", "ok"), ("a", "ok"), ("lost", "ok"), ("lost", "bad"), ("", "ok"), ("a", None)], "record_id string, parse_status string")
    requests = spark.createDataFrame([("a;lost",), (";",), (None,), ("gone",)], "links string")
    access = spark.createDataFrame([("collection_run", "done"), ("s", " ")], "service_id string, status string")
    got = quality.summary_record(notices, {"awards": details, "contracts": details.limit(0), "bidders": details.filter("record_id = 'lost'")}, requests, access, "2024-01-01", "2024-12-31", ["budget"], lambda d: d).first().asDict()
    want = {"notices": 4, "awards": 6, "contracts": 0, "bidders": 2, "procurement_requests": 4, "access_rows": 2, "duplicate_record_rows": 1, "blank_bid_notice_no": 3, "notice_date_outside_period": 1, "invalid_date_values": 1, "invalid_amount_values": 1, "negative_amount_values": 1,
            "award_detail_summary_mismatch": 1, "contract_detail_summary_mismatch": 0, "unsafe_multiple_summary": 1, "orphan_award_rows": 2, "orphan_contract_rows": 0, "orphan_bidder_rows": 2, "orphan_procurement_request_links": 2, "collection_run_status": "done",
            "relevance_status": '{"(blank)":3,"core":1}', "categories": '{"(blank)":3,"x":1,"y":1}', "access_status": '{"(blank)":1,"done":1}'}
    assert {k: got[k] for k in want} == want
    none = quality.summary_record(notices.limit(0), {"awards": details.limit(0), "contracts": details.limit(0), "bidders": details.limit(0)}, requests.limit(0), access.limit(0), "2024-01-01", "2024-12-31", ["budget"], lambda d: d).first().asDict()
    assert {none[k] for k in want if isinstance(want[k], int)} == {0} and none["collection_run_status"] == "unknown" and none["categories"] == "{}"


def _notices(spark):
    day = lambda d: f"2024-05-{d:02d} 12:00:00"
    row = lambda i, due, seen, score, status="new", tier="tier_1", source="s": (i, source, f"t{i}", "https://h.org/x", "bid", day(due) if due else None, day(due)[:16] if due else "", day(seen), score, status, tier)
    rows = [row(1, 12, 1, 3), row(2, 30, 10, 3), row(3, 30, 1, 5), row(4, 30, 1, 4, "watch"), row(5, 30, 1, 4), row(6, 12, 10, 9, "closed"), row(7, 9, 1, 9), row(8, 12, 1, 2), row(9, 12, 1, 9, tier="tier_3"), row(10, 12, 1, 9, source="SAMPLE_x"), row(11, None, 1, 4, "interesting", "tier_2"), row(12, 17, 10, 9, "watch", "tier_2")]
    as_time = "id, source_id, title, url, category, cast(deadline as timestamp) as deadline, deadline_at, cast(first_seen as timestamp) as first_seen, score, review_status, tier"
    return spark.createDataFrame(rows, NOTICE.replace("timestamp", "string")).selectExpr(*as_time.split(", ", 5)[:5], *as_time.split(", ")[5:])


def test_briefing(spark, tmp_path):
    at = F.lit("2024-05-10 10:00:00").cast("timestamp")
    flags = briefing.flagged(_notices(spark), spark.createDataFrame([(i,) for i in (1, 1, 2, 4, 5, 12)], "notice_id long"), at)
    assert briefing.counts(flags).first().asDict() == {"total_notices": 10, "eligible_notices": 7, "new_today": 2, "unreviewed": 4, "urgent": 2, "missing_documents": 2, "watching": 3, "tier_1": 5, "tier_2": 2}
    assert [r["id"] for r in briefing.action_queue(flags).collect()] == [1, 3, 4, 2, 12, 11]  # each once: 12 is due, new and watched
    found = {}
    for r in briefing.lists(flags, 2, f"{tmp_path}/due").orderBy("section", "place").collect():
        found.setdefault(r["section"], []).append((r["place"], r["id"]))
    assert found == {"action_queue": [(1, 1), (2, 3)], "new_today": [(1, 12), (2, 2)], "urgent": [(1, 12), (2, 1)], "missing_documents": [(1, 3), (2, 11)], "deadline_priority": [(1, 12), (2, 1)]}
    assert briefing.lists(flags.limit(0), 2, f"{tmp_path}/none").count() == 0


def test_public_projection_keeps_inner_data_inside(spark):
    link, insight = "struct<label:string,url:string,file_type:string,id:int>", "struct<document_url:string,document_label:string,status:string,summary:string,cache_path:string>"
    w = spark.createDataFrame([
        (1, "s", "https://h.org/1", "won", [("RFP 제안요청서", "https://h.org/a", "hwpx", 1), (None, "https://h.org/b", None, 2), ("x", "ftp://h/c", "pdf", 3), ("x", "", "pdf", 4)],
         [("https://h.org/a", "b", "extracted", "two", "/in"), ("https://h.org/b", "제안요청서", "extracted", "one", "/in"), ("/local", "제안요청서", "extracted", "hidden", "/in"), ("https://h.org/c", None, None, None, "/in")]),
        (2, "s", "https://h.org/2", "new", [("x", "/local", "pdf", 1)], [("file:///x", "l", "extracted", "t", "/in")]), (3, "s", "https://h.org/3", "new", None, [("https://h.org/d", "l", "extracted", " ", "/in")]),
        (4, "sample_s", "https://h.org/4", "new", None, None), (5, "s", "https://example.com/5", "new", None, None), (6, "s", None, "new", None, None)], f"id int, source_id string, url string, review_status string, attachments array<{link}>, insights array<{insight}>")
    out = briefing.public_notices(w, ["id", "url"])
    assert "review_status" not in out.columns and "cache_path" not in out.schema.simpleString() and "id:int,label" not in out.schema.simpleString()
    rows = {r["id"]: r for r in out.collect()}
    assert {i: r["document_status"] for i, r in rows.items()} == {1: "extracted", 2: "not_attempted", 3: "fallback_notice_info", 6: "not_attempted"}
    assert [tuple(x) for x in rows[1]["attachments"]] == [("RFP 제안요청서", "https://h.org/a", "hwpx"), ("document", "https://h.org/b", "")]
    assert rows[1]["primary"]["summary"] == "one" and rows[2]["primary"] is None and tuple(rows[1]["insights"][2]) == ("https://h.org/c", "document", "not_attempted", "")


@pytest.mark.parametrize("note", ["look", ""])
def test_quarantine_leaves_the_rest(spark, note):
    n = spark.createDataFrame([(1, "a", "new", "x"), (2, "a", "won", "x"), (3, "b", "new", "x"), (4, "a", "new", "x")], "id int, source_id string, review_status string, review_note string")
    policy = F.when(F.col("id") == 4, "strong").otherwise("ignore")
    out = audits.quarantine(n, policy, note, F.col("source_id") == "a")
    assert sorted(map(tuple, out.collect())) == [(1, "a", "needs_review", note), (2, "a", "won", "x"), (3, "b", "new", "x"), (4, "a", "new", "x")] and out.columns == n.columns


def test_header_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n" + "1,2\n" * 2000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        first = gate.first_line(spark, str(tmp_path / "long.csv"))
        assert [r["value"] for r in first.collect()] == ["a,b"] and "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
        assert gate.headers(spark, {"t": str(tmp_path)}) == {"t": {f"file:{tmp_path}/long.csv": ["a", "b"]}}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_files_are_small_and_whole(spark, tmp_path):
    rows = spark.range(20000).selectExpr("id", "concat('said \"no\", then ', id % 3) as note", "if(id % 2 = 0, '', '값') as empty")
    paths = {c: f"{tmp_path}/{c}" for c in ("gzip", "none")}
    pages.write_csv(rows, paths["gzip"], ["note", "id", "empty"])
    pages.write_csv(rows, paths["none"], ["note", "id", "empty"], compression="none")
    size = {c: sum(f.stat().st_size for f in (tmp_path / c).glob("part-*")) for c in paths}
    assert 5 * size["gzip"] < size["none"]
    for path in paths.values():
        back = spark.read.csv(path, header=True, escape="\\").fillna("")
        assert back.columns == ["note", "id", "empty"] and sorted(map(tuple, back.selectExpr("int(id)", "note", "empty").collect())) == sorted(map(tuple, rows.collect()))
        assert list(gate.headers(spark, {"t": path})["t"].values())[0] == ["note", "id", "empty"]
