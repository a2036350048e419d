import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import merge as M
from tidemark.operators import payloads as P
from tidemark.plans import products


@pytest.fixture(scope="module")
def tables(spark):
    notices = spark.createDataFrame([("A-000", "A", "000", 1, "general"), ("A-001", "A", "001", 2, "general"), ("B-000", "B", "000", 3, "technical"), ("C-000", "C", "000", 4, "general"), ("D-0", "D", "0", 5, "general")], "record_id string, bid_notice_no string, bid_notice_order string, ord long, service_type string")
    win = "[1^co^77^-^1,000^87.5%^3^2024-01-02]"
    responses = spark.createDataFrame([
        ("A", "00", 1, win, "[1^c^n^a^d^m^500^2024-02-02] , [2^c^n^a^d^m^600^2024-02-03]", "R1"),  # order 00 is 000
        ("B", "0", 1, f"{win},[2^cut]", "[1^c^n^a^d^m^many^2024-02-02]", "R1"),
        ("C", "9", 1, win, "", "R2"),  # an order that C hasn't
        ("D", "0", 1, "[]", None, " - "),
    ], "bid_notice_no string, bid_notice_order string, contract_process_item_index long, bidwinr_info_list string, contract_info_list string, procurement_request_no string")
    answers = spark.createDataFrame([("general", "R1", "name", 9, None, None, 9, "o", "2024"), ("technical", "R1", "x", 1, 1, 1, 1, "o", "2024"), ("technical", "R1", "y", 1, 1, 1, 1, "o", "2024")], "source_operation string, procurement_request_no string, request_name string, budget_amount_krw long, representative_amount_krw long, total_service_budget_amount_krw long, current_budget_amount_krw long, order_agency string, input_date string")
    access = spark.createDataFrame([("1", "usable")], "service_id string, access_status string")
    return H.bundle(notices, responses, answers, access, lambda kind: kind)


def test_single_details_only(tables):
    rows = {r["record_id"]: r for r in tables["notices"].collect()}
    assert len(rows) == 5
    a = rows["A-000"]
    assert (a["winner_count"], a["winner_company"], a["award_amount_krw"], a["award_rate_pct"], a["participant_count"], a["award_data_status"]) == (1, "co", 1000, 87.5, 3, "collected: single")
    assert (a["contract_count"], a["contract_amount_krw"], a["contract_data_status"]) == (2, None, "several: 2")  # neither a sum nor the last
    assert (a["procurement_request_no"], a["procurement_request_name"], a["procurement_request_budget_amount_krw"]) == ("R1", "name", 9)
    b = rows["B-000"]
    assert (b["winner_count"], b["award_amount_krw"], b["award_data_status"]) == (None, None, "parse issue: see details")
    assert (b["contract_count"], b["contract_amount_krw"]) == (None, None)
    assert b["procurement_request_data_status"] == "several answers: 2" and b["procurement_request_name"] is None
    assert rows["A-001"]["award_data_status"] == "looked up: no item of this order" == rows["C-000"]["contract_data_status"]
    assert (rows["D-0"]["winner_count"], rows["D-0"]["award_data_status"], rows["D-0"]["procurement_request_data_status"]) == (0, "looked up: none", "looked up: none")


def test_details_stay(tables):
    awards = {(r["bid_notice_no"], r["item_index"]): r for r in tables["awards"].collect()}
    assert len(awards) == 4
    assert awards["B", 2]["parse_status"] == "expected 8, got 2" and awards["B", 2]["raw_entry"] == "[2^cut]" and awards["B", 2]["opening_date"] == ""
    assert awards["C", 1]["record_id"] == "" and awards["C", 1]["exact_order_match_yn"] == "N"
    assert awards["A", 1]["winner_ceo"] == ""
    contract = [r for r in tables["contracts"].collect() if r["bid_notice_no"] == "B"][0]
    assert (contract["parse_status"], contract["contract_amount_krw"], contract["contract_date"]) == ("invalid number: contract_amount_krw", None, "")
    assert {(r["source_operation"], r["procurement_request_no"], r["linked_record_ids"]) for r in tables["requests"].collect()} == {("general", "R1", "A-000"), ("technical", "R1", "B-000")}


def test_six_files(spark, tables, tmp_path):
    paths = H.write_files(tables, f"file://{tmp_path}")
    for name, fields in H.FILES.items():
        t = spark.read.csv(paths[name], header=True)
        assert t.columns == list(fields) or (name == "bidders" and not t.columns)
        assert t.count() == tables[name].count()


def test_empty_history(spark, tables):
    none = spark.createDataFrame([], "record_id string, bid_notice_no string, bid_notice_order string, ord long, service_type string")
    responses = spark.createDataFrame([], "bid_notice_no string, bid_notice_order string, contract_process_item_index long, bidwinr_info_list string, contract_info_list string, procurement_request_no string")
    answers = spark.createDataFrame([], "source_operation string, procurement_request_no string, request_name string, budget_amount_krw long, representative_amount_krw long, total_service_budget_amount_krw long, current_budget_amount_krw long, order_agency string, input_date string")
    out = H.bundle(none, responses, answers, tables["access"], lambda kind: kind)
    assert all(out[x].count() == 0 for x in ("notices", "awards", "contracts", "requests", "links"))


def test_backfill(spark):
    url = lambda n, to, name=None: {f"{P.SPEC_URL}{n}": to} | ({f"{P.SPEC_NAME}{n}": name} if name else {})
    raws = [(1, "g2b_a", json.dumps(url(1, "http://x/a?fileSeq=1", "Scope.HWP") | url(2, "http://x/a?fileSeq=1", "other.pdf") | url(3, "ftp://x/b"))), (2, "g2b_a", "{"), (3, "g2b_a", "[]"), (4, "g2b_a", None), (5, "board", json.dumps(url(1, "http://x/c"))), (6, "g2b_b", json.dumps(url(10, "https://x/z.zip")))]
    notices = spark.createDataFrame(raws, "id long, source_id string, raw_json string")
    stored = spark.createDataFrame([(1, 1, "scope.hwp", "http://old/a?fileSeq=1"), (1, 2, "scope.hwp", "http://old/b?fileSeq=1"), (2, 1, "kept", "http://k"), (2, 2, "kept", "http://k")], "notice_id long, id long, label string, url string")
    merged, counts = P.backfill(notices, stored, "g2b_")
    assert counts.first().asDict() == {"processed_notices": 5, "invalid_raw_json": 2, "with_explicit_attachments": 2, "without_explicit_attachments": 1, "added": 1, "updated": 1, "deduplicated": 1}
    rows = {(r["notice_id"], r["id"]): (r["label"], r["url"], r["change"]) for r in merged.collect()}
    assert rows[1, 1] == ("Scope.HWP", "http://x/a?fileSeq=1", "updated") and rows[6, 10] == ("attachment 10", "https://x/z.zip", "inserted")
    assert rows[2, 1][2] == rows[2, 2][2] == "kept" and len(rows) == 5


def test_items_and_insights(spark):
    items = spark.createDataFrame([('{"bidNtceNm":" ","bidNm":" t ","bidNo":7,"bidOrd":"01"}',), ('{"ntceNm":"u"}',), ('{"bidNo":1}',)], "j string").select(F.try_parse_json("j").alias("item"))
    found = {r["title"]: r for r in P.map_notice_items(items, F.lit("s")).collect()}
    assert set(found) == {"t", "u"} and found["t"]["external_id"] == "7-01" and len(found["u"]["external_id"]) == 16 and found["u"]["url"] == ""
    old = spark.createDataFrame([(1, "u", "text", None)], "notice_id long, document_url string, summary string, extracted_at timestamp")
    new = spark.createDataFrame([(1, "u", "first", 1), (1, "u", "", 2), (2, "u", "x", 1)], "notice_id long, document_url string, summary string, arrival int")
    assert {(r["notice_id"], r["summary"], r["change"]) for r in M.upsert_insights(old, new, F.lit("2024-01-01").cast("timestamp")).collect()} == {(1, "", "updated"), (2, "x", "inserted")}


def test_entries_and_numbers_are_read_once(spark):
    notices = spark.sql("select '1' as record_id, 'A' as bid_notice_no, '0' as bid_notice_order, 1L as ord")
    responses = spark.sql("select 'A' as bid_notice_no, '0' as bid_notice_order, 1L as contract_process_item_index, concat('[', id, '^a^-^-^5^6%^7^d]') as bidwinr_info_list from range(2)")
    plan = H.award_rows(responses, notices)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the list, and an entry in it


def test_stored_links_are_joined_once(spark):
    stored = spark.sql("select 1L as notice_id, id, 'a' as label, 'u' as url from values 5L, 6L as t(id)")
    out = M.upsert_attachments(stored, spark.sql("select 1L as notice_id, 9L as id, 'A' as label, 'v' as url"))
    assert sorted((r["id"], r["url"], r["change"]) for r in out.collect()) == [(5, "v", "updated"), (6, "u", "deduplicated")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_saved_answers_are_parsed_once(spark):
    rows = spark.sql("""select 1 as notice_id, '{"ntceSpecDocUrl1":"http://h/a","ntceSpecDocUrl10":"http://h/b"}' as raw from range(1)""")
    found = P.spec_links(rows, "raw")
    assert [(r["n"], r["url"], r["label"]) for r in found.orderBy("n").collect()] == [(1, "http://h/a", "attachment 1"), (10, "http://h/b", "attachment 10")]


def test_links_under_other_keys(spark):
    """Numbered pairs first, then every key with url in it whose link shows a document's extension."""
    raw = json.dumps({"zUrl": "http://h/z.zip", f"{P.SPEC_URL}1": "http://h/a.pdf?x=1", f"{P.SPEC_NAME}1": "Scope.HWP", "aURLs": " http://h/b.docx#p ", "url": "http://h/page", "fileUrl.hwp": "ftp://h/c.pdf", "link": "http://h/d.pdf", "urlAgain": "http://h/a.pdf?x=1", "x.pdf url": "http://h/e.xls", "url2": {"u": "http://h/f.pdf"}, "url3": None})
    answers = spark.createDataFrame([(1, "g2b_a", raw), (2, "g2b_a", "[1]"), (3, "g2b_a", "{"), (4, "board", raw), (5, "g2b_b", "")], "id long, source_id string, raw_json string")
    found = P.saved_links(answers, "g2b_").orderBy("id").collect()
    assert [(r["notice_id"], r["label"], r["url"], r["file_type"]) for r in found] == [(1, "Scope.HWP", "http://h/a.pdf?x=1", "hwp"), (1, "zUrl", "http://h/z.zip", "zip"), (1, "aURLs", "http://h/b.docx#p", "docx"), (1, "x.pdf url", "http://h/e.xls", "xls")]


def test_backfill_again_adds_nothing(spark):
    raw = json.dumps({f"{P.SPEC_URL}1": "http://h/a?fileSeq=1&t=2", f"{P.SPEC_NAME}1": "A.hwp", "docUrl": "http://h/b.pdf"})
    notices = spark.createDataFrame([(1, "g2b_a", raw), (2, "g2b_a", "{}")], "id long, source_id string, raw_json string")
    stored = spark.sql("select 1L as notice_id, 7L as id, 'a.hwp' as label, 'http://h/a?fileSeq=1' as url, '' as file_type union all select 2L, id, 'k', 'u', '' from values 1L, 2L as t(id)")
    merged, counts = P.backfill(notices, stored, "g2b_")
    assert {(r["notice_id"], r["id"], r["url"], r["file_type"], r["change"]) for r in merged.collect()} == {(1, 7, "http://h/a?fileSeq=1&t=2", "hwp", "updated"), (1, 12, "http://h/b.pdf", "pdf", "inserted"), (2, 1, "u", "", "kept"), (2, 2, "u", "", "kept")}
    again, more = P.backfill(notices, merged.select(*stored.columns), "g2b_")
    assert (counts.first()["added"], more.first()["added"], more.first()["updated"], again.count()) == (1, 0, 2, 4)


def test_backfill_query_reads_saved_answers(spark, sf, monkeypatch):
    """Without answers of the source nothing comes, and all that is stored stays."""
    answers = products._answers
    ids = answers(spark, sf).filter("source_id like 'g2b%'").agg(F.count("*"), F.count_distinct("id")).first()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").count()
    most = lines.agg(F.count("*"), F.sum(F.ceil(F.col("count") / P.SPEC_PAIRS)), F.sum(F.least("count", F.lit(4)))).first()
    assert (ids[1], ids[0]) == (most[0], most[1])  # links past the tenth stand in a further answer
    monkeypatch.setattr(products, "_answers", lambda s, d: answers(s, d).withColumn("source_id", F.lit("board")))
    assert [tuple(r) for r in products.QUERIES["i11_backfill_attachments"](spark, sf).collect()] == [("kept", most[2])]
