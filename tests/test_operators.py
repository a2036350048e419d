"""Cases that the fixtures don't have: blank values, ties, idempotence, malformed input."""

import io
import zipfile

from pyspark.sql import functions as F

from tidemark.functions import amounts, dates, text
from tidemark.operators import merge, payloads, quality, tables
from tidemark.sources import pages


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_deadline_labels(spark):
    got = [_one(spark, dates.deadline_label(F.lit(d).cast("int"))) for d in (None, -1, 0, 1, 3, 4, 7, 8)]
    assert got == ["", "", "D-DAY", "D-1", "D-3", "D-4", "D-7", ""]
    assert [_one(spark, dates.deadline_band(F.lit(x))) for x in ("D-DAY", "D-2", "D-5", "")] == ["deep-red", "red", "yellow", ""]


def test_application_window(spark):
    got = lambda s: tuple(_one(spark, dates.application_window(F.col("t")), t=s))
    assert got("접수기간: 2026.9.1 10:00 ~ 2026.9.30 16시까지") == ("2026-09-01 10:00", "2026-09-30 16:00")
    assert got("신청 기한 2026-10-02") == ("", "2026-10-02 23:59")
    assert got("기간 2026-10-02") == ("", "") and got(None) == ("", "")
    assert got("신청기간 2026-02-30 ~ 2026-03-01 25:00") == ("", "")


def test_terms(spark):
    norm = text.normalize_text(F.col("t"))
    assert _one(spark, text.contains_term(norm, "CDP"), t="CDPR report") is False
    assert _one(spark, text.contains_term(norm, "cdp"), t="a CDP  report") is True
    assert _one(spark, text.contains_term(norm, " "), t="x") is False
    assert _one(spark, text.signals(norm, ["b", "r&d", "a"]), t="a r&d b") == ["b", "r&d", "a"]


def test_amounts(spark):
    status = lambda s: tuple(_one(spark, amounts.amount_status(F.col("t"))["status"].alias("x"), t=s) for _ in "x")[0]
    assert [status(s) for s in ("", None, "₩1,000", "-2", "n/a", "NaN")] == ["blank", "blank", "ok", "negative", "invalid", "invalid"]
    assert _one(spark, amounts.int_or_missing(F.col("t")), t="0") == 0
    assert _one(spark, amounts.canonical_order(F.col("t")), t="000") == "0"


def test_packed_rows_keep_malformed(spark):
    df = spark.createDataFrame([(1, "[a^b] , [c]"), (2, "x"), (3, "-"), (4, None)], "id long, p string")
    got = {(r["id"], r["item_index"]): (r["u"], r["v"], r["parse_status"]) for r in tables.packed_rows(df, "p", ["u", "v"]).collect()}
    assert got == {(1, 1): ("a", "b", "ok"), (1, 2): ("", "", "expected 2, got 1"), (2, 1): ("", "", "not a list")}


def test_upsert_keeps_reviews_and_is_idempotent(spark):
    cols = "source_id string, external_id string, title string, review_status string, tier string, tier_source string"
    current = spark.createDataFrame([("s", "1", "old", "won", "tier_1", "manual"), ("s", "2", "x", "new", "tier_3", "automatic")], cols).withColumns({"first_seen": F.lit("2020-01-01").cast("timestamp"), "last_seen": F.lit("2020-01-01").cast("timestamp")})
    incoming = spark.createDataFrame([("s", "1", "fresh", "new", "tier_2", "automatic"), ("s", "3", "y", "new", "tier_2", "automatic")], cols)
    at = F.lit("2021-01-01").cast("timestamp")
    once = merge.upsert_notices(current, incoming, at)
    rows = {r["external_id"]: r for r in once.collect()}
    assert (rows["1"]["title"], rows["1"]["review_status"], rows["1"]["tier"], rows["1"]["change"]) == ("fresh", "won", "tier_1", "updated")
    assert rows["3"]["change"] == "inserted" and rows["2"]["change"] == "kept"
    twice = merge.upsert_notices(once.drop("change"), incoming, at)
    assert sorted(twice.drop("change").collect()) == sorted(once.drop("change").collect())


def test_amount_evidence_label_before_order(spark):
    rows = [(1, 0, "사업비 3,000원 ... 예산액 2억원"), (1, 1, "예산액: 금 5천만원"), (2, 0, "none")]
    got = tables.amount_evidence(spark.createDataFrame(rows, "d long, seq int, paragraph string"), "d").collect()
    assert [(r["d"], r["basis"], r["amount_text"], r["amount_krw"]) for r in got] == [(1, "예산액", "2억원", 200_000_000)]


def test_archive_paragraphs(spark):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("Contents/section0.xml", "<s xmlns='u'><p>a  b</p><p>a b</p><p/><p>c</p></s>")
    df = spark.createDataFrame([("x", bytearray(f.getvalue())), ("y", bytearray(b"broken"))], "path string, content binary")
    got = sorted((r["path"], r["seq"], r["paragraph"], r["status"]) for r in pages.archive_paragraphs(df).collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"  # whole files: few at a time
    assert got == [("x", 0, "a b", "ok"), ("x", 1, "c", "ok"), ("y", 0, None, "parse_failed")]


def test_schema_findings():
    assert quality.schema_findings(["a", "b", "a"], ["a", "c"]) == [("missing_column", "c"), ("duplicate_header", "a")]


def test_unnotified_every_recipient(spark):
    notices = spark.sql("select 1L as id, timestamp '2001-02-01' as first_seen, 3 as score, 'tier_1' as tier, 'new' as review_status")
    recipients = spark.range(1500).selectExpr("cast(id as string) as recipient")
    sent = spark.sql("select 'immediate' as type, 'sent' as status, '1' as key, '7' as recipient")
    out = tables.unnotified(notices, recipients, sent, F.lit("2001-01-01").cast("timestamp"), 2, ("tier_1",), ("closed",))
    assert out.select("recipient").distinct().count() == 1499


def test_every_row_for_every_recipient(spark, monkeypatch):
    monkeypatch.setattr(tables, "GRID_ROWS", 7)
    rows, recipients = spark.range(40).withColumn("x", F.lit("r")), spark.range(30).selectExpr("cast(id as string) as recipient")
    want = sorted((i, "r", str(k)) for i in range(40) for k in range(30))
    assert sorted(map(tuple, tables.for_each(rows, recipients).collect())) == want
    dealt = tables.for_each(rows, recipients, most=5)
    assert sorted(map(tuple, dealt.collect())) == want and "CartesianProduct" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_application_window_stays_small(spark):
    plan = spark.range(1).select(dates.application_window(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp") < 200  # the plan named its parts thousands of times


def test_items_are_read_once(spark):
    items = spark.sql("""select id, try_parse_json(j) as item from values (1, '{"bidNm":" a ","bidNtceNm":" ","bidNo":7}'), (2, '{"bidNm":" "}'), (3, 'x'), (4, '[1]') as t(id, j)""")
    found = payloads.map_notice_items(items, F.lit("s"))
    assert [(r["id"], r["title"], r["external_id"], r["url"]) for r in found.collect()] == [(1, "a", "7", "")]
    parsed = payloads.map_notice_items(spark.range(9).select("id", F.try_parse_json(F.concat(F.lit('{"bidNm":'), "id", F.lit("}"))).alias("item")), F.lit("s"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_amounts_and_days_that_need_no_cleaning(spark):
    """The short way says what the long one says, also where only one of them is taken."""
    texts = ["12", " 12.5 ", "0", "-3", "1,200", "₩5", "x", "", "  ", None, "1e3", "12.", ".5", "12\n", "1.1234567", "9" * 21, "9" * 40, "-", "٣"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.orderBy("i").select(amounts.amount_state(F.col("t")).alias("a"), amounts.amount_status(F.col("t")).alias("b"), amounts._cleaned(F.col("t")).alias("c")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(r["c"]["status"], r["c"]) for r in rows]
    assert [r["a"] for r in rows[:8]] == ["ok", "ok", "ok", "negative", "ok", "ok", "invalid", "blank"]
    days = {"2001-02-03": "2001-02-03 00:00:00", " 2001-02-03 ": "2001-02-03 00:00:00", "2001-02-30": None, "20010203": "2001-02-03 00:00:00", "": None, "x": None, "2001-02-03T10:11Z": "2001-02-03 10:11:00"}
    got = spark.createDataFrame([(t,) for t in days], "t string").select("t", dates.parse_data_ts(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == days


def test_findings_count_rows_of_keys_met_once(spark):
    """Keys are counted before the join and weigh as many rows; only bad amounts become rows."""
    details = spark.createDataFrame([("a",)] * 3 + [("b",)] * 4 + [(" ",), (None,), ("c",)], "record_id string")
    known = spark.createDataFrame([("b",), ("b",)], "record_id string")
    lost = quality.orphans(details, known, "record_id", "lost")
    assert [tuple(r) for r in lost.collect()] == [("lost", 4, "a,c")]
    requests = spark.createDataFrame([("1", "5", "-2"), ("2", "x", ""), ("3", None, "7")], "request_no string, a string, b string")
    out = quality.request_amounts(requests, ["a", "b"])
    assert sorted(tuple(r) for r in out.collect()) == [("invalid_procurement_request_amount", 1, "2:a"), ("negative_procurement_request_amount", 1, "1:b")]
    assert "array_compact" in out._jdf.queryExecution().analyzed().toString()
