"""Payload shapes, and runs in which sources fail."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import payloads, sync
from tidemark.operators.classify import TierTerms, tier_cascade, tier_of_text

TERMS = TierTerms(domain_1=("carbon",), work_1=("report",), topic=("carbon",))
STORED = "source_id string, external_id string, title string, category string, buyer string, review_status string, tier_source string, tier string, first_seen timestamp, last_seen timestamp"
LANDED = "source_id string, pos long, payload string, error string"


@pytest.mark.parametrize(("payload", "want"), [
    ('{"response":{"body":{"items":[{"a":1},{"a":2},3,"x",null,[{"a":9}]]}}}', ["1", "2"]), ('{"response":{"body":{"items":{"item":[{"a":1}]}}}}', ["1"]), ('{"response":{"body":{"items":{"item":{"a":1}}}}}', ["1"]),
    ('{"response":{"body":{"items":{"a":1}}}}', ["1"]), ('{"response":{"body":{"items":{"item":null}}}}', []), ('{"response":{"body":{"items":{"item":"x","a":1}}}}', []), ('{"response":{"body":{"items":"x"}}}', []),
    ('{"response":{"body":{}}}', []), ('{"response":null}', []), ("[1,2]", []), ("{broken", []), ("", []), (None, []),
])
def test_payload_shapes(spark, payload, want):
    df = payloads.explode_items(spark.createDataFrame([(7, payload)], "id int, payload string"), "payload")
    assert [(r["id"], r["a"]) for r in df.select("id", payloads.field("none", "a").alias("a")).collect()] == [(7, x) for x in want]


def test_payload_errors(spark):
    texts = ["{}", "x", "[1]", '{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{"returnReasonCode":"22"}}}', '{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{}}}', '{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{"x":1}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(payloads.payload_error(F.col("t"))).collect()] == [None, "not JSON", "not an object", "service error 22", None, "service error unknown"]


def _item(*items):
    return '{"response":{"body":{"items":[' + ",".join(f'{{"id":"{i}","title":"{t}"}}' for i, t in items) + "]}}}"


def _run(spark, at, landed, sources, number=1):
    day = F.lit("2024-01-02").cast("timestamp")
    stored = spark.sql("select 'b' as source_id, '1' as external_id, 'old' as title, '' as category, '' as buyer, 'won' as review_status, 'automatic' as tier_source, 'tier_3' as tier, timestamp '2024-01-01' as first_seen, timestamp '2024-01-01' as last_seen")
    out = sync.run(spark.createDataFrame(landed, LANDED), sources, stored, f"{at}/merged-{number}", f"{at}/ledger", number, TERMS, day)
    rows = {(r["source_id"], r["external_id"]): (r["title"], r["review_status"], r["tier"], r["change"]) for r in out.collect()}
    line = spark.read.parquet(f"{at}/ledger").filter(F.col("run") == number).collect()
    return rows, [(r["status"], r["message"], r["sources"], r["candidates"], r["inserted"]) for r in line]


def test_a_failing_source_does_not_stop_the_others(spark, tmp_path):
    good = [("b", 0, _item(("1", "carbon report"), ("2", "carbon"), ("3", "nothing"), ("", "carbon report"), ("4", " ")), ""), ("b", 1, _item(("2", "carbon report again")), ""), ("c", 0, _item(("1", "carbon report")), None), ("other", 0, "broken", "")]
    bad = [("a", 0, _item(("1", "carbon report")), ""), ("a", 1, None, "OSError"), ("a", 2, "{cut", "")]
    stored = {("b", "1"): ("carbon report", "won", "tier_1", "updated"), ("b", "2"): ("carbon report again", "new", "tier_1", "inserted"), ("c", "1"): ("carbon report", "new", "tier_1", "inserted")}
    sources = [sync.Source("a"), sync.Source("b"), sync.Source("c", optional=False), sync.Source("silent")]
    assert _run(spark, tmp_path, good + bad, sources) == (stored, [("partial", "a: OSError", 4, 4, 2)])
    assert _run(spark, tmp_path, good, sources, 2) == (stored, [("success", "", 4, 4, 2)])
    fatal = [sync.Source("b"), sync.Source("a", optional=False), sync.Source("c")]  # c comes after the stop
    rows, ledger = _run(spark, tmp_path, good + bad, fatal, 3)
    assert ledger == [("failed", "a: OSError", 3, 3, 1)] and ("c", "1") not in rows and ("b", "2") in rows
    none = _run(spark, tmp_path, [], sources, 4)
    assert none == ({("b", "1"): ("old", "won", "tier_3", "kept")}, [("success", "", 4, 0, 0)])
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 4


def test_a_run_that_breaks_is_in_the_ledger(spark, tmp_path):
    (tmp_path / "merged-1").mkdir()  # the table can't be written there
    with pytest.raises(Exception, match="already exists"):
        _run(spark, tmp_path, [("b", 0, _item(("1", "carbon report")), "")], [sync.Source("b")])
    line = spark.read.parquet(f"{tmp_path}/ledger").collect()[0]
    assert (line["status"], line["message"], line["candidates"]) == ("failed", "AnalysisException", 0)


def test_the_rules_are_evaluated_once(spark):
    terms = TierTerms(domain_1=("carbon",), work_1=("report",), topic=("carbon",), science_only=("onlyonce",))
    landed = spark.createDataFrame([("b", 0, _item(("1", "Carbon  Report")), "")], LANDED)
    plan = sync.accepted(landed, ["b"], terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("onlyonce") == 1
    for made in (payloads.items(F.col("payload")), payloads.payload_error(F.col("payload"))):
        plan = landed.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"parse_?json", plan, re.I)) == 1


def test_tier_of_a_normalised_text(spark):
    terms = TierTerms(domain_1=("carbon",), work_1=("report",), topic=("carbon",), non_consulting=("bus",), science_only=("lab",))
    rows = [(t, c) for t in (None, "", " Carbon\tREPORT ", "carbon lab report", "carbon bus", "nothing", "carbon") for c in ("grant_application", "g2b_service", "", None)]
    df = spark.createDataFrame(rows, "title string, category string")
    none = F.lit("")
    whole = tier_cascade(F.col("title"), F.col("category"), none, none, terms)["tier"]
    alone = tier_of_text(T.normalize_text(F.col("title")), F.col("category"), none, none, terms)
    assert df.filter(~whole.eqNullSafe(alone)).count() == 0 and df.select(whole.alias("t")).distinct().count() > 1
