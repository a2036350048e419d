"""Restarts, replays and cut-off batches: nothing is stored or sent twice, nothing is lost."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.streaming import notices as S
from tidemark.streaming.keyed import KeyedTable, only_new

ROW = "ts timestamp, key long, recipient string, tier string, score int, review_status string, source_id string, published_at string"
BASE = lambda: F.lit("2024-01-10 00:00:00").cast("timestamp")


def _row(key, ts, tier="tier_1", published="", status="new", source="board", recipient="r", score=5):
    return (dt.datetime.fromisoformat(ts), key, recipient, tier, score, status, source, published)


def _land(spark, folder, name, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _stream(spark, folder):
    return S.files(spark, f"{folder}/*", spark.createDataFrame([], ROW).schema, per_trigger=1)


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=32)
    big = spark.range(20000).withColumn("v", F.sha1(F.col("id").cast("string")))
    assert table.merge("a", big, only_new(["id"]))
    sizes = [_size(f"{tmp_path}/t/data/__version=0")]
    for n, ids in enumerate(([20001], [20002, 20003]), 1):
        assert table.merge(f"b{n}", spark.createDataFrame([(i, "x") for i in ids], "id long, v string"), only_new(["id"]))
        sizes.append(_size(f"{tmp_path}/t/data/__version={n}"))
        assert len(os.listdir(f"{tmp_path}/t/data/__version={n}")) <= len(ids) + 2  # buckets, and Spark's marker with its checksum
    assert sizes[1] < sizes[0] / 16 and sizes[2] < sizes[0] / 8
    assert table.read().count() == 20003 and table.versions() == [1, 2] and table.read(1).count() == 20001
    table.merge("all", big.withColumn("id", F.col("id") + 50000), only_new(["id"]))
    table.merge("more", spark.createDataFrame([(90000, "x")], "id long, v string"), only_new(["id"]))
    assert table.read().count() == 40004 and not [f for f in os.listdir(f"{tmp_path}/t/data/__version=0") if f.startswith("__bucket")]  # nothing names them any more


def test_replay_and_cut_off_versions(spark, tmp_path):
    table, rows = KeyedTable(spark, f"{tmp_path}/t", ["id"], 4), spark.range(10)
    assert table.read() is None and table.merge("q:0", rows, only_new(["id"])) and not table.merge("q:0", spark.range(99), only_new(["id"]))
    assert table.merge("q:1", spark.range(5, 30), only_new(["id"]))
    os.remove(f"{tmp_path}/t/versions/1/_SUCCESS")  # as if it was lost before the commit
    again = KeyedTable(spark, f"{tmp_path}/t", ["id"], 4)
    assert again.read().count() == 10
    assert again.merge("q:1", spark.range(5, 30), only_new(["id"])) and again.read().count() == 30
    assert again.merge("q:2", rows.limit(0), only_new(["id"])) and again.read().count() == 30 and not again.merge("q:2", rows, only_new(["id"]))
    none = KeyedTable(spark, f"{tmp_path}/none", ["id"], 4)
    assert none.merge("q:0", rows.limit(0), only_new(["id"])) and none.read() is None and not none.merge("q:0", rows, only_new(["id"]))


def test_ingest_in_two_runs(spark, tmp_path):
    cols = "source_id string, external_id string, title string, review_status string, tier string, tier_source string, arrival int"
    schema = spark.createDataFrame([], cols).schema
    table = KeyedTable(spark, f"{tmp_path}/t", ["source_id", "external_id"], 4)

    def land(name, rows):
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run(at):
        S.ingest(S.files(spark, f"{tmp_path}/in/*", schema), table, f"{tmp_path}/state", F.lit(at).cast("timestamp")).awaitTermination()
        return {r["external_id"]: (r["title"], r["review_status"], str(r["first_seen"])[:10], str(r["last_seen"])[:10]) for r in table.read().collect()}

    land("a", [("s", "1", "old", "won", "tier_1", "manual", 1), ("s", "1", "older", "new", "tier_1", "manual", 0), ("s", "2", "x", "new", "tier_3", "automatic", 1)])
    assert run("2024-01-01") == {"1": ("old", "won", "2024-01-01", "2024-01-01"), "2": ("x", "new", "2024-01-01", "2024-01-01")}
    land("b", [("s", "1", "second", "new", "tier_2", "automatic", 2), ("s", "1", "fresh", "new", "tier_2", "automatic", 3), ("s", "3", "y", "new", "tier_2", "automatic", 1)])
    want = {"1": ("fresh", "won", "2024-01-01", "2024-01-02"), "2": ("x", "new", "2024-01-01", "2024-01-01"), "3": ("y", "new", "2024-01-02", "2024-01-02")}
    assert run("2024-01-02") == want and run("2024-01-03") == want  # nothing new: nothing changes


def _alert_rows():
    return [_row(1, "2024-01-11 08:00:00"), _row(1, "2024-01-11 09:00:00"), _row(2, "2024-01-09 08:00:00"), _row(3, "2024-01-11 08:00:00", "tier_2"), _row(4, "2024-01-12 08:00:00", published="20240109"), _row(5, "2024-01-12 08:00:00", published="20240110"),
            _row(6, "2024-01-12 08:00:00", published="2024-01-09 23:59:59"), _row(7, "2024-01-12 09:00:00", status="closed"), _row(8, "2024-01-12 09:00:00", source="Sample_board"), _row(9, "2024-01-12 09:00:00", score=0), _row(10, "2024-01-12 10:00:00", published="soon")]


def _alerts(spark, at, state):
    ledger = KeyedTable(spark, f"{at}/ledger", S.LEDGER, 4)
    S.alerts(_stream(spark, f"{at}/in"), ledger, f"{at}/{state}", BASE(), least=1).awaitTermination()
    return sorted((int(r["key"]), r["recipient"], r["type"], r["status"]) for r in ledger.read().collect())


@pytest.mark.parametrize("states", [("one", "one"), ("one", "two")], ids=["same checkpoint", "new checkpoint"])
def test_alerts_once_across_restarts(spark, tmp_path, states):
    _land(spark, f"{tmp_path}/in", "a", _alert_rows())
    want = [(k, "r", "immediate", "sent") for k in (1, 5, 10)]
    assert _alerts(spark, tmp_path, states[0]) == want
    _land(spark, f"{tmp_path}/in", "b", [_row(1, "2024-01-20 08:00:00"), _row(5, "2024-01-12 08:00:00", recipient="q"), _row(11, "2024-01-20 08:00:00")])
    found = _alerts(spark, tmp_path, states[1])
    assert [x for x in found if x[1] == "r"] == sorted([*want, (11, "r", "immediate", "sent")])


def _digests(spark, at, state, delay="0 hours"):
    ledger = KeyedTable(spark, f"{at}/ledger", S.LEDGER, 4)
    S.digests(_stream(spark, f"{at}/in"), KeyedTable(spark, f"{at}/counts", ["type", "key"], 2), ledger, f"{at}/{state}", ("a", "b"), delay=delay).awaitTermination()
    held = ledger.read()
    return sorted((r["type"], r["key"], r["recipient"], r["tier_1"], r["tier_2"]) for r in held.collect()) if held else []


def test_digests_once_across_restarts(spark, tmp_path):
    both = lambda *x: [(*x[:2], r, *x[2:]) for r in "ab"]
    _land(spark, f"{tmp_path}/in", "a", [_row(1, "2024-12-29 09:00:00"), _row(2, "2024-12-29 10:00:00", "tier_2"), _row(3, "2024-12-29 10:00:01"), _row(4, "2024-12-29 16:59:00", "tier_3")])
    first = both("daily", "2024-12-29-1000", 1, 1)
    assert _digests(spark, tmp_path, "s") == first and _digests(spark, tmp_path, "s") == first
    _land(spark, f"{tmp_path}/in", "b", [_row(5, "2024-12-29 18:00:00"), _row(6, "2024-12-30 10:30:00")])
    second = sorted(first + both("daily", "2024-12-29-1700", 1, 0) + both("daily", "2024-12-30-1000", 1, 0) + both("weekly", "2024-W52", 3, 1))
    assert _digests(spark, tmp_path, "s") == second
    _land(spark, f"{tmp_path}/in", "c", [_row(7, "2024-12-29 09:30:00"), _row(8, "2024-12-31 12:00:00")])  # 7 is late
    assert _digests(spark, tmp_path, "s") == sorted(second + both("daily", "2024-12-30-1700", 1, 0))
    counts = {(r["type"], r["key"]): r["tier_1"] for r in KeyedTable(spark, f"{tmp_path}/counts", ["type", "key"], 2).read().collect()}
    assert counts["daily", "2024-12-29-1000"] == 2 and counts["weekly", "2025-W01"] == 2


def test_two_sinks_agree_after_a_cut(spark, tmp_path):
    _land(spark, f"{tmp_path}/in", "a", [_row(1, "2024-01-09 08:00:00"), _row(2, "2024-01-11 08:00:00")])
    stored, ledger = KeyedTable(spark, f"{tmp_path}/stored", ["key"], 4), KeyedTable(spark, f"{tmp_path}/ledger", S.LEDGER, 4)
    run = lambda to: S.late_policy(_stream(spark, f"{tmp_path}/in"), stored, to, f"{tmp_path}/state", BASE()).awaitTermination()

    class Broken:
        def merge(self, *_):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(Broken())
    assert stored.read().count() == 2 and ledger.read() is None
    run(ledger)
    _land(spark, f"{tmp_path}/in", "b", [_row(3, "2024-01-12 08:00:00"), _row(4, "2024-01-01 08:00:00"), _row(2, "2024-01-11 08:00:00")])
    run(ledger)
    assert {r["key"]: r["alert"] for r in stored.read().collect()} == {1: False, 2: True, 3: True, 4: False}
    assert sorted(r["key"] for r in ledger.read().collect()) == ["2", "3"]


def test_repeated_keys_in_a_patch(spark):
    notices = spark.createDataFrame([(1, "s", "1", "new", "tier_3", "automatic", "old", "r"), (2, "s", "2", "new", "tier_3", "automatic", "old", "r")], "id long, source_id string, external_id string, review_status string, tier string, tier_source string, review_note string, tier_reason string")
    at = F.lit("2024-01-01").cast("timestamp")
    patch = spark.createDataFrame([(1, "won", "a", 2), (1, "lost", "b", 1), (1, "lost", "c", 0)], "id long, review_status string, note string, arrival int")
    out = {r["id"]: (r["review_status"], r["review_note"], r["reviewed_at"] is not None) for r in merge.set_review(notices.withColumn("reviewed_at", F.lit(None).cast("timestamp")), patch, at).collect()}
    assert out == {1: ("won", "a", True), 2: ("new", "old", False)} and merge.set_review(notices, patch).count() == 2
    tiers = spark.createDataFrame([(1, "tier_1", "x", 1), (1, "tier_2", " y ", 2), (1, "tier_3", " ", 3), (2, "tier_1", None, 1)], "id long, tier string, reason string, arrival int")
    assert sorted((r["id"], r["tier"], r["tier_source"], r["tier_reason"]) for r in merge.set_tier(notices, tiers).collect()) == [(1, "tier_2", "manual", "y"), (2, "tier_3", "automatic", "r")]
    fits = spark.createDataFrame([(1, "low", None, 1), (1, "high", None, 2), (1, "bad", None, 3), (9, "low", None, 1)], "notice_id long, fit string, decision string, arrival int")
    table, rejected = merge.upsert_fit_review(fits.limit(0).drop("arrival"), fits, notices, {"fit": "none", "decision": "pending"}, {"fit": ("low", "high")})
    assert [tuple(r) for r in table.collect()] == [(1, "high", "pending")] and sorted((r["notice_id"], r["fit"]) for r in rejected.collect()) == [(1, "bad"), (9, "low")]
    stored = notices.withColumns({"first_seen": at, "last_seen": at, "title": F.lit("t")})
    incoming = stored.drop("first_seen", "last_seen").unionByName(stored.drop("first_seen", "last_seen").withColumn("title", F.lit("u")))
    merged = merge.upsert_notices(stored, incoming, at).collect()
    assert sorted((r["id"], r["title"]) for r in merged) == [(1, "u"), (2, "u")]
