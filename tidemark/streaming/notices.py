"""Structured Streaming: ingest, first seen, alerts, digests, revisions; state is keyed.

Alerts and digests go out through a ledger, a keyed table of (type, key, recipient): what is in
it was sent. A batch's rows and its ledger entries are merged under the batch's own tag, so a
batch that comes again, or a stream started anew from the beginning, sends nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dates
from ..operators import merge
from .keyed import KeyedTable, batch_tag, only_new

LEDGER = ("type", "key", "recipient")
CLOSED = ("not_relevant", "closed", "needs_review")


def files(spark: SparkSession, folder: str, schema, glob: str | None = None, per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def each_batch(stream: DataFrame, checkpoint: str, do: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Runs ``do(batch, tag)`` for every batch of what is there."""
    return stream.writeStream.foreachBatch(lambda batch, number: do(batch, batch_tag(batch, number))) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, table: KeyedTable, checkpoint: str, as_of: Column, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch is merged into the table: source fields are overwritten, reviews stay. A
    column ``arrival``, where the stream has one, tells which row of a key counts in a batch."""
    def store(batch: DataFrame, tag: str) -> None:
        rows = prepare(batch)
        incoming = merge.last_by(rows, table.keys, F.col("arrival")).drop("arrival") if "arrival" in rows.columns else rows.dropDuplicates(table.keys)

        def upsert(current: DataFrame | None, rows: DataFrame) -> DataFrame:
            if current is None:
                return rows.withColumns({"first_seen": as_of, "last_seen": as_of})
            return merge.upsert_notices(current, rows, as_of).drop("change")

        table.merge(tag, incoming, upsert)

    return each_batch(stream, checkpoint, store)


def first_seen(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def alertable(rows: DataFrame, baseline: Column, tiers: Sequence[str] = ("tier_1",), least: int = 0) -> DataFrame:
    """rows (ts, key, recipient, tier, score, review_status, source_id, published_at) that call
    for an alert: first seen after the baseline, of a tier and score, open, not of a sample, and
    not published before the baseline."""
    sample = F.lower(F.coalesce("source_id", F.lit(""))).startswith("sample_")
    return rows.filter((F.col("ts") > baseline) & F.col("tier").isin(*tiers) & (F.col("score") >= least) & ~F.col("review_status").isin(*CLOSED) & ~sample & dates.not_historical(F.col("published_at"), baseline))


def sent(rows: DataFrame, kind: str, at: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), F.col("key").cast("string").alias("key"), F.col("recipient").cast("string").alias("recipient"), F.lit("sent").alias("status"), at.alias("sent_at"))


def alerts(stream: DataFrame, ledger: KeyedTable, checkpoint: str, baseline: Column, tiers: Sequence[str] = ("tier_1",), least: int = 0, watermark: str = "2 days") -> StreamingQuery:
    """Each notice once to each recipient: repeats within the watermark go in the stream's state,
    those of earlier runs by the ledger, into which a batch's alerts are merged as they go out."""
    once = alertable(stream, baseline, tiers, least).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key", "recipient"])
    return each_batch(once, checkpoint, lambda batch, tag: ledger.merge(tag, sent(batch, "immediate", F.col("ts")), only_new(LEDGER)) and None)


def periods(ts: Column, slots: Sequence[str] = ("10:00", "17:00")) -> Column:
    """The digests that a row belongs to, (type, key, due): the next of the day's slots, keyed
    yyyy-MM-dd-HHmm, and the ISO week, keyed yyyy-Www and due when it ends."""
    day, week = F.date_trunc("day", ts), F.date_trunc("week", ts)
    times = [F.make_dt_interval(hours=F.lit(int(s[:2])), mins=F.lit(int(s[3:]))) for s in sorted(slots)]
    due = F.coalesce(*[F.when(ts <= day + t, day + t) for t in times], day + F.expr("interval 1 day") + times[0])
    year_week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return F.array(F.struct(F.lit("daily").alias("type"), F.date_format(due, "yyyy-MM-dd-HHmm").alias("key"), due.alias("due")),
                   F.struct(F.lit("weekly").alias("type"), year_week.alias("key"), (week + F.expr("interval 7 days")).alias("due")))


def digests(stream: DataFrame, counts: KeyedTable, ledger: KeyedTable, checkpoint: str, recipients: Sequence[str], slots: Sequence[str] = ("10:00", "17:00"), delay: str = "0 hours") -> StreamingQuery:
    """Digests of tier 1 and 2 rows (ts, tier), each once to each recipient, when the newest row
    seen lies ``delay`` after the end of its period. counts, keyed (type, key), holds the numbers
    of the periods so far, and the clock; rows that come after a digest went out still count
    there, but it isn't sent again."""
    def add(current: DataFrame | None, rows: DataFrame) -> DataFrame:
        both = rows if current is None else current.unionByName(rows)
        return both.groupBy("type", "key").agg(F.sum("tier_1").alias("tier_1"), F.sum("tier_2").alias("tier_2"), F.max("due").alias("due"))

    def send(batch: DataFrame, tag: str) -> None:
        rows = batch.select("ts", "tier", F.explode(periods(F.col("ts"), slots)).alias("p")).select("p.*", "tier", "ts")
        number = lambda t: F.count_if(F.col("tier") == t)
        found = rows.filter(F.col("tier").isin("tier_1", "tier_2")).groupBy("type", "key").agg(number("tier_1").alias("tier_1"), number("tier_2").alias("tier_2"), F.max("due").alias("due"))
        clock = batch.agg(F.max("ts").alias("due")).filter("due is not null").select(F.lit("clock").alias("type"), F.lit("now").alias("key"), F.lit(0).cast("long").alias("tier_1"), F.lit(0).cast("long").alias("tier_2"), "due")
        counts.merge(tag, found.unionByName(clock), add)
        held = counts.read()
        if held is None:
            return
        now = held.filter("type = 'clock'").agg(F.max("due")).first()[0]
        due = held.filter((F.col("type") != "clock") & (F.col("due") <= F.lit(now) - F.expr(f"interval {delay}")))
        out = due.withColumn("recipient", F.explode(F.array(*map(F.lit, recipients)))).select("type", "key", "recipient", F.lit("sent").alias("status"), F.col("due").alias("sent_at"), "tier_1", "tier_2")
        ledger.merge(tag, out, only_new(LEDGER))

    return each_batch(stream, checkpoint, send)


def latest_revision(stream: DataFrame, key: str, ts: str, ordinal: str) -> DataFrame:
    """Greatest stamp; ties keep the first arrival."""
    return stream.groupBy(key).agg(F.max_by(ordinal, F.struct(F.col(ts), -F.col(ordinal))).alias("kept"))


def late_policy(stream: DataFrame, stored: KeyedTable, ledger: KeyedTable, checkpoint: str, baseline: Column) -> StreamingQuery:
    """One stream into two sinks: every row (ts, key, recipient, ...) is stored, with ``alert``
    false if it lies before the baseline; only the others are sent. Both sinks are merged under the
    batch's tag, so that they agree after a batch was cut off between them and came again."""
    def both(batch: DataFrame, tag: str) -> None:
        rows = batch.withColumn("alert", F.coalesce(F.col("ts") >= baseline, F.lit(False)))
        stored.merge(tag, rows, only_new(stored.keys))
        ledger.merge(tag, sent(rows.filter("alert"), "immediate", F.col("ts")), only_new(LEDGER))

    return each_batch(stream, checkpoint, both)


def drained(df: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and reads the result back. A complete-mode result
    is overwritten by each batch."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")
