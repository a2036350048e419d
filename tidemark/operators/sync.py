"""One collection run over several sources: what failed, what came, what was new.

A source that fails is a row with its error, not the end of the run; its items are left out as
a whole. An optional source's failure makes the run ``partial``; one of a source that isn't
optional stops the run there (``failed``): sources before it, in the given order, are merged,
those after it are not. The counts are taken while the merged table is written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from . import classify as C
from .merge import upsert_notices
from .payloads import explode_items, field, payload_error

LEDGER = "run int, started_at timestamp, status string, message string, sources int, candidates long, inserted long"


@dataclass(frozen=True)
class Source:
    id: str
    optional: bool = True


def outcomes(landed: DataFrame, sources: Sequence[Source]) -> list[tuple[Source, str, str]]:
    """(source, state, error) in order; landed (source_id, payload, error): a source fails with
    the smallest error of a call or payload of its. One row a source comes to the driver."""
    error = F.coalesce(F.nullif("error", F.lit("")), payload_error(F.col("payload")))
    found = dict(landed.groupBy("source_id").agg(F.min(error)).collect())
    out, stopped = [], False
    for s in sources:
        wrong = found.get(s.id)
        out.append((s, "skipped" if stopped else "failed" if wrong else "ok", "" if stopped else wrong or ""))
        stopped |= bool(wrong) and not s.optional
    return out


def accepted(landed: DataFrame, sources: Sequence[str], terms: C.TierTerms) -> DataFrame:
    """Notices of these sources that the title rules keep, with their tier. ``arrival`` is the
    place of the call and of the item in it."""
    rows = explode_items(landed.filter(F.col("source_id").isin(*sources)).select("source_id", "pos", "payload"), "payload")
    names = {"external_id": ("id",), "title": ("title", "name"), "category": ("category",), "buyer": ("buyer",)}
    # inlined, so that the rules read columns and don't make the fields, the text or the tier again
    read = F.transform(F.array("item"), lambda v: F.struct(*[field(*of, item=v).alias(c) for c, of in names.items()]))
    n = rows.select("source_id", F.struct("pos", "item_pos").alias("arrival"), F.inline(F.filter(read, lambda x: (x["title"] != "") & (x["external_id"] != ""))))
    judged = F.transform(F.array(T.normalize_text(F.col("title"))), lambda text: F.struct(text.alias("__text"), C.tier_of_text(text, F.col("category"), F.col("buyer"), F.lit(""), terms).alias("tier")))
    kept = n.select("*", F.inline(judged)).filter(C.related_text(F.col("__text"), F.col("tier"), terms)).drop("__text")
    return kept.withColumns({"review_status": F.lit("new"), "tier_source": F.lit("automatic")})


def _observed(metrics: Observation) -> dict[str, int]:
    """Nothing where Spark found the observed rows empty and left their part of the plan out."""
    try:
        return metrics.get
    except Py4JJavaError:
        return {}


def run(landed: DataFrame, sources: Sequence[Source], current: DataFrame, to: str, ledger: str, number: int, terms: C.TierTerms, as_of: Column) -> DataFrame:
    """Merges a run's notices over ``current`` and writes the result to ``to``, with change
    (inserted, updated, kept); appends the run to the ledger. Returns the written table."""
    spark, candidates, written = current.sparkSession, Observation(), Observation()
    status, message, counts = "success", "", {}
    try:
        states = outcomes(landed, sources)
        failed = [(s, e) for s, state, e in states if state == "failed"]
        status = "failed" if any(not s.optional for s, _ in failed) else "partial" if failed else "success"
        message = "; ".join(f"{s.id}: {e}" for s, e in failed)
        came = accepted(landed, [s.id for s, state, _ in states if state == "ok"], terms).observe(candidates, F.count("*").alias("candidates"))
        merged = upsert_notices(current, came, as_of).observe(written, F.count_if(F.col("change") == "inserted").alias("inserted"))
        merged.write.parquet(to)
        counts = _observed(candidates) | _observed(written)
    except Exception as error:
        status, message = "failed", type(error).__name__
        raise
    finally:
        row = (number, status, message, len(sources), counts.get("candidates", 0), counts.get("inserted", 0))
        spark.createDataFrame([row], "run int, status string, message string, sources int, candidates long, inserted long") \
            .withColumn("started_at", as_of).select("run", "started_at", "status", "message", "sources", "candidates", "inserted").coalesce(1).write.mode("append").parquet(ledger)
    return spark.read.parquet(to)
