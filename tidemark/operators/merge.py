"""Keyed maintenance: pure functions of the current table and what comes in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .tables import first_by


def last_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the last in the order: two rows of a key must not multiply what they join."""
    return first_by(df, keys, *[x.desc() for x in order])


def _one_each(patch: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the last by ``arrival`` if there is that column, else by all values."""
    order = [F.col("arrival")] if "arrival" in patch.columns else []
    return last_by(patch, keys, *order, *[F.col(c) for c in patch.columns if c not in (*keys, "arrival")]).drop("arrival")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Mapping[str, Column] | None = None) -> DataFrame:
    """All of incoming over current by key, one full outer join. ``keep`` has, for a column, the
    condition (on c.* and n.*) under which the stored value stays."""
    keep, on = keep or {}, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    c, n = current.withColumn("__c", F.lit(True)).alias("c"), incoming.withColumn("__n", F.lit(True)).alias("n")
    stored, came = F.col("c.__c").isNotNull(), F.col("n.__n").isNotNull()
    j = c.join(n, on, "full_outer")
    out = [F.when(came & (~stored | ~keep.get(x, F.lit(False))), F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in current.columns]
    return j.select(*out, F.when(~stored, "inserted").when(came, "updated").otherwise("kept").alias("change"))


def upsert_notices(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Source fields are overwritten; review and first_seen stay; a manual tier stays. Of several
    incoming rows of a notice the last by ``arrival`` counts."""
    human, manual = F.lit(True), F.col("c.tier_source") == "manual"
    keep = {"review_status": human, "first_seen": human, "tier": manual, "tier_source": manual}
    fresh = _one_each(incoming, "source_id", "external_id").withColumns({"first_seen": as_of, "last_seen": as_of})
    return upsert(current, fresh, ["source_id", "external_id"], keep)


def upsert_attachments(current: DataFrame, incoming: DataFrame, named_only: bool = False) -> DataFrame:
    """By identity within the notice: refresh, add, drop stored doubles, never remove others; with
    ``named_only`` stored doubles stay where nothing comes in for their notice (one join, for when
    most notices are named). Incoming doubles count once. Adds change; doubles come with change
    'deduplicated'."""
    identity = lambda d: d.withColumn("identity", text.attachment_identity(F.col("label"), F.col("url")))
    stored = identity(current)
    key = ["notice_id", "identity"]
    # only a stored row in the first place meets what comes in; one pass tells the doubles, too
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    if named_only:
        stored = stored.join(incoming.select("notice_id", F.lit(True).alias("__named")).distinct(), "notice_id", "left")
        place = F.when(F.col("__named"), place).otherwise(1)
    placed = stored.withColumn("__place", place).drop("__named")
    came = first_by(identity(incoming), key, F.col("id")).withColumn("__place", F.lit(1))
    merged = upsert(placed, came, [*key, "__place"], {"id": F.lit(True)})
    return merged.withColumn("change", F.when(F.col("__place") > 1, "deduplicated").otherwise(F.col("change"))).drop("__place")


def upsert_insights(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """By notice and document link: all that was found the last time is replaced, also by blanks."""
    key = ["notice_id", "document_url"]
    return upsert(current, _one_each(incoming, *key).withColumn("extracted_at", as_of), key)


def upsert_fit_review(current: DataFrame, patch: DataFrame, notices: DataFrame, defaults: Mapping[str, str], allowed: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Given value, else stored, else default; of several valid patches of a notice the last
    counts. Returns the table and the rejected patches."""
    valid = F.lit(True)
    for c, values in allowed.items():
        valid = valid & (F.col(c).isNull() | F.col(c).isin(*values))
    known = patch.join(notices.select(F.col("id").alias("notice_id")), "notice_id", "left_semi")
    rejected = known.filter(~F.coalesce(valid, F.lit(False))).unionByName(patch.join(notices.select(F.col("id").alias("notice_id")), "notice_id", "left_anti"))
    c, n = current.alias("c"), _one_each(known.filter(valid), "notice_id").alias("n")
    j = c.join(n, "notice_id", "full_outer")
    return j.select("notice_id", *[F.coalesce(F.col(f"n.{x}"), F.col(f"c.{x}"), F.lit(d)).alias(x) for x, d in defaults.items()]), rejected


def set_review(notices: DataFrame, patch: DataFrame, as_of: Column | None = None) -> DataFrame:
    """patch (id, review_status and perhaps note, arrival): the last of a notice counts; status,
    and where the tables have them, review_note and reviewed_at."""
    p = _one_each(patch, "id")
    p = p.select("id", F.col("review_status").alias("__s"), (F.col("note") if "note" in p.columns else F.lit(None).cast("string")).alias("__n"))
    hit = F.col("__s").isNotNull()
    new = {"review_status": F.coalesce("__s", "review_status")}
    if "review_note" in notices.columns:
        new["review_note"] = F.when(hit, F.coalesce("__n", F.lit(""))).otherwise(F.col("review_note"))
    if "reviewed_at" in notices.columns and as_of is not None:
        new["reviewed_at"] = F.when(hit, as_of).otherwise(F.col("reviewed_at"))
    return notices.join(p, "id", "left").withColumns(new).drop("__s", "__n")


def set_tier(notices: DataFrame, patch: DataFrame, as_of: Column | None = None) -> DataFrame:
    """patch (id, tier, reason and perhaps arrival); a patch without a reason is not applied, of
    the others the last of a notice counts."""
    p = _one_each(patch.filter(F.trim("reason") != ""), "id").select("id", F.col("tier").alias("__t"), F.trim("reason").alias("__r"))
    hit = F.col("__t").isNotNull()
    new = {"tier": F.coalesce("__t", "tier"), "tier_source": F.when(hit, "manual").otherwise(F.col("tier_source"))}
    if "tier_reason" in notices.columns:
        new["tier_reason"] = F.when(hit, F.col("__r")).otherwise(F.col("tier_reason"))
    if "tiered_at" in notices.columns and as_of is not None:
        new["tiered_at"] = F.when(hit, as_of).otherwise(F.col("tiered_at"))
    return notices.join(p, "id", "left").withColumns(new).drop("__t", "__r")


def delete_cascade(notices: DataFrame, children: Mapping[str, DataFrame], deliveries: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Removes notices and their children; deliveries stay with a null notice."""
    gone = ids.select(F.col("id").alias("notice_id")).distinct()
    out = {name: t.join(gone, "notice_id", "left_anti") for name, t in children.items()}
    marked = deliveries.join(gone.withColumn("__g", F.lit(True)), "notice_id", "left")
    out["deliveries"] = marked.withColumn("notice_id", F.when(F.col("__g").isNull(), F.col("notice_id"))).drop("__g")
    out["notices"] = notices.join(ids.select("id").distinct(), "id", "left_anti")
    return out


def record_delivery(ledger: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """By (type, key, recipient); sent_at only when sent; failures overwrite and may be retried."""
    came = _one_each(outcomes, "type", "key", "recipient").withColumn("sent_at", F.when(F.col("status") == "sent", as_of))
    return upsert(ledger, came, ["type", "key", "recipient"])


def add_missing_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def baseline(stored: DataFrame, as_of: Column) -> DataFrame:
    """One row: the stored baseline, else as_of; first tells which."""
    return stored.agg(F.max("baseline_at").alias("b")).select(F.coalesce("b", as_of).alias("baseline_at"), F.col("b").isNull().alias("first"))
