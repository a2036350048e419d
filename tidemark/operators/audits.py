"""Audits of stored notices by the title rules in force, and what applying them changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify as C

TIERS = ("tier_1", "tier_2", "tier_3", "unclassified")


def _assessed(notices: DataFrame, terms: C.TierTerms) -> DataFrame:
    """Adds new, the tier of the cascade, and changed; a manual tier is left alone."""
    tier = C.tier_cascade(F.col("title"), F.coalesce("category", F.lit("")), F.coalesce("buyer", F.lit("")), F.lit(""), terms)["tier"]
    automatic = F.col("tier_source") != "manual"
    return notices.withColumn("new", F.when(automatic, tier)).withColumn("changed", automatic & ~F.coalesce("tier", F.lit("unclassified")).eqNullSafe(F.col("new")))


def tier_audit(notices: DataFrame, terms: C.TierTerms) -> DataFrame:
    """One row: all notices, automatic and manual ones, the automatic ones by their new tier, and
    how many of these applying it would change."""
    return _assessed(notices, terms).agg(
        F.count("*").alias("total"), F.count("new").alias("automatic"), F.count_if(F.col("new").isNull()).alias("manual_preserved"),
        *[F.count_if(F.col("new") == t).alias(t) for t in TIERS], F.count_if("changed").alias("would_change"))


def reclassify(notices: DataFrame, terms: C.TierTerms) -> DataFrame:
    """Automatic tiers anew; everything else as it was."""
    return _assessed(notices, terms).withColumn("tier", F.coalesce("new", "tier")).drop("new", "changed")


def _uncertain(policy: Column) -> Column:
    return (policy != "strong") & (F.col("review_status") == "new")


def title_audit(notices: DataFrame, policy: Column) -> DataFrame:
    """One row: notices by what the title policy says of them, and the new ones that are not
    strong. policy: strong, needs_review or ignore, a column of the notices."""
    rows = notices.withColumn("policy", policy)
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("policy") == p).alias(p) for p in ("strong", "needs_review", "ignore")], F.count_if(_uncertain(F.col("policy"))).alias("eligible_for_quarantine"))


def quarantine(notices: DataFrame, policy: Column, note: str, concerned: Column) -> DataFrame:
    """New notices that are not strong become needs_review, with the note; sources that are not
    concerned, and all source text, stay."""
    hit = concerned & _uncertain(F.col("__policy"))
    rows = notices.withColumn("__policy", policy).withColumn("review_note", F.when(hit, F.lit(note)).otherwise(F.col("review_note")))
    return rows.withColumn("review_status", F.when(hit, "needs_review").otherwise(F.col("review_status"))).drop("__policy")
