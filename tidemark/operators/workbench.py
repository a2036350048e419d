"""The internal workbench: what is derived for each notice, its readable documents, its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts
from ..functions import text as T
from .briefing import readable

TIERS = ("tier_1", "tier_2", "tier_3")
ENDED = ("not_relevant", "closed", "lost", "won")


def priority(source_id: Column, url: Column, tier: Column, review_status: Column, document_status: Column) -> Column:
    """struct<status, rank, reason>; a label for sorting, not a decision on eligibility."""
    row = lambda status, rank, reason: F.struct(F.lit(status).alias("status"), F.lit(rank).alias("rank"), reason.alias("reason"))
    seen = F.when(document_status == "extracted", "the documents' evidence is at hand").otherwise("the original documents are to be looked at")
    return F.when(T.is_sample(source_id, url), row("sample_not_priority", 90, F.lit("a sample"))) \
        .when(~tier.eqNullSafe("tier_1"), row("not_priority", 80, F.lit("no direct advisory work"))) \
        .when(review_status.isin(*ENDED), row("not_priority", 70, F.lit("its review has ended"))) \
        .otherwise(row("official_tier_1", 0, F.concat(F.lit("direct advisory work of an official source; "), seen)))


def extraction_status(url: Column, source_id: Column, notice_url: Column, file_type: Column, fetched: Column, parsed: Column, found: Column, supported: str = "hwpx") -> Column:
    """What became of a document: fetched, parsed and found tell how far reading it came (null:
    it wasn't tried). The first rule that holds."""
    return F.when(F.coalesce(url, F.lit("")) == "", "missing_document_url").when(T.is_sample(source_id, notice_url), "sample_source") \
        .when(~F.lower(F.coalesce(file_type, F.lit(""))).eqNullSafe(supported) | ~T.is_http(url), "unsupported_file_type") \
        .when(fetched.isNull(), "not_attempted").when(~fetched, "download_failed").when(~F.coalesce(parsed, F.lit(False)), "parse_failed") \
        .when(F.coalesce(found, F.lit(False)), "extracted").otherwise("processed_no_evidence")


def notices(nested: DataFrame, as_of: Column) -> DataFrame:
    """nested (tier, tier_source, tiered_at, first_seen, active, attachments, insights, ...) with
    document_status, priority, new_today, new_tier_1, readable (documents), fallback, unlinked."""
    today = F.to_date(as_of)
    insights, links = F.coalesce("insights", F.array()), F.coalesce("attachments", F.array())
    n_read = F.size(F.filter(insights, readable))
    status = F.when(n_read > 0, "extracted").when((F.size(insights) > 0) | (F.size(links) > 0), "fallback_notice_info").otherwise("not_attempted")
    day = lambda c: F.coalesce(F.to_date(c) == today, F.lit(False))
    rows = nested.withColumns({"document_status": status, "readable": n_read, "new_today": day("first_seen")})
    rows = rows.withColumn("priority", priority(F.col("source_id"), F.col("url"), F.col("tier"), F.col("review_status"), F.col("document_status")))
    came = day("first_seen") | ((F.col("tier_source") == "manual") & day("tiered_at"))
    linked = F.exists(links, lambda x: F.trim(F.coalesce(x["url"], F.lit(""))) != "")
    return rows.withColumns({"new_tier_1": (F.col("tier") == "tier_1") & came & F.col("active") & (F.col("priority.status") == "official_tier_1"),
                             "fallback": F.col("document_status") != "extracted", "unlinked": (F.col("document_status") == "fallback_notice_info") & ~linked})


def documents(rows: DataFrame) -> DataFrame:
    """The readable documents, a row each, with their notice's id and title."""
    return rows.select(F.col("id").alias("notice_id"), "title", F.explode(F.filter(F.coalesce("insights", F.array()), readable)).alias("d")).select("notice_id", "title", "d.*")


def counts(rows: DataFrame) -> DataFrame:
    """One row of the eighteen counts, from one pass over the notices."""
    active, new = F.col("active"), F.col("new_today")
    of = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        F.count("*").alias("total_notices"), of(active, "active_notices"), *[of(active & (F.col("tier") == t), f"active_{t}") for t in TIERS], of(new, "new_today"), of(new & active, "new_active_today"), of(F.col("new_tier_1"), "new_tier_1_today"),
        of(new & (F.col("tier") == "tier_2"), "new_tier_2_today"), *[of(F.col("tier") == t, t) for t in TIERS], F.coalesce(F.sum("readable"), F.lit(0)).alias("extracted_documents"), of(F.col("document_status") == "fallback_notice_info", "fallback_notices"),
        of(F.col("unlinked"), "missing_document_urls"), of(F.col("priority.status") == "official_tier_1", "official_tier_1_priorities"), of(F.col("label") == "D-7", "deadline_d7"), of(F.col("label") == "D-3", "deadline_d3"))


def workbook_counts(rows: DataFrame) -> DataFrame:
    """counted, tier, value, count: notices by tier and activity, by deadline label, and readable
    documents by tier; one aggregate over all three."""
    each = F.array(F.struct(F.lit("activity").alias("counted"), F.col("tier").alias("tier"), F.when(F.col("active"), "active").otherwise("closed").alias("value"), F.lit(1).alias("n")),
                   F.struct(F.lit("label").alias("counted"), F.lit("").alias("tier"), F.col("label").alias("value"), F.lit(1).alias("n")),
                   F.struct(F.lit("extracted").alias("counted"), F.col("tier").alias("tier"), F.lit("").alias("value"), F.col("readable").alias("n")))
    return rows.select(F.inline(each)).groupBy("counted", "tier", "value").agg(F.sum("n").alias("count"))


def annual(history: DataFrame) -> DataFrame:
    """history (notice_year, notice_date, relevance_status, budget) by year, which falls back to
    the date's: total, core, review, excluded (a prefix), the known budgets' sum and number."""
    year = F.coalesce(F.nullif(F.trim("notice_year"), F.lit("")), F.regexp_extract(F.coalesce("notice_date", F.lit("")), r"^\s*(\d{4})", 1))
    budget = amounts.listing_budget(F.col("budget"))
    return history.groupBy(year.alias("year")).agg(
        F.count("*").alias("total"), F.count_if(F.col("relevance_status") == "core").alias("core"), F.count_if(F.col("relevance_status") == "review").alias("review"),
        F.count_if(F.col("relevance_status").startswith("exclude")).alias("excluded"), F.coalesce(F.sum(budget), F.lit(0)).cast("bigint").alias("budget"), F.count(budget).alias("budget_known"))
