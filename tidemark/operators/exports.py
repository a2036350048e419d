"""The two CSV products: visible notices, and the checklist of their documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from .tables import document_rows

# The columns of both files, in order.
NOTICES = (
    "source_name", "notice_id", "review_status", "business_tier", "tier_reason", "tier_source", "title", "url", "buyer", "published_at", "deadline_at",
    "deadline_priority", "procurement_method", "budget", "relevance_score", "matched_keywords", "review_note", "first_seen_at", "last_seen_at",
)
DOCUMENTS = (
    "document_kind", "document_kind_label", "document_label", "document_url", "document_access_hint", "file_type", "notice_id", "review_status", "business_tier",
    "tier_reason", "tier_source", "notice_title", "notice_url", "source_name", "buyer", "published_at", "deadline_at", "deadline_priority", "procurement_method",
    "budget", "relevance_score", "matched_keywords", "review_note",
)
_NAMES = {"id": "notice_id", "tier": "business_tier", "score": "relevance_score", "keywords": "matched_keywords", "first_seen": "first_seen_at", "last_seen": "last_seen_at"}


def _named(notices: DataFrame) -> DataFrame:
    lists = {c: F.array_join(c, ", ") for c, t in notices.dtypes if t == "array<string>"}
    stamps = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen") if c in notices.columns}
    return notices.withColumns(lists | stamps).withColumnsRenamed(_NAMES)


def notice_export(notices: DataFrame, tiers: Sequence[str], as_of: Column) -> DataFrame:
    """Notices of the visible tiers, samples left out, by the file's columns."""
    label = dates.deadline_label(dates.days_remaining(F.col("deadline"), as_of))
    rows = notices.filter(F.col("tier").isin(*tiers) & ~F.lower(F.coalesce("source_id", F.lit(""))).startswith("sample_"))
    return _named(rows.withColumn("deadline_priority", F.coalesce(label, F.lit("")))).select(*NOTICES)


def document_export(notices: DataFrame, attachments: DataFrame, as_of: Column, kinds: Mapping[str, str], hints: Sequence[tuple[str, str]], missing: str, default: str) -> DataFrame:
    """One row a link, a gap row where a notice has none, by the file's columns."""
    rows = document_rows(notices, attachments, as_of)
    kind_of = F.nullif(text.file_extension(F.col("document_label")), F.lit(""))
    rows = rows.withColumns({
        "document_kind_label": text.labelled(F.col("kind"), kinds), "document_access_hint": text.access_hint(F.col("source_id"), F.col("document_url"), hints, missing, default),
        "file_type": F.coalesce(kind_of, text.file_extension(F.col("document_url"))), "deadline_label": F.coalesce("deadline_label", F.lit("")),
        "document_label": F.coalesce("document_label", F.lit("")), "document_url": F.coalesce("document_url", F.lit("")),
    })
    return _named(rows).withColumnsRenamed({"kind": "document_kind", "title": "notice_title", "url": "notice_url", "deadline_label": "deadline_priority"}).select(*DOCUMENTS)
