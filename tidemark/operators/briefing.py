"""The daily briefing: nine counts, four bounded lists and one full list from one set of flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from .tables import placed, tier_rank

VISIBLE = ("tier_1", "tier_2")
LEFT_OUT = ("not_relevant", "closed", "needs_review")
SHOWN = ("id", "title", "tier", "days", "label", "score", "documents")


def list_order() -> list[Column]:
    return [F.desc("score"), F.coalesce("deadline_at", F.lit("")), F.desc("first_seen"), F.col("id")]


def flagged(notices: DataFrame, attachments: DataFrame, as_of: Column, due_days: int = 7, min_score: int = 3, tiers: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Visible notices that are no samples, with what the briefing asks of them: eligible, and,
    false for those that aren't, new_today, urgent, due (has a deadline label), missing (no
    document), watched, high_missing (two points above the least score)."""
    counts = attachments.groupBy(F.col("notice_id").alias("id")).agg(F.count("*").alias("documents"))
    days = dates.days_remaining(F.col("deadline"), as_of)
    active = dates.is_active(F.col("category"), F.col("deadline_at"), F.lit(""), F.lit(None).cast("timestamp"), as_of)
    sample = F.lower(F.coalesce("source_id", F.lit(""))).startswith("sample_")
    v = notices.filter(F.col("tier").isin(*tiers) & ~sample).join(counts, "id", "left") \
        .withColumns({"documents": F.coalesce("documents", F.lit(0)), "days": days, "label": F.when(active, dates.deadline_label(days)).otherwise("")})
    v = v.withColumn("eligible", (F.col("score") >= min_score) & active & ~F.col("review_status").isin(*LEFT_OUT))
    flag = lambda c: F.col("eligible") & F.coalesce(c, F.lit(False))
    return v.withColumns({
        "new_today": flag(F.to_date("first_seen") == F.to_date(as_of)), "urgent": flag(F.col("days").between(0, due_days)), "due": flag(F.col("label") != ""), "missing": flag(F.col("documents") == 0),
        "watched": flag(F.col("review_status").isin("watch", "interesting")), "high_missing": flag((F.col("documents") == 0) & (F.col("score") >= min_score + 2)),
    })


def counts(rows: DataFrame) -> DataFrame:
    """One row of the nine counts."""
    n = lambda c: F.count_if(F.col(c))
    tier = lambda t: F.count_if(F.col("eligible") & (F.col("tier") == t))
    return rows.agg(F.count("*").alias("total_notices"), n("eligible").alias("eligible_notices"), n("new_today").alias("new_today"), F.count_if(F.col("eligible") & (F.col("review_status") == "new")).alias("unreviewed"),
                    n("urgent").alias("urgent"), n("missing").alias("missing_documents"), n("watched").alias("watching"), tier("tier_1").alias("tier_1"), tier("tier_2").alias("tier_2"))


def branch() -> Column:
    """Which of the queue's four lists a notice is in first: due, new, high score without
    documents, watched; null if in none."""
    return F.when(F.col("urgent"), 0).when(F.col("new_today"), 1).when(F.col("high_missing"), 2).when(F.col("watched"), 3)


def queue_order() -> list[Column]:
    """Best tier first, then nearest deadline, highest score; the rest as the lists stood."""
    return [tier_rank(F.col("tier")), F.col("days").isNull(), F.col("days"), F.desc("score"), F.col("branch"), *list_order()[1:]]


def action_queue(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The four lists as one, each notice once."""
    return rows.withColumn("branch", branch()).filter("branch is not null").orderBy(*queue_order()).limit(limit).select(*SHOWN)


def lists(rows: DataFrame, limit: int, path: str) -> DataFrame:
    """section, place and the shown columns: action_queue, new_today, urgent and
    missing_documents to ``limit``, deadline_priority in full (by way of ``path``). The bounded
    lists come from one pass: a row goes to each list that it is in, and map tasks keep no more
    than ``limit`` of each."""
    eligible = rows.filter("eligible").withColumn("branch", branch())
    named = {"action_queue": F.col("branch").isNotNull(), "new_today": F.col("new_today"), "urgent": F.col("urgent"), "missing_documents": F.col("missing")}
    spread = eligible.withColumn("section", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))))
    queue = F.col("section") == "action_queue"
    first = [F.when(queue, tier_rank(F.col("tier"))), F.when(queue, F.col("days").isNull()), F.when(queue, F.col("days")), F.desc("score"), F.when(queue, F.col("branch")), *list_order()[1:]]
    top = spread.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*first)).cast("long")).filter(F.col("place") <= limit)
    due = placed(eligible.filter("due").withColumn("section", F.lit("deadline_priority")), path, *list_order())
    return top.select("section", "place", *SHOWN).unionByName(due.select("section", "place", *SHOWN))


# What the public may see of a link and of an insight: fixed names, in this order.
PUBLIC_LINK = {"label": "document", "url": "", "file_type": ""}
PUBLIC_INSIGHT = {"document_url": "", "document_label": "document", "status": "not_attempted", "summary": ""}
#: Documents of these kinds come first as the primary insight, in this order.
KIND_PRIORITY = ("rfp", "scope", "notice")


def _allowed(items: Column, url: str, fields: dict[str, str]) -> Column:
    """Only items with a public link, only these fields, with a default for what is missing."""
    kept = F.filter(F.coalesce(items, F.array()), lambda x: T.is_http(x[url]))
    return F.transform(kept, lambda x: F.struct(*[F.coalesce(x[f], F.lit(default)).alias(f) for f, default in fields.items()]))


def readable(x: Column) -> Column:
    return (x["status"] == "extracted") & (F.trim(x["summary"]) != "")


def public_notices(workbench: DataFrame, columns: list[str]) -> DataFrame:
    """workbench (source_id, url, attachments, insights, ...) to the listed columns, the public
    attachments and insights, and what follows from these alone: document_status and primary.
    Everything that isn't listed stays inside: reviews, notes, reasons, paths, samples."""
    rows = workbench.filter(~T.is_sample(F.col("source_id"), F.col("url"))).withColumns({"attachments": _allowed(F.col("attachments"), "url", PUBLIC_LINK), "insights": _allowed(F.col("insights"), "document_url", PUBLIC_INSIGHT)})
    kind = lambda x: T.document_kind(x["document_label"], x["document_url"], F.lit(""))
    rank = lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, KIND_PRIORITY)), kind(x)) - 1, F.lit(-1))
    ordered = F.transform(F.filter("insights", readable), lambda x: F.struct(F.when(rank(x) < 0, len(KIND_PRIORITY)).otherwise(rank(x)).alias("kind"), x["document_label"].alias("label"), x.alias("insight")))
    status = F.when(F.exists("insights", readable), "extracted").when((F.size("insights") > 0) | (F.size("attachments") > 0), "fallback_notice_info").otherwise("not_attempted")
    return rows.select(*columns, "attachments", "insights", status.alias("document_status"), F.array_min(ordered)["insight"].alias("primary"))


def public_counts(notices: DataFrame) -> DataFrame:
    """The public summary; notices as above with tier, active, new_today, new_tier_1, label."""
    active = F.col("active")
    links = notices.select(F.explode("attachments.url").alias("url")).filter(F.trim("url") != "").agg(F.count_distinct("url").alias("public_document_links"))
    documents = F.sum(F.size(F.filter("insights", lambda x: x["status"] == "extracted")))
    one = notices.agg(
        F.count("*").alias("total_notices"), F.count_if(active).alias("active_notices"), *[F.count_if(active & (F.col("tier") == f"tier_{i}")).alias(f"active_tier_{i}") for i in (1, 2, 3)],
        F.count_if("new_today").alias("new_today"), F.count_if("new_tier_1").alias("new_tier_1_today"), F.count_if(F.col("new_today") & active).alias("new_active_today"), F.coalesce(documents, F.lit(0)).alias("extracted_documents"),
        F.count_if(F.col("label") == "D-7").alias("deadline_d7"), F.count_if(F.col("label") == "D-3").alias("deadline_d3"))
    return one.crossJoin(links)  # a row each
