"""Joins, evidence windows and de-duplication over notices, attachments and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates, text

# The order of tiers, best first.
TIER_ORDER = ("tier_1", "tier_2", "tier_3")
# Amount labels in order of preference, and what an amount looks like.
AMOUNT_LABELS = (
    ("예산액", r"예\s*산\s*액"), ("소요예산", r"소\s*요\s*예\s*산"), ("과업예산", r"과\s*업\s*예\s*산"), ("사업예산", r"사\s*업\s*예\s*산"), ("기초금액", r"기\s*초\s*금\s*액"),
    ("추정가격", r"추\s*정\s*가\s*격"), ("계약금액", r"계\s*약\s*금\s*액"), ("입찰금액", r"입\s*찰\s*금\s*액"), ("예정가격", r"예\s*정\s*가\s*격"), ("사업비", r"사\s*업\s*비"),
)
AMOUNT = r"(?:금\s*)?(\d{1,3}(?:,\d{3})+|\d+)\s*(원|억원|천만원|백만원)"
# The order of extraction outcomes, most useful first.
STATUS_ORDER = ("extracted", "processed_no_evidence", "missing_document_url", "unsupported_file_type", "sample_source", "download_failed", "parse_failed", "not_attempted")


def ranked(c: Column, order: Sequence[str]) -> Column:
    out = F.lit(len(order))
    for i, x in reversed(list(enumerate(order))):
        out = F.when(c == x, i).otherwise(out)
    return out


def tier_rank(c: Column) -> Column:
    return ranked(c, TIER_ORDER)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def placed(df: DataFrame, path: str, *order: Column) -> DataFrame:
    """Adds place, from 1, in the order of all rows. Rows are sorted into ranges and written to
    ``path``; a row's place is its place in its range plus the sizes of the ranges before, of
    which there is one row each."""
    df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__m", 33))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__base", F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).drop("__size")
    at = F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "__range").withColumn("place", at).drop("__m", "__range", "__base")


def grant_items(items: DataFrame, as_of: Column, days: int, host: str) -> DataFrame:
    """items (external_id, title, url, published_at, window) to notices: an https link of the
    official host or one below it, a title of the portfolio, and a deadline or publication not
    too long ago; a deadline before the publication is an error of the source."""
    official = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    window, published = dates.two_date_window(F.col("window")), dates.normal_date(F.col("published_at"))
    rows = items.filter((F.trim("external_id") != "") & F.col("url").startswith("https://") & (F.lower(official).eqNullSafe(host) | F.lower(official).endswith("." + host)))
    rows = rows.withColumns({"published_at": published, "start_at": window["start"], "deadline_at": window["end"]})
    recent = (F.to_date(F.nullif("deadline_at", F.lit(""))) >= F.to_date(as_of)) | (F.to_date(F.nullif("published_at", F.lit(""))) >= F.date_sub(F.to_date(as_of), days))
    backwards = (F.col("published_at") != "") & (F.col("deadline_at") != "") & (F.col("deadline_at") < F.col("published_at"))
    return rows.filter(F.coalesce(recent, F.lit(False)) & ~backwards)


def document_rows(notices: DataFrame, attachments: DataFrame, as_of: Column) -> DataFrame:
    """One row a link, a gap row where a notice has none; kind and deadline label derived."""
    links = attachments.select(F.col("notice_id").alias("id"), F.col("id").alias("attachment_id"), F.col("label").alias("document_label"), F.col("url").alias("document_url"))
    joined = notices.join(links, "id", "left")
    kind = F.when(F.col("document_url").isNull(), "missing").otherwise(text.document_kind(F.col("document_label"), F.col("document_url"), F.lit("")))
    days = dates.days_remaining(F.col("deadline"), as_of)
    return joined.withColumns({"kind": kind, "kind_order": ranked(kind, text.KINDS), "days_remaining": days, "deadline_label": dates.deadline_label(days)})


def readable(documents: DataFrame, insights: DataFrame) -> DataFrame:
    """Documents with extracted evidence (semi-join on notice and link)."""
    good = insights.filter((F.col("status") == "extracted") & (F.trim("summary") != "")).select(F.col("notice_id").alias("id"), F.coalesce("document_url", F.lit("")).alias("__url"))
    return documents.withColumn("__url", F.coalesce("document_url", F.lit(""))).join(good, ["id", "__url"], "left_semi").drop("__url")


BROADCAST_ROWS, GRID_ROWS = 10_000, 1000


def for_each(rows: DataFrame, recipients: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Every row for every recipient. Up to ``most`` recipients, which are counted first, are sent
    to all tasks; more are dealt by hash into blocks of about GRID_ROWS, rows into as many, and
    each pair of blocks meets in a join of its own key."""
    n = recipients.limit(most + 1).count()
    if n <= most:
        return rows.crossJoin(F.broadcast(recipients))  # of the size just counted
    blocks = -(-recipients.count() // GRID_ROWS)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(blocks))
    left, right = rows.withColumn("__a", block(rows)), recipients.withColumn("__b", block(recipients))
    return left.withColumn("__b", every).join(right.withColumn("__a", every), ["__a", "__b"]).drop("__a", "__b")


def unnotified(notices: DataFrame, recipients: DataFrame, deliveries: DataFrame, baseline: Column, least: int, tiers: Sequence[str], closed: Sequence[str]) -> DataFrame:
    """New notices since the baseline, for each recipient who hasn't had the alert."""
    fresh = notices.filter((F.col("first_seen") >= baseline) & (F.col("score") >= least) & F.col("tier").isin(*tiers) & ~F.col("review_status").isin(*closed))
    sent = deliveries.filter((F.col("type") == "immediate") & (F.col("status") == "sent")).select(F.col("key").alias("__key"), "recipient").distinct()
    return for_each(fresh.withColumn("__key", F.col("id").cast("string")), recipients).join(sent, ["__key", "recipient"], "left_anti").drop("__key")


def similar_pairs(notices: DataFrame, order: Sequence[Column], limit: int = 8, considered: int = 20) -> DataFrame:
    """Pairs of the first ``considered`` notices that share two keywords, or one and the buyer;
    the first ``limit`` pairs in list order. By an inverted index on the keywords."""
    top = notices.orderBy(*order).limit(considered)
    listed = top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("pos", "id", "buyer", F.explode(F.array_distinct("keywords")).alias("term"))
    right = listed.select(F.col("pos").alias("pos_r"), F.col("id").alias("right_id"), F.col("buyer").alias("buyer_r"), "term")
    pairs = listed.join(right, "term").filter("pos < pos_r").groupBy("pos", "pos_r", F.col("id").alias("left_id"), "right_id") \
        .agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("common"), F.count("*").alias("n"), F.first("buyer").alias("b"), F.first("buyer_r").alias("b_r"))
    return pairs.filter("n >= 2 or (b = b_r and b <> '')").orderBy("pos", "pos_r").limit(limit).select("left_id", "right_id", "common")


def exact_link(details: DataFrame, notices: DataFrame) -> DataFrame:
    """details (bid_no, order, ...) and notices (bid_no, order, record_id, ord): the last notice
    of a key in order; details without one stay, marked."""
    key = notices.withColumn("order_key", amounts.canonical_order(F.col("order"))).groupBy("bid_no", "order_key").agg(F.max_by("record_id", "ord").alias("record_id"))
    out = details.withColumn("order_key", amounts.canonical_order(F.col("order"))).join(key, ["bid_no", "order_key"], "left")
    hit = F.col("record_id").isNotNull()
    return out.withColumns({"exact": F.when(hit, "Y").otherwise("N"), "link_status": F.when(hit, "linked").otherwise("no notice of this order"), "record_id": F.coalesce("record_id", F.lit(""))})


def attach_follow_links(links: DataFrame) -> DataFrame:
    """links (page_id, ord, is_notice, is_document): each document with the notice link before it."""
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return links.withColumn("notice_ord", F.last(F.when(F.col("is_notice"), F.col("ord")), ignorenulls=True).over(before)).filter("is_document")


def amount_evidence(paragraphs: DataFrame, key: str, labels: Sequence[tuple[str, str]] = AMOUNT_LABELS, amount: str = AMOUNT) -> DataFrame:
    """paragraphs (key, seq, paragraph) to one row a key: by label order, then paragraph order,
    the first amount that follows the label."""
    line = text.collapse(F.col("paragraph"))
    found = []
    for n, (basis, pattern) in enumerate(labels):
        tail = F.regexp_extract(line, f"(?:{pattern})(.*)$", 1)
        value, unit = F.regexp_extract(tail, amount, 1), F.regexp_extract(tail, amount, 2)
        at = F.length(line) - F.length(tail) - F.length(F.regexp_extract(line, f"({pattern})", 1))
        end = F.length(line) - F.length(tail) + F.instr(tail, F.regexp_extract(tail, amount, 0)) - 1 + F.length(F.regexp_extract(tail, amount, 0))
        start = F.greatest(at - 25, F.lit(0))
        excerpt = F.substr(line, start + 1, F.least(F.length(line), end + 60) - start)
        found.append(F.when(value != "", F.struct(F.lit(n).alias("rank"), F.col("seq").alias("seq"), F.lit(basis).alias("basis"), value.alias("amount"), unit.alias("unit"), excerpt.alias("excerpt"))))
    rows = paragraphs.filter(line.rlike("|".join(p for _, p in labels))).select(key, F.array_min(F.array_compact(F.array(*found))).alias("e")).filter("e is not null")
    return rows.groupBy(key).agg(F.min("e").alias("e")).select(key, "e.basis", F.concat("e.amount", "e.unit").alias("amount_text"), amounts.krw(F.col("e.amount"), F.col("e.unit")).alias("amount_krw"), "e.excerpt")


def task_summary(paragraphs: DataFrame, key: str, sections: Sequence[str], priority: Sequence[str], most: int = 460, enough: int = 360) -> DataFrame:
    """paragraphs (key, seq from 0, paragraph): the first section paragraph with up to four more
    until ``enough`` characters; else three with a priority word; else the first."""
    p = paragraphs.withColumn("line", text.collapse(F.col("paragraph"))).withColumn("good", text.meaningful_paragraph(F.col("paragraph")))
    hit = F.col("good") & F.col("line").rlike("|".join(map(text.quoted, sections)))
    start = p.groupBy(key).agg(F.min(F.when(hit, F.col("seq"))).alias("start"), F.min("seq").alias("first"))
    q = p.join(start, key)
    by_seq = Window.partitionBy(key).orderBy("seq")
    inside = q.filter("seq >= start and seq <= start + 4").withColumn("size", F.when(F.col("good"), F.length("line") + 1).otherwise(0))
    inside = inside.withColumn("held", F.sum("size").over(by_seq) - 1).withColumn("before", F.max(F.when(F.col("seq") > F.col("start"), F.col("held"))).over(by_seq.rowsBetween(Window.unboundedPreceding, -1)))
    section = inside.filter(F.col("good") & ((F.col("seq") == F.col("start")) | F.col("before").isNull() | (F.col("before") < enough)))
    chosen = q.filter(F.col("start").isNull() & F.col("good") & F.col("paragraph").rlike("|".join(map(text.quoted, priority)))).withColumn("__n", F.row_number().over(by_seq)).filter("__n <= 3")
    joined = lambda d: d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), " ").alias("s"))
    first = q.filter("seq = first").select(key, F.col("line").alias("fallback"))
    out = first.join(joined(section).withColumnRenamed("s", "a"), key, "left").join(joined(chosen).withColumnRenamed("s", "b"), key, "left")
    return out.select(key, text.compact_summary(F.coalesce("a", "b", "fallback"), most).alias("summary"))


def consecutive_dedup(paragraphs: DataFrame, key: str) -> DataFrame:
    before = F.lag("paragraph").over(Window.partitionBy(key).orderBy("seq"))
    return paragraphs.withColumn("__b", before).filter("__b is null or __b <> paragraph").drop("__b")


def packed_rows(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """``[a^b] , [c^d]`` to rows; malformed entries stay, with a status and blank fields."""
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    listed, n = raw.startswith("[") & raw.endswith("]"), len(fields)
    chunks = F.when(listed, F.split(F.substr(raw, F.lit(2), F.length(raw) - 2), r"\]\s*,\s*\[")).otherwise(F.array(raw))
    # an entry is split once, while the list is exploded, and not once a field
    clean = lambda x: F.coalesce(amounts.source_value(x), F.lit(""))
    entries = F.transform(chunks, lambda x: F.struct(x.alias("chunk"), F.transform(F.split(x, r"\^", -1), clean).alias("parts")))
    rows = df.filter(~raw.isin("", "-", "[]")).withColumn("__listed", listed).select("*", F.posexplode(entries).alias("pos", "__entry"))
    rows = rows.withColumns({"chunk": F.col("__entry.chunk"), "__parts": F.col("__entry.parts")})
    parts = F.col("__parts")
    count = F.when(F.col("__listed"), F.size(parts)).otherwise(0)
    ok = F.col("__listed") & (F.size(parts) == n)
    values = {f: F.when(ok, F.try_element_at(parts, F.lit(i + 1))).otherwise("") for i, f in enumerate(fields)}
    status = F.when(ok, "ok").when(~F.col("__listed"), "not a list").otherwise(F.concat(F.lit(f"expected {n}, got "), F.size(parts).cast("string")))
    return rows.withColumns({**values, "parse_status": status, "raw_entry": F.when(F.col("__listed"), F.concat(F.lit("["), "chunk", F.lit("]"))).otherwise(F.col("chunk")), "field_count": count, "item_index": F.col("pos") + 1}).drop("pos", "chunk", "__listed", "__entry", "__parts")


def single_detail_rollup(notices: DataFrame, details: DataFrame, value: str) -> DataFrame:
    """Exactly one good detail gives its value; several or malformed ones give none, never a sum."""
    good = F.col("parse_status") == "ok"
    per = details.filter("record_id <> ''").groupBy("record_id").agg(F.count_if(good).alias("n"), F.count_if(~good).alias("bad"), F.max(F.when(good, F.col(value))).alias("v"))
    j = notices.join(per, "record_id", "left")
    return j.select("record_id", F.when(F.coalesce("bad", F.lit(0)) == 0, F.col("n")).alias("detail_count"), F.when((F.col("n") == 1) & (F.col("bad") == 0), F.col("v")).otherwise("").alias("value"),
                    F.when(F.col("n").isNull(), "none").when(F.col("bad") > 0, "parse issue").when(F.col("n") > 1, "multiple").when(F.col("n") == 1, "single").otherwise("none").alias("status"))
