"""Filter interaction audit: what every order of a set of filters keeps, removes and wastes.

1. A document's failures are one bit a filter. Documents are counted by part and failure mask
   (a cell), so that whatever follows works on 32 masks a part, not on documents.
2. A recursive CTE extends filter prefixes by each letter that they don't hold yet, with the
   bits applied so far, for each mask; a level gives what its filter does to the mask at that
   step: 5 + 20 + 60 + 120 + 120 prefixes for five filters, 32 masks each, at any input size.
3. The cells' counts are summed by prefix. A prefix's figures hold for all orders that begin
   with it, so a filter's Shapley sum counts each with the number of those orders.

Identical texts are found by their SHA-256: the smallest doc_id by digest, summed in the map
tasks first, then looked up by (digest, doc_id), so that copies of one text spread.

Defined cases: a null text is empty, a null part the empty string; a document without an id
has no smaller one and is nobody's; equal rows count each; several label rows of a document
count as their largest values; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .words import utf8, word_pieces

LETTERS = "ABCDE"
WORDS_LEAST, DISTINCT_LEAST, CAPITALS_MOST = 200, 50, 3  # words, percent of words, percent of characters
_CAPITALS, _MARKUP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]")


def _own_failures(text: str | None) -> tuple[int, bytes]:
    """The bits of A to D, and the text's digest."""
    data, n, kinds = utf8(text), 0, set()
    for words in word_pieces(data):
        n += len(words)
        kinds.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    failed = (n < WORDS_LEAST, 100 * len(kinds) < DISTINCT_LEAST * n, 100 * capitals > CAPITALS_MOST * len(text or ""), _MARKUP.search(data) is not None)
    return sum(1 << i for i, x in enumerate(failed) if x), hashlib.sha256(data).digest()


def failure_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and mask: bit 0 too few words, 1 too few distinct ones, 2 too many capital
    letters, 3 a symbol of markup, 4 the text of a smaller doc_id."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("own int, digest binary")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_own_failures(t) for t in texts], columns=["own", "digest"])

    judged = written(docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), judge("text").alias("m")).select("doc_id", "part", "m.*"), "judged")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return judged.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(copy, F.col("own") + 16).otherwise(F.col("own")).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and mask: n, good (quality 1), toxic (toxic 1)."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def prefixes(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every sequence of different letters with, for every mask that has a cell, what its last
    filter does: prefix, letter, step, mask, kept, removed, redundant, alone."""
    named = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    return counted.sparkSession.sql(f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {named}),
        walk(mask, prefix, applied, letter, step, kept, removed, redundant, alone) AS (
            SELECT mask, '', 0, '', 0, true, false, false, false FROM (SELECT DISTINCT mask FROM {{counted}})
            UNION ALL
            SELECT mask, concat(prefix, f.letter), applied | bit, f.letter, step + 1, mask & (applied | bit) = 0,
                mask & applied = 0 AND mask & bit <> 0, mask & applied <> 0 AND mask & bit <> 0, mask = bit
            FROM walk JOIN filters f ON applied & bit = 0)
        SELECT * FROM walk WHERE step > 0""", counted=counted)


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """cells to part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley."""
    counted = written(counted, "cells")
    walked = written(prefixes(counted, letters), "prefixes")
    total = lambda what, of="n": F.sum(F.when(F.col(what), F.col(of)).otherwise(0))
    figures = counted.join(F.broadcast(walked), "mask").groupBy("part", "prefix", "letter", "step").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("alone").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"))
    figures = written(figures, "figures")
    shared = F.factorial(F.lit(len(letters)) - F.col("step"))  # orders that begin with a prefix
    shapley = figures.groupBy("part", "letter").agg(F.sum(F.col("removed") * shared).alias("shapley"))
    orders = walked.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct() \
        .select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("left(filter_order, step)"))
    return figures.join(F.broadcast(orders), ["prefix", "step"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(failure_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
x as (select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, coalesce(min(doc_id) over (partition by text) < doc_id, false) as e from d),
g as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id),
f as (select part, (if(a, 'A', '') || if(b, 'B', '') || if(c, 'C', '') || if(d, 'D', '') || if(e, 'E', '')) as failed, count(*) as n, count(*) filter (q = 1) as good, count(*) filter (t = 1) as toxic
  from x left join g using (doc_id) group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as k),
o as (select a.k || b.k || c.k || d.k || e.k as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select filter_order, cast(unnest(range(1, 6)) as int) as step from o),
r as (select part, filter_order, step, filter_order[step] as letter, n, good, toxic, failed, contains(failed, filter_order[step]) as fails,
  step > 1 and len(list_intersect(string_split(failed, ''), string_split(filter_order[1:step - 1], ''))) > 0 as gone from s, f),
m as (select part, filter_order, step, letter, coalesce(sum(n) filter (not gone and not fails), 0) as kept, coalesce(sum(n) filter (fails and not gone), 0) as removed, coalesce(sum(n) filter (fails and gone), 0) as redundant,
  coalesce(sum(n) filter (failed = letter), 0) as unique_fails, coalesce(sum(good) filter (fails and not gone), 0) as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0) as toxic_lost from r group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from m
"""
