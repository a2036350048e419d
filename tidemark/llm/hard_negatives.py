"""Hard-negative mining: exact integer products of anchor and candidate tiles by Strassen.

Rows become vectors of floor(256 x) in int64. Anchors and candidates are dealt by hash into
tiles of a fixed number of rows, and each anchor tile meets each candidate tile in a task of its
own, which multiplies them by Strassen's recursion (seven half-size products, zero padding to
even sides, exact additions) and keeps bounded heaps: first each anchor's best rows of its own
label, then, with those known, its best rows of other labels within each positive's window.
A task's heaps hold k entries; heaps of all tiles merge to the same k, whatever their order.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; equal rows (id, label, vector) count once, other rows of an id each; shorter
vectors count as padded with zeros; a positive of negative score has an empty window; scores
are exact while they fit in 64 bits and wrap beyond; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE = 256
ANCHOR_TILE, CANDIDATE_TILE = 512, 4096
STRASSEN_LEAF = 32
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # percent of the positive's score


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = STRASSEN_LEAF) -> np.ndarray:
    """a @ b for int64 matrices, exact modulo 2^64."""
    m, d, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, d, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, d % 2)))
    b = np.pad(b, ((0, d % 2), (0, n % 2)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k] = p1 + p4 - p5 + p7
    out[:i, k:] = p3 + p5
    out[i:, :k] = p2 + p4
    out[i:, k:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def heaps(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed columns of each row, by score, then smaller id; the
    columns come in the order of their ids."""
    assert (ids[1:] >= ids[:-1]).all()
    rows, columns = [], []
    for r, (line, ok) in enumerate(zip(scores, allowed, strict=True)):
        at = np.flatnonzero(ok)
        if len(at) > k:
            last = -np.partition(-line[at], k - 1)[k - 1]
            above, ties = at[line[at] > last], at[line[at] == last]
            at = np.concatenate([above, ties[: k - len(above)]])
        rows.append(np.full(len(at), r))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


def prepared(rows: DataFrame, corrupted: Column | None = None) -> DataFrame:
    """vec_id, label and embedding (array of doubles) of the rows that take part, each once."""
    label = F.col("label").cast("long")
    if corrupted is not None:
        label = F.when(corrupted, (label + 1) % 10).otherwise(label)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite) \
        .select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(SCALE * out).astype(np.int64)


def _top(rows: DataFrame, by: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    """The k first rows of each key: heaps of tiles, merged; with their place as ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, corrupted: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         anchor_tile: int = ANCHOR_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """rows (vec_id, label, embedding) to anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    good = written(prepared(rows, corrupted).withColumn("key", F.xxhash64("vec_id", "label", "embedding")), "vectors")
    total, asked, size = good.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("embedding"))).first()
    n_anchor, n_candidate = max(1, math.ceil(asked / anchor_tile)), max(1, math.ceil(total / candidate_tile))
    tiles = ["anchors", "candidates"]
    # numbers of one type on both sides: cogroup casts none, and an int and a long of a value hash apart
    at_anchor, at_candidate = (F.pmod(F.xxhash64("key"), F.lit(n)).cast("int") for n in (n_anchor, n_candidate))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = good.select(at_candidate.alias("candidates"), every(n_anchor).alias("anchors"), "vec_id", "label", "key", "embedding")
    anchors = good.filter(is_anchor).select(*[F.col(c).alias(c) for c in good.columns])  # columns of their own, for the joins

    def products(a: pd.DataFrame, c: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        c = c.sort_values("vec_id", ignore_index=True)
        return c, strassen(_matrix(a["embedding"], size), np.ascontiguousarray(_matrix(c["embedding"], size).T))

    def positive_heaps(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"key": [], "positive_id": [], "positive_key": [], "positive_score": []}).astype("int64")
        c, scores = products(a, c)
        own = (a["label"].to_numpy()[:, None] == c["label"].to_numpy()) & (a["key"].to_numpy()[:, None] != c["key"].to_numpy())
        r, k = heaps(scores, own, c["vec_id"].to_numpy(), positives)
        return pd.DataFrame({"key": a["key"].to_numpy()[r], "positive_id": c["vec_id"].to_numpy()[k], "positive_key": c["key"].to_numpy()[k], "positive_score": scores[r, k]})

    def window_heaps(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"key": [], "positive_key": [], "negative_id": [], "negative_score": []}).astype("int64")]
        if len(a) and len(c):
            c, scores = products(a, c)
            ids, other = c["vec_id"].to_numpy(), a["label"].to_numpy()[:, None] != c["label"].to_numpy()
            places = a["positives"].map(len).to_numpy()
            for p in range(places.max()):
                some = np.flatnonzero(places > p)
                best = np.array([a["positives"].iloc[i][p]["positive_score"] for i in some])[:, None]
                near = scores[some]
                # the window's limits as whole scores: no product that might not fit
                whole, part = best // 100, best % 100
                inside = other[some] & (near >= LOW * whole - (-LOW * part // 100)) & (near <= HIGH * whole + HIGH * part // 100)
                r, k = heaps(near, inside, ids, negatives)
                keys = np.array([a["positives"].iloc[i][p]["positive_key"] for i in some], np.int64)
                found.append(pd.DataFrame({"key": a["key"].to_numpy()[some][r], "positive_key": keys[r], "negative_id": ids[k], "negative_score": near[r, k]}))
        return pd.concat(found)

    def dealt(asking: DataFrame) -> DataFrame:
        return asking.withColumns({"anchors": at_anchor, "candidates": every(n_candidate)})

    met = dealt(anchors).groupBy(*tiles).cogroup(candidates.groupBy(*tiles)).applyInPandas(positive_heaps, "key long, positive_id long, positive_key long, positive_score long")
    best = written(_top(met, ["key"], "positive_score", ["positive_id", "positive_key"], positives).drop("rank"), "positives")
    held = best.groupBy("key").agg(F.collect_list(F.struct("positive_key", "positive_score")).alias("positives"))
    met = dealt(anchors.join(held, "key")).groupBy(*tiles).cogroup(candidates.groupBy(*tiles)).applyInPandas(window_heaps, "key long, positive_key long, negative_id long, negative_score long")
    ranked = _top(met, ["key", "positive_key"], "negative_score", ["negative_id"], negatives)
    return ranked.join(best, ["key", "positive_key"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key") \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0)


OP11_SQL = """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as own, cast(list_inner_product(a.e, c.e) as bigint) as score from v a, v c where a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not own and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select * from n where rank <= 5
"""
