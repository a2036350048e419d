"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are grown on the driver from a bounded sample (``sample_rows``, the first by hash):
each node splits at the median of the projection on the difference of two random rows. All
rows are indexed: Spark sends each to its leaf of every tree. A query walks all trees through
one priority queue, by the sum of squared distances to the planes it crosses, until the leaves
it has taken hold as many rows as ``search_rows`` allows; each leaf's rows are then ranked for
its queries by the exact cosine in double precision. The allowance grows with the number of
rows to the power 0.8 (``SEARCH_FACTOR``), so the share of the table that a query sees falls as
the table grows; below ``SEARCH_LEAST`` rows a query sees every leaf. Rows of the sample that are
in a query's leaves say how near its k-th nearest row is at least, so leaves keep back what is
farther. Large leaves are dealt in
blocks and so are the queries of a leaf that very many visit: no task holds more than
``BLOCK_ROWS`` of its rows and about ``BLOCK_QUERIES`` of its queries. Equal vectors are one
entry with their k + 1 smallest ids, which is all that k places can need.

Defined cases: null, zero or empty vectors and those with null or non-finite components take
no part, nor do rows without an id or of another than the most frequent dimension (the smaller
one on a tie); of rows with equal ids the smallest vector counts; ties go to the smaller id;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TREES = 16
LEAF_ROWS = 200
SAMPLE_ROWS = 20_000
SEARCH_FACTOR, SEARCH_POWER, SEARCH_LEAST = 4.0, 0.8, 8000
BLOCK_ROWS, BLOCK_QUERIES = 4000, 20_000


def search_rows(total: int) -> int:
    """Rows (counted once a tree) in the leaves that a query visits."""
    return max(SEARCH_LEAST, int(SEARCH_FACTOR * total**SEARCH_POWER))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    dims = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.filter(F.size("embedding") == (dims["d"] if dims else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Forest:
    """Trees as arrays: normals, thresholds, children (a leaf as -1 - number), leaf shares."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            normals, cuts, children, shares = [], [], [], []

            def grow(at: np.ndarray, level: int, normals=normals, cuts=cuts, children=children, shares=shares) -> int:
                if level < depth and len(at) > 1:
                    a, b = sample[rng.choice(at, 2, replace=False)]
                    w = a - b
                    if (size := np.linalg.norm(w)) > 0:
                        p = sample[at] @ (w / size)
                        cut = float(np.median(p))
                        low = p <= cut
                        if 0 < low.sum() < len(at):
                            me = len(normals)
                            normals.append(w / size)
                            cuts.append(cut)
                            children.append([0, 0])
                            children[me][0] = grow(at[low], level + 1)
                            children[me][1] = grow(at[~low], level + 1)
                            return me
                shares.append(len(at) / max(len(sample), 1))
                return -len(shares)

            root = grow(np.arange(len(sample)), 0)
            self.trees.append((root, np.array(normals), np.array(cuts), np.array(children), np.array(shares)))

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each unit row in each tree."""
        out = np.zeros((len(unit), len(self.trees)), np.int32)
        for t, (root, normals, cuts, children, _) in enumerate(self.trees):
            at = np.full(len(unit), root)
            while len(live := np.nonzero(at >= 0)[0]):
                n = at[live]
                right = np.einsum("ij,ij->i", unit[live], normals[n]) > cuts[n]
                at[live] = children[n, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, unit: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold that share."""
        queue, ties, out, held = [(0.0, t, t, tree[0]) for t, tree in enumerate(self.trees)], len(self.trees), [], 0.0
        at = [normals @ unit - cuts if len(cuts) else cuts for _, normals, cuts, _, _ in self.trees]
        while queue and held < share:
            far, _, t, node = heapq.heappop(queue)
            children, shares = self.trees[t][3:]
            while node >= 0:  # the near side costs nothing; the other one waits
                margin = at[t][node]
                near = int(margin > 0)
                ties += 1
                heapq.heappush(queue, (far + margin * margin, ties, t, int(children[node][1 - near])))
                node = int(children[node][near])
            out.append((t, -1 - node))
            held += shares[-1 - node]
        return out


def _matrix(vectors: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, query) of each query's k best entries by column, and of all as good as the last."""
    last = -np.partition(-near, k - 1, axis=0)[k - 1] if len(near) > k else near.min(axis=0)
    return np.nonzero(near >= last - 1e-9)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, searched: int | None = None) -> DataFrame:
    """rows (vec_id, embedding) and which of them ask, to query_id, rank, vec_id, score."""
    spark, good = rows.sparkSession, usable(rows)
    dtype = "<f4" if "float" in good.schema["embedding"].dataType.simpleString() else "<f8"
    total, n_asked = good.agg(F.count("*"), F.count_if(is_query)).first()
    share = (searched or search_rows(total)) / max(total, 1)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "embedding").toPandas()
    points = _unit(np.array(sample["embedding"].tolist(), np.float64)) if len(sample) else np.zeros((0, 1))
    depth = max(1, min(math.ceil(math.log2(max(total, 1) / leaf_rows)), int(math.log2(max(len(points), 1) / 16)))) if len(points) > 1 else 0
    forest = spark.sparkContext.broadcast(Forest(points, trees, depth))
    known = spark.sparkContext.broadcast((sample["vec_id"].to_numpy(), points, forest.value.leaves(points) if len(points) else None))
    # blocks of a leaf's rows, and of the queries that visit it if they come in proportion to its rows
    per_leaf = [np.maximum(1, np.ceil(t[4] * total / BLOCK_ROWS)).astype(int) for t in forest.value.trees]
    per_asked = max(1, math.ceil(n_asked * min(1.0, share / trees) / BLOCK_QUERIES))

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = np.array(part["embedding"].tolist(), np.float64)
            leaves, raw = forest.value.leaves(_unit(m)), [v.tobytes() for v in m.astype(dtype)]
            firsts = np.array([min(x) for x in part["ids"]])
            for t in range(leaves.shape[1]):
                for ask in range(per_asked):
                    yield pd.DataFrame({"tree": t, "leaf": leaves[:, t], "block": firsts % per_leaf[t][leaves[:, t]], "ask": ask, "ids": part["ids"].to_numpy(), "vector": raw})

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampled, units, leaves = known.value
        visited = np.zeros((trees, max(len(t[4]) for t in forest.value.trees)), bool)
        for part in parts:
            m, least = np.array(part["embedding"].tolist(), np.float64), np.full(len(part), -np.inf)
            found, who = [], []
            for i, (unit, own) in enumerate(zip(_unit(m), part["vec_id"], strict=True)):
                taken = forest.value.search(unit, share)
                visited[:] = False
                visited[tuple(np.array(taken).T)] = True
                near = (units @ unit)[visited[np.arange(trees), leaves].any(axis=1) & (sampled != own)]
                if len(near) >= k:
                    least[i] = np.partition(near, len(near) - k)[-k] - 1e-9
                mine = [(t, leaf, b) for t, leaf in taken for b in range(per_leaf[t][leaf])]
                found += mine
                who += [i] * len(mine)
            ids, raw = part["vec_id"].to_numpy()[who], np.array([v.tobytes() for v in m.astype(dtype)], object)[who]
            yield pd.DataFrame(found, columns=["tree", "leaf", "block"]).assign(ask=ids % per_asked, query_id=ids, least=least[who], vector=raw)

    def rank(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(entries) and len(asked):
            v, ids = _matrix(entries["vector"], dtype), entries["ids"].tolist()
            norms, many = np.sqrt((v * v).sum(axis=1)), np.array([len(x) for x in ids])
            flat, begins = np.concatenate(ids), np.cumsum(many) - many
            for a in range(0, len(asked), 1000):
                some = asked.iloc[a : a + 1000]
                q, query, least = _matrix(some["vector"], dtype), some["query_id"].to_numpy(), some["least"].to_numpy()
                own = np.sqrt((q * q).sum(axis=1))
                e, j = _best((v / norms[:, None]) @ (q / own[:, None]).T, k + 1)  # the query itself may be one
                exact = (v[e] * q[j]).sum(axis=1) / (norms[e] * own[j])
                enough = exact >= least[j]
                e, j, exact = e[enough], j[enough], exact[enough]
                times = many[e]
                member = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begins[e], times)
                out = pd.DataFrame({"query_id": np.repeat(query[j], times), "vec_id": flat[member], "score": np.repeat(exact, times)})
                out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                found.append(out.groupby("query_id").head(k))
        return pd.concat(found).astype({"query_id": "int64", "vec_id": "int64", "score": float})

    same = Window.partitionBy("embedding").orderBy("vec_id")
    entries = good.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).groupBy("embedding").agg(F.collect_list("vec_id").alias("ids"))
    keys, at = ["tree", "leaf", "block", "ask"], "tree int, leaf int, block long, ask long, "
    indexed = entries.select("ids", "embedding").mapInPandas(index, at + "ids array<long>, vector binary")
    asked = good.filter(is_query).select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism).mapInPandas(visits, at + "query_id long, least double, vector binary")
    found = indexed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
