"""Tree ensembles trained by Spark ML and applied as plain column expressions.

Training reads a bounded labelled sample. The fitted nodes (trees x 2^depth at most) become
nested CASE expressions, so scoring is an ordinary projection, usable inside array lambdas.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

Scorer = Callable[[Mapping[str, Column]], Column]


def bounded_sample(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows that come first by a hash of ``key``: the same rows at any layout. A
    count by the hash's leading 16 bits (65536 rows at most) first tells how far they reach, so
    that the last task of the sort gets little more than them, however many partitions there are."""
    h = F.xxhash64(key)
    lead = F.shiftright(h, 48)
    counts = labelled.groupBy(lead.alias("lead")).count().toPandas().sort_values("lead")
    if counts["count"].sum() > most:
        labelled = labelled.filter(lead <= int(counts["lead"][counts["count"].cumsum() >= most].iloc[0]))
    return labelled.orderBy(h, key, *[c for c in labelled.columns if c != key]).limit(most)


def fit(sample: DataFrame, features: list[str], kind: str, trees: int, depth: int, seed: int = 7) -> Scorer:
    """sample: feature columns and label (0 or 1). Returns a function from feature columns to
    the probability-like score in 0..1. With one class in the sample the score is that class;
    an empty sample scores 1 (nothing is known to be a false alarm)."""
    sample = written(sample.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col("label").cast("double").alias("label")), "labelled")
    seen = [r[0] for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return lambda _: F.lit(seen[0] if seen else 1.0)
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(sample).select("features", "label")
    if kind == "gbt":
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(ready)
    else:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    grown = [_tree(t._call_java("rootNode"), kind) for t in model.trees]
    weights = list(model.treeWeights)

    def score(at: Mapping[str, Column]) -> Column:
        total = sum((_column(t, features, at) * F.lit(w) for t, w in zip(grown, weights, strict=True)), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-2 * total)) if kind == "gbt" else total / F.lit(float(sum(weights)))

    return score


def _tree(node, kind: str):
    """A leaf's value, or (feature, threshold, left, right)."""
    if node.getClass().getSimpleName() == "LeafNode":
        if kind == "gbt":
            return float(node.prediction())
        stats = list(node.impurityStats().stats())
        return float(stats[1] / (sum(stats) or 1.0))
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild(), kind), _tree(node.rightChild(), kind))


def _column(tree, features: list[str], at: Mapping[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(at[features[feature]] <= threshold, _column(left, features, at)).otherwise(_column(right, features, at))
