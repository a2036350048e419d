"""URL filters: block and allow rules, and gradient-boosted trees on lexical features.

The trees are trained from labelled URLs (url, label 1 = block); at most ``max_labelled`` of
them, a documented bound, the first by hash. The suffix statistics cover all labelled URLs; a
training row's leave out the fold of labels its own URL belongs to. Rules win over the trees; of the rules that fit,
the longest wins.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and
is judged by the trees on its empty features; repeated rows are judged alike; further columns
stay, but those named like the results are replaced; an empty table gives an empty result; without labels of both classes the trees give the
only class seen, or allow if there is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, table, unboxed, written
from .trees import bounded_sample, fit

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES = ["url_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "has_fragment", "suffix_rate", "suffix_seen"]
#: Rules beyond this number are a table to join, not literals in the plan.
MAX_LITERAL_RULES = 1000
FOLDS = 5


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    cut = lambda n: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*+)([^?#]*+)", n), F.lit(""))
    return ascii_lower(cut(1)), cut(2)


def with_parts(urls: DataFrame) -> DataFrame:
    host, path = host_path(F.col("url"))
    return urls.withColumns({"host": host, "path": path})


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, what, ""))


def entropy(c: Column) -> Column:
    """Bits a character."""
    n = F.length(c).cast("double")
    return F.coalesce(F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda s, x: s + F.when(x != "", _share(c, x, n)).otherwise(0.0)), F.lit(0.0))


def _share(c: Column, x: Column, n: Column) -> Column:
    p = (n - F.length(F.replace(c, x, F.lit("")))) / n
    return -p * F.log2(p)


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def with_features(parted: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise(F.lit(""))
    return parted.withColumns({
        "suffix": suffix_of(F.col("host")), "url_chars": F.length(url), "host_chars": F.length("host"), "path_chars": F.length("path"), "depth": _count(F.col("path"), "/"),
        "digit_ratio": _count(url, "[0-9]") / n, "entropy": entropy(url), "n_params": F.when(query != "", _count(query, "&") + 1).otherwise(0), "n_labels": _count(F.col("host"), r"\."),
        "n_hyphens": _count(url, "-"), "has_fragment": (F.instr(url, "#") > 0).cast("int"),
    })


def with_suffix(urls: DataFrame) -> DataFrame:
    return urls.withColumn("suffix", suffix_of(host_path(F.col("url"))[0]))


def fold() -> Column:
    """Equal URLs fall into one fold."""
    return F.coalesce(F.crc32(F.col("url").cast("binary")) % FOLDS, F.lit(0))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Labelled URLs and blocked ones of each host suffix and fold."""
    return with_suffix(labelled).groupBy("suffix", fold().alias("fold")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))


def _rates(n: Column, blocked: Column) -> dict[str, Column]:
    """Smoothed share of blocked, rows seen; 0.5 and 0 if there are none."""
    n, blocked = F.coalesce(n, F.lit(0)), F.coalesce(blocked, F.lit(0))
    return {"suffix_rate": (blocked + 1.0) / (n + 2.0), "suffix_seen": F.log1p(n)}


def suffix_statistics(counts: DataFrame) -> DataFrame:
    """A row a host suffix, from all folds."""
    return counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).select("suffix", *[c.alias(k) for k, c in _rates(F.col("n"), F.col("blocked")).items()])


def training_rows(sample: DataFrame, counts: DataFrame) -> DataFrame:
    """Labelled URLs with their features; the suffix statistics come from the other folds.
    Without the row alone, the rate would tell its label: a blocked row's is the lower one."""
    mine = with_suffix(sample).withColumn("own", fold())
    keys = mine.select("suffix", "own").distinct()
    others = keys.join(counts, "suffix").filter("fold <> own").groupBy("suffix", "own").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    joined = mine.join(others, ["suffix", "own"], "left")
    return with_features(with_parts(joined.withColumns(_rates(F.col("n"), F.col("blocked"))).drop("own", "n", "blocked")))


def with_rule(parted: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule (host and path as one text) and rule_action, null where none fits."""
    host, path = F.col("host"), F.col("path")
    if len(rules) <= MAX_LITERAL_RULES:
        options = [F.struct((F.length(F.lit(h)) + F.length(F.lit(p))).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
        fits = F.filter(F.array(*options), lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])) if rules else F.lit(None)
        best = F.array_max(fits) if rules else F.lit(None).cast("struct<rule:string,action:string>")
        return parted.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "rule_action": F.col("best.action")}).drop("best")
    spark = parted.sparkSession
    listed = spark.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "suffix_host string, rule_path string, rule string, rule_action string")
    parts = F.split("host", r"\.")
    keys = parted.select("host", "path").distinct().withColumn("suffix_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    best = keys.join(listed, "suffix_host").filter(path.startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "rule_action")).alias("best"))
    return parted.join(best.select("host", "path", "best.rule", "best.rule_action"), ["host", "path"], "left")


def judge_urls(urls: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_labelled: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """urls (url, ...) and labelled (url, label) to urls with host, path, rule, score, verdict."""
    known = labelled.filter("label is not null").select("url", F.col("label").cast("int").alias("label"))
    counts = written(suffix_counts(known), "suffixes")
    score = fit(training_rows(bounded_sample(known, "url", max_labelled), counts), FEATURES, "gbt", trees, depth)
    joined = with_suffix(boxed(urls, "url")).join(suffix_statistics(counts), "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_seen": 0.0})
    judged = with_features(with_rule(with_parts(joined), rules))
    judged = judged.withColumn("score", score({f: F.col(f) for f in FEATURES}))
    verdict = F.coalesce("rule_action", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return unboxed(judged, urls.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), score=F.col("score"), verdict=verdict)


def weak_labels(pages: DataFrame, junk: float = 0.2) -> DataFrame:
    """Labelled URLs from the pages behind them: 1 where runs of three symbols make up more
    than ``junk`` of the words."""
    html = F.coalesce("html", F.lit(""))
    runs = F.size(F.split(html, r"[%#*$]{3}|(?:&amp;){3}")) - 1
    return pages.select("url", (runs > junk * F.size(F.split(html, " "))).cast("int").alias("label"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), weak_labels(pages)).select("page_id", "host", "path", "rule", "verdict", "score")
