"""Secret scans: token candidates, judged by a random forest, DataFrame functions only.

Candidates are tokens of 16 characters or more with a digit, at every place in a text. The
forest sees length, changes between character classes, how many of its letter pairs and how
much of it common words account for, path signs and the words next to the token, and takes
away false alarms. Common words are the ``DICTIONARY_WORDS`` most frequent of the corpus, by
counts of all its texts. The forest learns from labelled findings (before, token, after, label
1 = secret); at most ``max_labelled`` of them, a documented bound.

Defined cases: a null or empty text has no candidate and stays as it is; repeated rows are
judged alike; a token that is a secret at one place is replaced at all places where it stands
as a token of its own; further columns stay, but those named like the results are replaced
(``redact`` keeps all but ``text``); an empty table gives an empty result; without labels of
both classes every candidate gets the only class seen (or is a secret, if there is none).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed
from .trees import Scorer, bounded_sample, fit

TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
NEAR = 40
DICTIONARY_WORDS, LETTER_PAIRS = 300, 100
# Words that name a secret.
NAMING = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "auth", "bearer")
FEATURES = ["chars", "changes", "distinct_ratio", "digit_ratio", "coverage", "pairs", "n_path", "n_upper", "named", "assigned", "quoted"]
PLACEHOLDER = "[SECRET]"


def _with_tokens(text: Column, made) -> Column:
    """``made`` of the candidates of a text (tokens) and of what stands before, between and
    after them (parts); the text is searched once."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"), F.split(text, TOKEN, -1).alias("parts"))
    return F.get(F.transform(F.array(cut), lambda c: made(c["tokens"], c["parts"])), F.lit(0))


def candidates(text: Column) -> Column:
    """array<struct<before, token, after>>, one a place, in text order."""
    def places(tokens: Column, parts: Column) -> Column:
        def at(token: Column, i: Column) -> Column:
            before = F.concat(F.coalesce(F.get(tokens, i - 1), F.lit("")), F.get(parts, i))
            after = F.concat(F.get(parts, i + 1), F.coalesce(F.get(tokens, i + 1), F.lit("")))
            return F.struct(F.right(before, F.lit(NEAR)).alias("before"), token.alias("token"), F.left(after, F.lit(NEAR)).alias("after"))

        return F.transform(tokens, at)

    return F.coalesce(_with_tokens(text, places), F.array().cast("array<struct<before:string,token:string,after:string>>"))


def common_words(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of 3 to 12 letters, of all texts; ``most`` at most."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter(F.length("w").between(3, 12))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def features(before: Column, token: Column, after: Column, words: Sequence[str]) -> dict[str, Column]:
    """What the forest sees of a candidate."""
    n = F.greatest(F.length(token), F.lit(1)).cast("double")
    rest = lambda c, what: F.length(F.regexp_replace(c, what, ""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0")
    seen = [w[i : i + 2] for w in words for i in range(len(w) - 1)]
    pairs = sorted(set(seen), key=lambda x: (-seen.count(x), x))[:LETTER_PAIRS]
    held = F.size(F.regexp_extract_all(F.lower(token), F.lit(f"(?=({'|'.join(pairs)}))"), F.lit(1))) if pairs else F.lit(0)
    return {
        "chars": n, "changes": (F.length(F.regexp_replace(classes, "[^aB0]+", "-")) - 1).cast("double"),
        "distinct_ratio": F.size(F.array_distinct(F.split(token, ""))) / n, "digit_ratio": 1 - rest(token, "[0-9]") / n,
        "coverage": 1 - rest(F.lower(token), "|".join(sorted(words, key=len, reverse=True))) / n if words else F.lit(0.0), "pairs": held / n, "n_path": n - rest(token, "[/.=]"), "n_upper": n - rest(token, "[A-Z]"),
        "named": F.lower(before).rlike("|".join(NAMING)).cast("double"), "assigned": F.rlike(before, F.lit(r"[=:]\s*[\"']?$")).cast("double"),
        "quoted": (F.rlike(before, F.lit("[\"']$")) & F.rlike(after, F.lit("^[\"']"))).cast("double"),
    }


def findings(docs: DataFrame) -> DataFrame:
    """One row a candidate: before, token, after."""
    return docs.select(F.explode(candidates(F.col("text"))).alias("c")).select("c.*")


@dataclass
class Detector:
    """A fitted forest and the words that its coverage is measured by."""

    score: Scorer
    words: Sequence[str]

    def judge(self, c: Column) -> Column:
        return F.struct(c["before"], c["token"], c["after"], self.score(features(c["before"], c["token"], c["after"], self.words)).alias("score"))


def train(labelled: DataFrame, words: Sequence[str] = (), max_labelled: int = 20_000, trees: int = 20, depth: int = 6) -> Detector:
    """labelled: before, token, after, label."""
    sample = bounded_sample(labelled.filter("label is not null"), "token", max_labelled)
    seen = features(F.col("before"), F.col("token"), F.col("after"), words)
    return Detector(fit(sample.select(*[seen[f].alias(f) for f in FEATURES], "label"), FEATURES, "forest", trees, depth), words)


def _scanned(docs: DataFrame, detector: Detector, threshold: float) -> DataFrame:
    """Boxed documents with __places (candidates with scores) and __redacted."""
    out = boxed(docs, "text").withColumn("__places", F.transform(candidates(F.col("text")), detector.judge))
    found = F.array_distinct(F.filter("__places", lambda c: c["score"] >= threshold)["token"])

    def redacted(tokens: Column, parts: Column) -> Column:
        kept = F.transform(tokens, lambda t, i: F.concat(F.get(parts, i), F.when(F.array_contains("__found", t), F.lit(PLACEHOLDER)).otherwise(t)))
        return F.concat(F.array_join(kept, ""), F.element_at(parts, -1))

    return out.withColumn("__found", found).withColumn("__redacted", F.when(F.size("__found") > 0, _with_tokens(F.col("text"), redacted)).otherwise(F.col("text")))


def scan(docs: DataFrame, detector: Detector, threshold: float = 0.5) -> DataFrame:
    """Adds n_candidates, secrets (array of struct before, token, after, score; one a place) and
    redacted."""
    secrets = F.filter("__places", lambda c: F.array_contains("__found", c["token"]))
    return unboxed(_scanned(docs, detector, threshold), docs.columns, n_candidates=F.size("__places").cast("long"), secrets=secrets, redacted=F.col("__redacted"))


def redact(docs: DataFrame, detector: Detector, threshold: float = 0.5) -> DataFrame:
    """docs with secrets in ``text`` replaced and ``n_chars``, if there is one, kept right."""
    changed = F.size("__found") > 0
    results = {"text": F.col("__redacted")}
    if "n_chars" in docs.columns:
        results["n_chars"] = F.when(changed, F.length("__redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return unboxed(_scanned(docs, detector, threshold), docs.columns, **results).select(*[F.col(f"`{c}`") for c in docs.columns])


def planted_findings(docs: DataFrame) -> DataFrame:
    """Labelled findings (before, token, after, label) for tables that have none: in words of the
    documents stand secrets of known kinds, some without a name, and what is often taken for
    one: card numbers, checksums and ids given to names, paths, long words with a year."""
    text = F.col("text")
    at = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 2 * NEAR, F.lit(1))).cast("int") + 1
    h = F.sha2(F.xxhash64(text, F.lit("secret")).cast("string"), 512)
    rows = docs.filter(F.length(text) >= 2 * NEAR).select(
        F.regexp_replace(F.substr(text, at, F.lit(NEAR)), r"\S*$", "").alias("l"), F.regexp_replace(F.substr(text, at + NEAR, F.lit(NEAR)), r"^\S*", "").alias("r"),
        h.alias("h"), F.translate(h, "abcdef", "012345").alias("d"), F.translate(F.base64(F.unhex(h)), "+/=", "xyz").alias("b"), F.filter(F.split(F.regexp_replace(F.substr(text, at, F.lit(200)), "[^A-Za-z]+", " "), " "), lambda w: F.length(w) > 2).alias("w"),
    ).filter(F.size("w") > 6)
    part = lambda c, a, n: F.substring(c, a, n)
    w = lambda i: F.get("w", F.lit(i))
    quoted, line = F.lit('"'), F.lit("")
    kinds = [
        (1, 'token = "', part("h", 1, 40), quoted), (1, "", part("h", 3, 40), line), (1, "api_key: ", F.concat(F.lit("AK"), F.upper(part("h", 7, 18))), line), (1, "password=", part("b", 1, 24), line),
        (1, "Bearer ", part("b", 9, 48), line), (1, "", F.concat(part("b", 5, 12), F.lit("-"), part("b", 20, 20)), line), (1, 'SECRET = "', F.upper(part("h", 11, 40)), quoted), (1, "", part("h", 20, 32), line),
        (0, "", part("d", 1, 16), line), (0, 'id = "', part("d", 20, 18), quoted), (0, "token ", part("d", 9, 16), line), (0, "card: ", part("d", 40, 16), line),
        (0, 'sha1 = "', part("h", 1, 40), quoted), (0, "md5: ", part("h", 9, 32), line), (0, "", F.concat(F.lit("/"), w(0), F.lit("/"), w(1), F.lit("/v2/"), w(2), F.lit("-"), part("d", 1, 2)), line),
        (0, 'secret = "', F.concat(w(3), F.lit("-"), w(4), F.lit("-"), w(5), F.lit("-20"), part("d", 3, 2)), quoted), (0, "", F.concat(w(1), w(2), w(3), w(4), part("d", 5, 1)), line), (0, "token = /", F.concat(w(5), F.lit("/"), w(0), F.lit("/"), w(4), F.lit("/"), part("d", 7, 4)), line),
    ]
    made = F.array(*[F.struct(F.concat("l", F.lit(b)).alias("before"), t.alias("token"), F.concat(a, "r").alias("after"), F.lit(y).alias("label")) for y, b, t, a in kinds])
    return rows.select(F.explode(made).alias("f")).select("f.*").filter(F.length("token") >= 16)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(planted_findings(docs), common_words(docs)))
    return out.select("doc_id", "n_candidates", F.size(F.array_distinct("secrets.token")).cast("long").alias("n_secrets"), F.array_join(F.array_distinct("secrets.token"), ",").alias("secrets"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))
