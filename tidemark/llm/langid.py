"""Language ID: interpolated Kneser-Ney character 4-gram models, one per language.

Counts of all labelled training texts are summed by Spark, and the models are computed from
all of them in groups of n-grams that share their contexts: 4- and 3-grams by the two
characters in the middle, 2-grams by their first. The groups are broadcast in blocks of about
``BLOCK_BYTES`` as sorted hash arrays shared by the languages: one lookup gives a row of log
probabilities. A worker holds one block at a time, if there are several. A text's language is the one of the lowest
cross-entropy a character. A text whose cross-entropy lies far above what the language's own
training texts have, for its length, isn't accepted; the thresholds are mean and deviation
over all distinct training texts of at least ``LIMIT_CHARS`` characters. A language without
such a text gets the common limit, that of all languages' texts together (of any length, if
none is long enough; nothing is rejected if none has a letter); one with a single such text
gets the common limit or its own, whichever accepts more.

Defined cases: a null text or one without a letter is ``und`` with score 0 and not accepted;
equal texts are judged alike, ties go to the first language in order; without any training
text everything is ``und``; further columns stay, but those named like the results are
replaced (``accepted_only`` keeps all as they are); an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, by_chars, release_memory, small_batches, table, unboxed, written

ORDER = 4
BLOCK_BYTES = 64 << 20
GROUP_VALUES = 1_000_000
LIMIT_CHARS = 100
JUDGED_CHARS = 200_000  # looked up at once
DISCOUNT = 0.75
UNKNOWN = "und"
_LETTER = re.compile("[A-Za-zà-öø-ÿ]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = [np.uint64((1 << 16 * k) - 1) for k in range(5)]
#: Code points that count as a space: ASCII and Latin-1 signs, general punctuation.
_SPACE = np.zeros(1 << 16, bool)
_SPACE[[c for c in range(0xC0) if not chr(c).isalpha()]] = True
_SPACE[[0xD7, 0xF7, *range(0x2000, 0x2070)]] = True


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 4-grams of each text (16 bits a code point, the last one predicted), and
    where each text's begin. Case is folded, everything but letters is a space, once. Code
    points beyond 16 bits share the numbers of the private use area."""
    each = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    pad = np.zeros(ORDER - 1, np.uint32)
    flat = np.concatenate([x for e in each for x in (pad, e)]) if each else pad
    flat = np.where(flat > 0xFFFF, 0xE000 + flat % 0x1900, flat).astype(np.uint64)
    real = np.ones(len(flat), bool)
    at = 0
    starts = np.cumsum([0, *(len(e) + ORDER - 1 for e in each)])[:-1]
    for k in range(ORDER - 1):
        real[starts + k] = False
    space = _SPACE[flat] & real
    flat[space] = 32
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    flat, real = flat[keep], real[keep]
    at = (np.cumsum(keep) - 1)[starts]
    keys = flat.copy()
    for k in range(1, ORDER):
        keys[k:] |= flat[:-k] << np.uint64(16 * k)
    begins = (np.cumsum(real) - real)[at]
    return keys[real], begins


class HashTable:
    """Rows by key: sorted hashes, with the first place of each leading bit pattern."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = keys * _MIX
        order = np.argsort(h)
        self.hashes, self.rows = h[order], rows[order]
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where a key isn't there."""
        h = keys * _MIX
        b = (h >> self.shift).astype(np.int64)
        at, end = self.first[b], self.first[b + 1]
        out = np.full(len(keys), -1, np.int32)
        live = np.nonzero(at < end)[0]
        at = at[live]
        while len(live):
            hit = self.hashes[at] == h[live]
            out[live[hit]] = at[hit]
            live, at = live[~hit], at[~hit] + 1
            ok = at < end[live]
            live, at = live[ok], at[ok]
        return out


def _order(lang: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_langs: int) -> tuple:
    """Interpolated Kneser-Ney estimates of one order from n-gram counts, all of each context:
    distinct keys, their discounted shares, contexts, and what each leaves to the lower order
    (all, where it is unseen); a column a language."""
    seen, contexts = np.unique(keys), np.unique(keys >> np.uint64(16))
    share, weight = np.zeros((len(seen), n_langs)), np.ones((len(contexts), n_langs))
    for k in np.unique(lang):
        own, n = keys[lang == k], counts[lang == k].astype(float)
        context, at, kinds = np.unique(own >> np.uint64(16), return_inverse=True, return_counts=True)
        total = np.bincount(at, n)
        share[np.searchsorted(seen, own), k] = np.maximum(n - DISCOUNT, 0) / total[at]
        weight[np.searchsorted(contexts, context), k] = np.minimum(DISCOUNT * kinds / total, 1.0)
    return seen, share, contexts, weight


def _logs(order: tuple, lower: np.ndarray) -> tuple[list, np.ndarray]:
    """[keys, log probabilities, contexts, log weights] and the probabilities, from an order's
    estimates and the lower order's probabilities of its keys."""
    keys, share, contexts, weight = order
    prob = share + weight[np.searchsorted(contexts, keys >> np.uint64(16))] * lower
    return [keys, np.log(prob).astype(np.float32), contexts, np.log(weight).astype(np.float32)], prob


class Blocks:
    """Tables by group, several groups to a broadcast block."""

    def __init__(self, groups: int, block_of: np.ndarray, shared: list):
        self.groups, self.block_of, self.shared = groups, block_of, shared

    def each(self, by: np.ndarray) -> Iterator[tuple[np.ndarray, list]]:
        """Places in ``by`` (what groups go by), and the tables they belong to. Places of a
        group without any table don't come."""
        block = self.block_of[(by % np.uint64(self.groups)).astype(np.int64)]
        for b, held in enumerate(self.shared):
            at = np.nonzero(block == b)[0]
            if len(at):
                yield at, held.value
                if len(self.shared) > 1 and hasattr(held, "_value"):
                    del held._value  # the next one takes its room


def _tables(arrays: list) -> list:
    return [HashTable(k, v) for k, v in zip(arrays[::2], arrays[1::2], strict=True)]


def _prime(least: int) -> int:
    while any(least % d == 0 for d in range(2, int(least**0.5) + 1)):
        least += 1
    return least


def _group_count(rows: int, n_langs: int) -> int:
    return _prime(max(31, rows * n_langs // GROUP_VALUES))


def _in_blocks(counts: DataFrame, by: Column, groups: int, build, langs: list[str], block_bytes: int) -> Blocks:
    """counts (lang, key, n) to Blocks of what ``build`` makes of a group's language numbers,
    keys and counts: arrays, keys and rows by turns."""
    number = {lang: k for k, lang in enumerate(langs)}

    def built(part: pd.DataFrame) -> pd.DataFrame:
        arrays = build(part["lang"].map(number).to_numpy(), part["key"].to_numpy().view(np.uint64), part["n"].to_numpy())
        return pd.DataFrame({"g": [part["g"].iloc[0]], "size": [sum(a.nbytes for a in arrays)], "arrays": [pickle.dumps(arrays)]})

    made = written(counts.withColumn("g", by % groups).groupBy("g").applyInPandas(built, "g long, size long, arrays binary"), "model")
    block_of, cuts, filled = np.full(groups, -1), [], block_bytes
    for g, size in sorted(map(tuple, made.select("g", "size").collect())):
        if filled + size > block_bytes:
            cuts.append(g)
            filled = 0
        filled += size
        block_of[g] = len(cuts) - 1
    shared = []
    for low, high in zip(cuts, [*cuts[1:], groups], strict=True):
        held = [pickle.loads(r["arrays"]) for r in made.filter((F.col("g") >= low) & (F.col("g") < high)).select("arrays").collect()]
        shared.append(counts.sparkSession.sparkContext.broadcast(_tables([np.concatenate(x) for x in zip(*held, strict=True)])))
    return Blocks(groups, block_of, shared)


class LanguageModels:
    """All languages' models: log probability rows of every n-gram seen in any of them, and
    the rows of the contexts' back-off weights. ``first`` is the 1-grams' table (characters),
    ``second`` the 2-grams' blocks, ``upper`` the 4- and 3-grams'."""

    def __init__(self, counts: DataFrame, block_bytes: int = BLOCK_BYTES):
        masked = lambda df, n: df.select("lang", F.col("key").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("key"))
        # continuation counts: distinct characters before
        pairs = written(masked(masked(counts, 3).distinct(), 2).groupBy("lang", "key").agg(F.count("*").alias("n")), "pairs")
        chars = masked(pairs, 1).groupBy("lang", "key").agg(F.count("*").alias("n")).toPandas()
        sizes = [df.count() for df in (counts, pairs)]
        self.langs = langs = sorted(chars["lang"].unique())
        number = {lang: k for k, lang in enumerate(langs)}
        lang = chars["lang"].map(number).to_numpy()
        self.floor = floor = 1.0 / (np.bincount(lang) + 1)
        first, _ = _logs(_order(lang, chars["key"].to_numpy().view(np.uint64), chars["n"].to_numpy(), len(langs)), floor)
        self.first = counts.sparkSession.sparkContext.broadcast(_tables(first))
        self.upper = self.second = None
        self.limits: np.ndarray | None = None
        at = self  # what the tasks take along: the tables so far

        def second(lang: np.ndarray, keys: np.ndarray, n: np.ndarray) -> list:
            order = _order(lang, keys, n, len(langs))
            return _logs(order, np.exp(at.log_first(order[0]).astype(float)))[0]

        def upper(lang: np.ndarray, keys: np.ndarray, n: np.ndarray) -> list:
            four = _order(lang, keys, n, len(langs))
            kinds = [(np.full(len(u), k), u, c) for k in np.unique(lang) for u, c in [np.unique(keys[lang == k] & _MASK[3], return_counts=True)]]
            three = _order(*map(np.concatenate, zip(*kinds, strict=True)), len(langs))
            low, prob = _logs(three, np.exp(at.log_second(three[0]).astype(float)))
            return _logs(four, prob[np.searchsorted(three[0], four[0] & _MASK[3])])[0] + low

        self.second = _in_blocks(pairs, F.shiftrightunsigned("key", 16), _group_count(sizes[1], len(langs)), second, langs, block_bytes)
        middle = F.shiftrightunsigned("key", 16).bitwiseAND(F.lit((1 << 32) - 1))
        self.upper = _in_blocks(counts, middle, _group_count(sizes[0], len(langs)), upper, langs, block_bytes)

    def log_first(self, keys: np.ndarray) -> np.ndarray:
        table, left = self.first.value
        at = table.find(keys & _MASK[1])
        out = table.rows[at]
        out[at < 0] = left.rows[0] + np.log(self.floor).astype(np.float32)
        return out

    def log_second(self, keys: np.ndarray) -> np.ndarray:
        """Of 2-grams (the last two characters of each key)."""
        keys = keys & _MASK[2]
        out = np.empty((len(keys), len(self.langs)), np.float32)
        open_ = np.ones(len(keys), bool)
        for at, (table, left) in self.second.each(keys >> np.uint64(16)):
            row = table.find(keys[at])
            out[at] = table.rows[row]
            open_[at] = False
            _miss(out, at[row < 0], left, keys >> np.uint64(16), lambda k: self.log_first(keys[k]))
        rest = np.nonzero(open_)[0]
        out[rest] = self.log_first(keys[rest])
        return out

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """A row for each 4-gram; where it is unseen, the weight of its context and the row of
        the next shorter one."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        short = np.ones(len(keys), bool)
        for at, (four, left4, three, left3) in self.upper.each((keys >> np.uint64(16)) & _MASK[2]):
            row = four.find(keys[at])
            out[at] = four.rows[row]
            short[at] = False
            miss = at[row < 0]

            def shorter(k: np.ndarray) -> np.ndarray:
                row = three.find(keys[k] & _MASK[3])  # noqa: B023
                low = three.rows[row]  # noqa: B023
                gone = row < 0
                low[gone] = 0
                short[k[gone]] = True
                context = left3.find((keys[k[gone]] >> np.uint64(16)) & _MASK[2])  # noqa: B023
                low[np.nonzero(gone)[0][context >= 0]] = left3.rows[context[context >= 0]]  # noqa: B023
                return low

            _miss(out, miss, left4, keys >> np.uint64(16), shorter)
        rest = np.nonzero(short)[0]
        if len(rest):
            out[rest] += self.log_second(keys[rest])
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character (nats) under each language, and the characters."""
        keys, begins = grams(texts)
        sizes = np.diff([*begins, len(keys)])
        sums = np.add.reduceat(self.log_probs(keys).astype(np.float64), begins, axis=0) if len(keys) else np.zeros((len(texts), len(self.langs)))
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def _miss(out: np.ndarray, at: np.ndarray, left: HashTable, contexts: np.ndarray, lower) -> None:
    """Fills rows ``at``: the lower order's, and the context's weight where it is seen."""
    if len(at):
        out[at] = lower(at)
        context = left.find(contexts[at])
        out[at[context >= 0]] += left.rows[context[context >= 0]]


def count_grams(labelled: DataFrame) -> DataFrame:
    """(text, lang) to lang, key, n over all texts; each task adds up its own first."""
    small_batches(labelled.sparkSession)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for part in parts:
            for piece in by_chars(part):
                for lang, texts in piece.groupby("lang")["text"]:
                    mine = held.setdefault(lang, [])
                    mine.append(np.unique(grams(texts.tolist())[0], return_counts=True))
                    if len(mine) > 16:
                        mine[:] = [_added(mine)]
                        if len(mine[0][0]) > 500_000:
                            yield _counted(lang, mine.pop())
        for lang, mine in held.items():
            if mine:
                yield _counted(lang, _added(mine))
        held.clear()
        release_memory()

    return labelled.select("text", "lang").mapInPandas(counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _counted(lang: str, counts: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "key": counts[0].view(np.int64), "n": counts[1]})


def train(labelled: DataFrame, block_bytes: int = BLOCK_BYTES) -> LanguageModels | None:
    """labelled: text, lang. None if there is nothing to learn from."""
    labelled = labelled.filter("lang is not null and text is not null and text <> ''").select("text", "lang")
    counts = written(count_grams(labelled), "grams")
    if counts.isEmpty():
        return None
    models = LanguageModels(counts, block_bytes)
    models.limits = _limits(models, labelled)
    return models


def _limits(models: LanguageModels, labelled: DataFrame, z: float = 8.0) -> np.ndarray:
    """For each language mean and deviation of the cross-entropy of its own texts, z times;
    copies of a text count once."""
    known = with_entropies(labelled, models).filter("e.chars > 0").select("lang", F.sha2("text", 256).alias("digest"), "e.entropy", (F.col("e.chars") >= LIMIT_CHARS).alias("long"))
    each = known.groupBy("lang", "digest", "long").agg(F.min("entropy").alias("entropy"))
    seen = each.groupBy("long", "lang").agg(F.count("*").alias("n"), F.sum("entropy").alias("s"), F.sum(F.col("entropy") * F.col("entropy")).alias("q")).toPandas().sort_values("lang")

    def limit(rows: pd.DataFrame) -> tuple[float, float]:
        n, s, q = (float(rows[c].sum()) for c in "nsq")
        return (s / n, z * max(np.sqrt(max(q / n - (s / n) ** 2, 0.0)), 0.1)) if n else (np.inf, 0.0)

    enough = seen[seen["long"].astype(bool)]
    common = limit(enough if len(enough) else seen)
    out = []
    for lang in models.langs:
        own = enough[enough["lang"] == lang]
        out.append(limit(own) if own["n"].sum() > 1 else max(common, limit(own), key=sum) if len(own) else common)
    return np.array(out)


def with_entropies(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """Adds e: lang, entropy, chars, score, accepted of every whole text."""
    small_batches(docs.sparkSession)
    @F.pandas_udf("lang_pred string, entropy double, chars long, score double, accepted boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = models
        for batch in batches:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "entropy": np.nan, "chars": 0, "score": 0.0, "accepted": False}, index=range(len(batch)))
            known = pd.DataFrame({"at": np.arange(len(batch)), "text": batch.to_numpy()})[[has_letter(t) for t in batch]]
            for part in by_chars(known, limit=JUDGED_CHARS):
                each, sizes = m.entropies(part["text"].tolist())
                best = each.argmin(axis=1)
                low = each[np.arange(len(each)), best]
                share = 1 / np.exp(-(each - low[:, None]) * np.minimum(sizes, 200)[:, None]).sum(axis=1)
                ok = np.ones(len(low), bool) if m.limits is None else low <= m.limits[best, 0] + m.limits[best, 1] + 20 / np.sqrt(sizes)
                out.loc[part["at"], :] = pd.DataFrame({"lang_pred": [m.langs[b] for b in best], "entropy": low, "chars": sizes, "score": share, "accepted": ok}).to_numpy()
            yield out.astype({"entropy": float, "chars": "int64", "score": float, "accepted": bool})
        release_memory()

    return docs.withColumn("e", judge("text"))


def identify(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """Adds lang_pred, score and accepted."""
    if models is None:
        return unboxed(boxed(docs), docs.columns, lang_pred=F.lit(UNKNOWN), score=F.lit(0.0), accepted=F.lit(False))
    return unboxed(with_entropies(boxed(docs, "text"), models), docs.columns, lang_pred=F.col("e.lang_pred"), score=F.col("e.score"), accepted=F.col("e.accepted"))


def accepted_only(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The documents that the models accept, with their own columns."""
    return unboxed(with_entropies(boxed(docs, "text"), models).filter("e.accepted"), docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents; those without an id belong to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
