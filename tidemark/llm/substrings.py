"""Substring dedup by words: seed and extend. A word goes if a 50-word window over it also
stands in a document of smaller id.

1. Seeds: of the 41 ten-word grams of each 50-word window the one of smallest hash (the first
   of equals) owns the window, so equal windows have equal seeds at equal places, and each
   window has one. A seed's context is all windows that it owns there, at most 90 words.
2. Documents are joined on seeds. Seeds are first extended both ways at once, over the whole
   context: equal contexts match in all their windows, whatever their number.
3. Where a seed stands in different contexts of different documents, one copy of each context is
   extended by every division of the 40 missing words between its two sides. Each is one window;
   the smallest document of each window is found by its hash, summed in the map tasks first.
   Pairs of documents are never made, and no group is collected.
4. Matched windows that overlap in a document make its maximal repeats; those words go.

Words and windows are equal if their 64-bit hashes are. Long texts are taken in pieces of 2^22
words that overlap by a window. Defined cases: a null text has no words; a document without
an id, or of fewer than 50 words, stays whole; documents of equal id don't remove each other's words;
equal rows are treated alike; further columns stay, but those named like the results are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Hashes, hash_powers, sliding_min
from .common import bloom, boxed, by_chars, in_bloom, release_memory, small_batches, table, unboxed, written
from .words import GAP, PIECE, utf8, word_pieces

LENGTH, GRAM = 50, 10
PIECE_WORDS = 1 << 22
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.uint64((1 << 24) - 1)


class Stretches(Hashes):
    """Hashes of any stretch of a sequence of words, given by their own hashes."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = hash_powers(1 << max(16, len(words).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)])])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts in order, and the number of words of each text."""
    data = b" ".join([*texts, b""])
    flat = np.frombuffer(data, np.uint8)
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(flat):
        gap = GAP.search(data, at + PIECE) if at + PIECE < len(flat) else None
        end = gap.start() if gap else len(flat)
        blank = _SEPARATOR[flat[at:end]]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts = np.flatnonzero(edge == -1)
        hashes.append(Hashes(flat[at:end]).of(starts, np.flatnonzero(edge == 1)))
        begins.append(starts + at)
        at = end
    limits = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), limits), prepend=0)


def seeds(words: np.ndarray, counts: np.ndarray, piece: int = PIECE_WORDS) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, seed, context, lo, hi, windows) of texts' words: the seeds, the hashes of
    their contexts, where these stand in the text, and a lookup of the hashes of all windows."""
    begins = np.cumsum(counts) - counts
    for a in range(0, max(len(words) - LENGTH, 0) + 1, piece):
        part = words[a : a + piece + LENGTH - 1]
        if len(part) < LENGTH:
            return
        held = Stretches(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = held.of(at, at + GRAM)
        owner = (sliding_min((gram & ~_PLACE) | at.astype(np.uint64), LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(owner))
        text = np.searchsorted(begins, start + a, side="right") - 1
        start = start[start + a + LENGTH <= (begins + counts)[text]]  # windows within one text
        if not len(start):
            continue
        own = owner[start]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        lo, hi, place = start[new], start[np.concatenate([new[1:], [True]])] + LENGTH, own[new]
        context = held.of(lo, hi) + ((place - lo) * 1000 + hi - place).astype(np.uint64)
        number = text[lo]
        yield number, gram[place].view(np.int64), context.view(np.int64), lo + a - begins[number], hi + a - begins[number], lambda i, lo=lo, hi=hi, held=held: held.of(s := np.arange(lo[i], hi[i] - LENGTH + 1), s + LENGTH).view(np.int64)


def occurrences(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, text) to seed, context, key, doc_id, lo, hi: where contexts stand."""
    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in by_chars(part):
                keys, ids = some["key"].to_numpy(), some["doc_id"].to_numpy()
                for number, seed, context, lo, hi, _ in seeds(*word_hashes([utf8(t) for t in some["text"]])):
                    yield pd.DataFrame({"seed": seed, "context": context, "key": keys[number], "doc_id": ids[number], "lo": lo, "hi": hi})
        release_memory()

    return keyed.select("key", "doc_id", "text").mapInPandas(found, "seed long, context long, key long, doc_id long, lo long, hi long")


def extended(contexts: DataFrame, keyed: DataFrame) -> DataFrame:
    """seed, context, doc_id and the hashes of its windows, in order. contexts: seed, context and
    the key of a text in which the context stands."""
    def windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in by_chars(part):
                wanted = [set(zip(s.tolist(), c.tolist(), strict=True)) for s, c in zip(some["seeds"], some["contexts"], strict=True)]
                ids = some["doc_id"].tolist()
                for number, seed, context, _, _, hashes in seeds(*word_hashes([utf8(t) for t in some["text"]])):
                    rows = []
                    for i, (k, s, c) in enumerate(zip(number.tolist(), seed.tolist(), context.tolist(), strict=True)):
                        if (s, c) in wanted[k]:
                            wanted[k].remove((s, c))
                            rows.append((s, c, ids[k], hashes(i)))
                    yield pd.DataFrame(rows, columns=["seed", "context", "doc_id", "windows"])
        release_memory()

    per_text = written(contexts.groupBy("key").agg(F.collect_list("seed").alias("seeds"), F.collect_list("context").alias("contexts")), "wanted")
    texts = in_bloom(keyed, "key", bloom(per_text, "key")).dropDuplicates(["key"])
    return texts.join(per_text, "key").drop("key").mapInPandas(windows, "seed long, context long, doc_id long, windows array<long>")


def repeats(keyed: DataFrame) -> DataFrame:
    """key, and the repeats of its text in documents of smaller id: an array of lo, hi and, if only
    some of the windows from lo on match, which of them. keyed: key (of id and text), doc_id, text."""
    found = written(occurrences(keyed), "seeds")
    at = ["seed", "context"]
    contexts = written(found.groupBy(*at).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("key", "doc_id").alias("key")), "contexts")
    differ = contexts.groupBy("seed").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high")).filter("n > 1 and low < high")
    grown = written(extended(contexts.join(differ.select("seed"), "seed").select(*at, "key"), keyed), "windows")
    window = grown.select(*at, "doc_id", F.posexplode("windows").alias("at", "window"))
    shared = window.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("window", "low")
    matched = window.join(shared, "window").filter("low < doc_id").groupBy(*at).agg(F.sort_array(F.collect_list("at")).alias("some"))
    # a table, so that the join below is of two shuffles, of which Spark splits large partitions
    matching = written(contexts.select(*at, "first", "last").join(matched, at, "left").filter("first < last or some is not null"), "matching")
    whole = F.col("doc_id") > F.col("first")
    hits = found.join(matching, at).filter(whole | F.col("some").isNotNull()).select("key", "lo", "hi", F.when(~whole, F.col("some")).alias("some"))
    return hits.groupBy("key").agg(F.collect_set(F.struct("lo", "hi", "some")).alias("repeats"))


def _cut(text: str | None, found: np.ndarray | None) -> tuple[int, int, str]:
    data = utf8(text)
    if found is None or not len(found):
        n, kept = 0, []
        for words in word_pieces(data):
            n += len(words)
            kept.append(b" ".join(words))
        return n, 0, b" ".join(kept).decode()
    gone = np.zeros(max(x["hi"] for x in found), bool)
    for x in found:
        if x["some"] is None:
            gone[x["lo"] : x["hi"]] = True
        else:
            for s in x["some"]:
                gone[x["lo"] + s : x["lo"] + s + LENGTH] = True
    n, kept = 0, []
    for words in word_pieces(data):
        out = gone[n : n + len(words)].tolist()
        kept += [w for w, x in zip(words, out + [False] * (len(words) - len(out)), strict=True) if not x]
        n += len(words)
    return n, int(gone.sum()), b" ".join(kept).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, further columns) with n_words, n_removed and kept, the remaining words
    joined by a space."""
    small_batches(docs.sparkSession, 500)
    keyed = boxed(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    found = written(repeats(keyed.filter("doc_id is not null").select("key", F.col("doc_id").cast("long").alias("doc_id"), "text")), "repeats")
    pages = bloom(found, "key")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            yield pd.DataFrame([_cut(t, x) for t, x in zip(texts, spans, strict=True)], columns=["n_words", "n_removed", "kept"])

    none = F.lit(None).cast(found.schema["repeats"].dataType)
    touched = in_bloom(keyed, "key", pages).join(found, "key", "left")
    rest = in_bloom(keyed, "key", pages, inside=False).withColumn("repeats", none)
    out = touched.unionByName(rest).withColumn("m", cut("text", "repeats"))
    return unboxed(out, docs.columns, n_words=F.col("m.n_words"), n_removed=F.col("m.n_removed"), kept=F.col("m.kept"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, unnest(range(1, len(words) - 48)) as s, words from d where len(words) >= 50),
k as (select doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) as k from w),
c as (select doc_id, s from k qualify min(doc_id) over (partition by k) < doc_id),
g as (select distinct doc_id, unnest(range(s, s + 50)) as p from c),
p as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from d),
r as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from p anti join g using (doc_id, p) group by doc_id)
select d.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)
"""
