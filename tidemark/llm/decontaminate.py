"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Every window of
ten consecutive words of a benchmark item (all of a shorter item) goes into sorted hash
arrays; a window of a document found there is compared word by word before it counts. A window
takes 20 bytes, a distinct word about 150. A benchmark of more than ``block_bytes`` is passed in
blocks, each broadcast alone; each pass is written to the shared folder, so that one block at a
time is held.

Defined cases: null texts have no words; a null item id counts as an empty one; items with
equal ids count once; repeated documents are judged alike; further columns stay (one named
``contamination`` is replaced by ``with_contamination``, kept by ``decontaminate``); empty
tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import boxed, small_batches, table, unboxed, written

WINDOW = 10
BLOCK_BYTES = 4 << 20
RESULT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of UTF-8: A-Z to a-z, other ASCII that is in no word to a space.
_MAP = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_FACTORS = np.random.default_rng(11).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_MAP).split() if text else []


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Of every window of ``size`` word numbers."""
    n = len(ids) - size + 1
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return sum((x[j : j + n] * _FACTORS[j] for j in range(size)), np.zeros(n, np.uint64))


class WindowSet:
    """The windows of some items, by length, without an object a window: the word numbers of all
    items in one array; per length the sorted hashes, of each the place of its words and the items
    that have it."""

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        parts, at, found = [], 0, defaultdict(list)
        for k, (name, text) in enumerate(items):
            self.names.append(name)
            words = words_of(text)
            ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in words), np.int32, len(words))
            if size := min(WINDOW, len(ids)):
                found[size].append((k, at, len(ids) - size + 1))
                parts.append(ids)
                at += len(ids)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.sizes = {size: self._sorted(size, runs) for size, runs in found.items()}

    def _sorted(self, size: int, runs: list[tuple[int, int, int]]):
        n = sum(r[2] for r in runs)
        h, place, owner = np.empty(n, np.uint64), np.empty(n, np.int32), np.empty(n, np.int32)
        i = 0
        for k, at, m in runs:
            h[i : i + m] = _hashes(self.words[at : at + m + size - 1], size)
            place[i : i + m] = np.arange(at, at + m, dtype=np.int32)
            owner[i : i + m] = k
            i += m
        order = np.lexsort((owner, h)).astype(np.int32)
        h, place, owner = h[order], place[order], owner[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = place[new][np.cumsum(new, dtype=np.int32) - 1]
        differ = np.zeros(n, bool)  # other words of the same hash
        for j in range(size):
            differ |= self.words[first + j] != self.words[place + j]
        others = defaultdict(set)
        for x in np.nonzero(differ)[0].tolist():
            others[tuple(self.words[place[x] : place[x] + size].tolist())].add(int(owner[x]))
        keep = ~differ & (new | np.concatenate([[True], owner[1:] != owner[:-1]]))
        h, place, owner = h[keep], place[keep], owner[keep]
        begin = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0].astype(np.int32)
        return h[begin], place[begin], np.append(begin, np.int32(len(h))), owner, dict(others)

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document the merged word spans that windows cover, and the items hit."""
        get, out = self.vocab.get, []
        flat = np.fromiter((x for words in docs for x in (*(get(w, -1) for w in words), -1)), np.int32)
        ends = np.cumsum([len(w) + 1 for w in docs]) if docs else np.zeros(0, np.int64)
        bad = np.concatenate([[0], np.cumsum(flat < 0)])
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        for size, (known, place, begin, owner, others) in self.sizes.items():
            at = np.nonzero(bad[size:] == bad[:-size])[0] if len(flat) >= size else np.zeros(0, np.int64)
            if not len(at):
                continue
            h = _hashes(flat, size)[at]
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at, k = at[(ok := known[k] == h)], k[ok]
            same = np.ones(len(at), bool)
            for j in range(size):
                same &= flat[at + j] == self.words[place[k] + j]
            hit, doc = same.copy(), np.searchsorted(ends, at, side="right")
            if others:
                for x in range(len(at)):
                    if more := others.get(tuple(flat[at[x] : at[x] + size].tolist())):
                        hit[x] = True
                        items[int(doc[x])] |= more
            base = ends[doc] - np.array([len(w) + 1 for w in docs])[doc] if len(at) else at
            for i, d in zip((at - base)[hit].tolist(), doc[hit].tolist(), strict=True):
                spans[d].append((i, i + size))
            for d, g in set(zip(doc[same].tolist(), k[same].tolist(), strict=True)):
                items[d].update(owner[begin[g] : begin[g + 1]].tolist())
        for d in range(len(docs)):
            out.append((merge_spans(spans[d]), {self.names[x] for x in items[d]}) if d in spans else ([], set()))
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(known):
    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            words = [words_of(t) for t in texts]
            rows = []
            for w, (spans, found), s, i in zip(words, known.value.scan(words), before["spans"], before["items"], strict=True):
                if s is not None:
                    spans, found = merge_spans(spans + [(x["start"], x["end"]) for x in s]), found | set(i)
                rows.append((len(w), [{"start": a, "end": e} for a, e in spans], sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan


def _judged(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """Boxed documents with __found."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count("*")).first()[0]
    blocks = max(1, -(-total // block_bytes))
    empty = F.lit(None).cast(f"struct<{RESULT.replace(' long', ':long').replace('spans ', 'spans:').replace('items ', 'items:')}>")
    out = boxed(docs, "text").withColumn("__found", empty)
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast(WindowSet(tuple(r) for r in part.toLocalIterator()))
        out = out.withColumn("__found", _scanner(known)(F.col("text"), F.col("__found")))
        if blocks > 1:
            out = written(out, "contamination")
            known.destroy()
    return out


def with_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, ...) and benchmark (item_id, text) to docs with contamination: n_words,
    the merged word spans hit, the ids of the items whose windows occur."""
    return unboxed(_judged(docs, benchmark, block_bytes), docs.columns, contamination=F.col("__found"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the spans."""
    def one(text, found):
        if text is None or found is None or not len(found):
            return text
        at, kept, words = 0, [], list(WORD.finditer(text))
        for x in found:
            kept.append(text[at : words[x["start"]].start()])
            at = words[x["end"] - 1].end()
        return "".join(kept) + text[at:]

    return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents, or the spans, that hold a benchmark window."""
    judged = _judged(docs, benchmark, block_bytes)
    if remove == "documents":
        return unboxed(judged.filter(F.size("__found.spans") == 0), docs.columns)
    return unboxed(judged, docs.columns, text=_without("text", "__found.spans")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = judged.select("doc_id", "contamination.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return c.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
with b as (select cast(item_id as varchar) as item, {_WORDS_SQL} as w from benchmark),
bw as (select distinct item, least(10, len(w)) as size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS_SQL} as w from documents),
s as (select distinct size from bw),
dw as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as win from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, s where len(w) >= size)),
h as (select doc_id, i, dw.size, item from dw join bw on dw.win = bw.win and dw.size = bw.size),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from h) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list_distinct(list(item))), ',') as items from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.doc_id = n.doc_id left join t on d.doc_id = t.doc_id
"""
