"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere go.

1. Anchors: in every 400-byte window the 100 bytes of smallest hash are an anchor, so equal
   windows hold equal anchors at equal places. An occurrence is an anchor with its context,
   all windows that can contain it; equal contexts are counted before they are moved.
2. A context that stands more than once is covered in all its places.
3. Anchors with several contexts: one copy of each context goes to the anchor's bucket, where
   a suffix array (two-stage sorting) brings equal strings together; neighbours with a common
   prefix of 400 bytes are the repeats.
4. An anchor with more than ``MOST_CONTEXTS`` contexts, too many for one suffix array, becomes
   several longer ones first: its windows are dealt into ranges by how many bytes they have
   before the anchor, and all windows of a range share the anchor and some of the bytes beside
   it. That is the new anchor, the range's windows are its context, and steps 2 and 3 apply to
   it; what is still too many is dealt again. A range of one window has one context.
5. The intervals of a document are merged and cut out.

Only different places count: strings of contexts that overlap in one document are the same
place. Defined cases: a null text is empty; texts shorter than 400 bytes stay; equal rows
count as documents of their own; further columns stay, whatever their names, but those named
like the results are replaced; an empty table gives an empty result; rows without a doc_id take
part like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Hashes, anchors, pieces
from .common import bloom, boxed, in_bloom, release_memory, small_batches, table, unboxed, written
from .suffixes import repeated_starts

WINDOW, GRAM = 400, 100
BUCKET_BYTES = 600_000
MOST_CONTEXTS = 2000
RANGES = 4  # into which a range of offsets is dealt
SLICE_BYTES = 4_000_000
INTERVAL = "key long, start long, end long"
CONTEXT = "anchor long, key long, lo long, before int, n long, bytes binary"


def _utf8(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def occurrences(keyed: DataFrame) -> DataFrame:
    """(key, text) to anchor, context (hashes), key, lo, hi: where the context stands, and
    before: its bytes before the anchor."""
    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys = part["key"].to_numpy()
            for batch in pieces(_utf8(part["text"]), WINDOW):
                number, place, h, hashes, begins = anchors([b for _, _, b in batch], WINDOW, GRAM)
                ends = begins + np.array([len(b) for _, _, b in batch])
                lo, hi = np.maximum(place - (WINDOW - GRAM), begins[number]), np.minimum(place + WINDOW, ends[number])
                context = hashes.of(lo, hi) + ((place - lo) * 1000 + hi - place).astype(np.uint64)
                base = np.array([a for _, a, _ in batch])[number] - begins[number]
                yield pd.DataFrame({"anchor": h.view(np.int64), "context": context.view(np.int64), "key": keys[np.array([k for k, _, _ in batch])[number]], "lo": lo + base, "hi": hi + base, "before": place - lo})

    return keyed.select("key", "text").mapInPandas(found, "anchor long, context long, key long, lo long, hi long, before int")


def _contexts(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """wanted (anchor, key, lo, hi, before, n) with the bytes of each context."""
    fields = ["anchor", "key", "lo", "hi", "before", "n"]

    def rows(held: list[tuple]) -> pd.DataFrame:
        *numbers, found = zip(*held, strict=True)
        out = {c: np.concatenate(x) for c, x in zip(("anchor", "key", "lo", "before", "n"), numbers, strict=True)}
        return pd.DataFrame(out | {"bytes": [b for x in found for b in x]})

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held, size = [], 0
            for text, anchor, key, lo, hi, before, n in zip(_utf8(part["text"]), *(part[c] for c in fields), strict=True):
                held.append((anchor, key, lo, before, n, [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
                size += int((hi - lo).sum())
                if size > SLICE_BYTES:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("want")).select(F.col("key").alias("__key"), *[F.col(f"want.{c}").alias(c) for c in fields])
    texts = in_bloom(keyed.select(F.col("key").alias("__key"), "text"), "__key", bloom(wanted, "key"))  # others don't move
    return per_text.join(texts, "__key").drop("__key").mapInPandas(cut, CONTEXT)


def _intervals(key: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Windows that begin at these places, merged where they follow each other."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.concatenate([first[1:], [True]])
    return pd.DataFrame({"key": key[first], "start": start[first], "end": start[last] + WINDOW})


def _elsewhere(run: np.ndarray, key: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which members of runs of equal strings stand in more than one place."""
    order = np.lexsort((start, key, run))
    run_, key_, start_ = run[order], key[order], start[order]
    moved = np.concatenate([[False], (run_[1:] == run_[:-1]) & ((key_[1:] != key_[:-1]) | (start_[1:] != start_[:-1]))])
    n = int(run.max()) + 1 if len(run) else 0
    return ((np.bincount(run_, moved, n) > 0) | (np.bincount(run, many, n) > 0))[run]


def by_suffixes(contexts: DataFrame, buckets: int) -> DataFrame:
    def matched(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["bytes"].str.len() >= WINDOW].reset_index(drop=True)
        if len(rows) < 2:
            return _intervals(np.zeros(0, np.int64), np.zeros(0, np.int64))
        text, place, run = repeated_starts(rows["bytes"].tolist(), WINDOW, lambda flat, a, b: Hashes(flat).of(a, b))
        key, start = rows["key"].to_numpy()[text], rows["lo"].to_numpy()[text] + place
        held = _elsewhere(run, key, start, rows["n"].to_numpy()[text] > 1)
        found = _intervals(key[held], start[held])
        del rows, text, place, run, key, start, held
        release_memory()
        return found

    return contexts.groupBy(F.pmod(F.col("anchor"), F.lit(buckets)).alias("bucket")).applyInPandas(matched, INTERVAL)


def longer_anchors(contexts: DataFrame) -> DataFrame:
    """contexts (CONTEXT and low, high: how many bytes their windows have before the anchor),
    each dealt into ranges low to high of its own: anchor is then that of the bytes that all
    windows of the range share, context the hash of all its windows."""
    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = part["bytes"].str.len().to_numpy().astype(np.int64)
            hashes = Hashes(np.frombuffer(b"".join(part["bytes"]), np.uint8))
            begins, before = np.cumsum(sizes) - sizes, part["before"].to_numpy().astype(np.int64)
            low, high = part["low"].to_numpy().astype(np.int64), part["high"].to_numpy().astype(np.int64)
            width = -(-(high - low + 1) // RANGES)
            for r in range(RANGES):
                a, b = low + r * width, np.minimum(high, low + (r + 1) * width - 1)
                least, most = np.maximum(a, WINDOW - (sizes - before)), np.minimum(b, before)  # near a text's ends not all
                at = np.flatnonzero(least <= most)
                if not len(at):
                    continue
                place, least, most, a, b = begins[at] + before[at], least[at], most[at], a[at], b[at]
                shared = hashes.of(place - a, place - b + WINDOW) + part["anchor"].to_numpy()[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64)
                lo, hi = place - most, place - least + WINDOW
                context = hashes.of(lo, hi) + (most * 1000 + hi - lo).astype(np.uint64)
                cut = [t[i:j] for t, i, j in zip(part["bytes"].to_numpy()[at], (lo - begins[at]).tolist(), (hi - begins[at]).tolist(), strict=True)]
                yield pd.DataFrame({"anchor": shared.view(np.int64), "context": context.view(np.int64), "key": part["key"].to_numpy()[at], "lo": part["lo"].to_numpy()[at] + lo - begins[at],
                                    "before": most, "n": part["n"].to_numpy()[at], "bytes": cut, "low": a, "high": b, "size": hi - lo})

    return contexts.mapInPandas(dealt, CONTEXT + ", context long, low int, high int, size int")


def _buckets(size: int) -> int:
    return max(1, -(-size // BUCKET_BYTES))


def by_longer_anchors(contexts: DataFrame) -> DataFrame:
    """The same for anchors of too many contexts, which become longer ones until they aren't."""
    level, out = contexts.withColumns({"low": F.lit(0), "high": F.lit(WINDOW - GRAM)}), None
    while True:
        dealt = written(longer_anchors(level), "dealt")
        same = ["anchor", "context"]
        once = written(dealt.groupBy(*same).agg(F.count("*").alias("places"), F.max("n").alias("many"), F.min(F.struct("key", "lo")).alias("one")), "longer")
        whole = dealt.join(once.filter("places > 1").select(*same), same).select("key", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end"))
        several = written(once.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "several")
        needed = once.join(several, "anchor").select(*same, "one.*", F.greatest("many", "places").alias("many"), "contexts")
        rest = written(dealt.join(needed, [*same, "key", "lo"]).select("anchor", "key", "lo", "before", F.col("many").alias("n"), "bytes", "low", "high", "contexts"), "rest")
        hot = F.col("contexts") > MOST_CONTEXTS
        size, left = rest.agg(F.coalesce(F.sum(F.when(~hot, F.octet_length("bytes"))), F.lit(0)), F.count_if(hot)).first()
        found = whole.union(by_suffixes(rest.filter(~hot), _buckets(size)))
        out = out.union(found) if out else found
        if not left:
            return out
        level = rest.filter(hot)


def repeated_intervals(keyed: DataFrame) -> DataFrame:
    """(key, text) to the intervals covered by repeated strings, in bytes: key, start, end."""
    found = written(occurrences(keyed), "anchors")
    counted = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi", "before")).alias("one"))
    per_anchor = counted.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("n").alias("places"))
    repeated = written(counted.join(per_anchor.filter("places > 1"), "anchor").select("anchor", "context", "n", "contexts", "one.*"), "contexts")
    everywhere = found.join(repeated.filter("n > 1 and hi - lo >= %d" % WINDOW).select("anchor", "context"), ["anchor", "context"]).select("key", F.col("lo").alias("start"), F.col("hi").alias("end"))
    wanted = repeated.filter("contexts > 1")
    hot = F.col("contexts") > MOST_CONTEXTS
    sizes = {r["hot"]: r["bytes"] for r in wanted.groupBy(hot.alias("hot")).agg(F.sum(F.col("hi") - F.col("lo")).alias("bytes")).collect()}
    out = everywhere
    if sizes.get(False):
        out = out.union(by_suffixes(_contexts(wanted.filter(~hot), keyed), _buckets(sizes[False])))
    if sizes.get(True):
        out = out.union(by_longer_anchors(_contexts(wanted.filter(hot), keyed)))
    return written(out.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "intervals")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept (the remaining bytes) and n_kept_chars (whole
    characters among them)."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    key = F.xxhash64("doc_id", "text")
    spans = repeated_intervals(docs.select(key.alias("key"), "text")).withColumnsRenamed({"key": "__key", "spans": "__spans"})

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, n_kept_chars long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, spans in zip(_utf8(texts), found, strict=True):
                at, removed, n, kept = 0, 0, 0, []
                end = -1
                for x in spans if spans is not None else ():
                    if x["start"] > end:
                        kept.append(text[at : x["start"]])
                        n += 1
                    if x["end"] > end:
                        removed += x["end"] - max(x["start"], end if end >= 0 else 0)
                        end = at = x["end"]
                left = b"".join([*kept, text[at:]])
                rows.append((len(text), removed, n, left, len(left.decode("utf-8", "ignore"))))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "n_kept_chars"])

    keyed = boxed(docs).withColumn("__key", F.xxhash64("__row.doc_id", "__row.text"))
    pages = bloom(spans, "__key")
    none = F.lit(None).cast(spans.schema["__spans"].dataType)
    touched = in_bloom(keyed, "__key", pages).join(spans, "__key", "left")
    out = touched.unionByName(in_bloom(keyed, "__key", pages, inside=False).withColumn("__spans", none)).withColumn("__r", cut("__row.text", "__spans"))
    return unboxed(out, docs.columns, **{c: F.col(f"__r.{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept", "n_kept_chars")})


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_kept_chars")
