"""Best-fit packing by linear grouping, planned on the histogram of lengths.

Documents become token pieces of at most ``capacity`` tokens; only the count of each length
(``capacity`` numbers) reaches the driver. There large lengths are rounded up within groups
of equal cardinality, patterns of few sizes are filled by subset sums and used as often as
their sizes last, the actual lengths take the slots of their group, and small lengths go
best-fit into what is left. The plan says which ranks of which length stand where; pieces
get their rank by counting within hash buckets, so no key is gathered in one task.

Defined cases: a null or empty text is one piece with the end token only; equal documents
are pieces each; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

CAPACITY = 1024
END = 2
GROUPS = 128
SMALL = 128
BUCKET_ROWS = 50_000
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
#: Texts of these characters only go through the faster encoder of the same vocabulary.
_PLAIN = re.compile("[^\n\r\t\x20-\x7e\xa1-ɏ]")


@functools.cache
def _encoders(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = True
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return exact, tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, json_path: str, ranks_path: str) -> list[int]:
    """Ids of the ``tokenizers`` file; plain texts by the same vocabulary's ranks."""
    exact, fast = _encoders(json_path, ranks_path)
    if not text:
        return []
    return exact.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. A longer document's first
    piece is the shorter one."""
    small_batches(docs.sparkSession)
    json_path, ranks_path = files or paths()

    @F.pandas_udf(PIECES)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([_cut(token_ids(t, json_path, ranks_path), capacity) for t in part])

    return docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")


def _cut(ids: list[int], capacity: int) -> list[dict]:
    packed, n = np.array([*ids, END], "<u4").tobytes(), len(ids) + 1
    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    return [{"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(packed[4 * a : 4 * b])} for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def _patterns(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(times, group numbers) until the counts are used up: the largest size left, filled by
    the subset sum nearest to the capacity. sizes descend."""
    counts, n = list(counts), len(sizes)
    first = 0
    while first < n:
        if not counts[first]:
            first += 1
            continue
        room = capacity - sizes[first]
        best: list[tuple[int, ...] | None] = [None] * (room + 1)
        best[0] = ()
        top = 0
        for g in range(first, n):
            if counts[g] and sizes[g] <= room:
                spare = counts[g] - (g == first)
                for c in range(room - sizes[g] + 1):
                    if best[c] is not None and best[c + sizes[g]] is None and (not best[c] or best[c].count(g) < spare) and spare:
                        best[c + sizes[g]] = (*best[c], g)
                        top = max(top, c + sizes[g])
                if top == room:
                    break
        use = [first, *(best[top] or ())]
        times = min(counts[g] // use.count(g) for g in set(use))
        for g in use:
            counts[g] -= times
        yield times, use


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> pd.DataFrame:
    """counts[l]: pieces of length l. Rows (length, rank, n, sequence, offset): the n pieces
    of that length from that rank on stand in the n sequences from that number on."""
    counts = np.asarray(counts, np.int64)
    used = np.zeros(capacity + 1, np.int64)
    slots, next_seq = [], 0
    left: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, n)
    large = [x for x in range(capacity, small, -1) if counts[x]]
    total = int(sum(counts[x] for x in large))
    share = max(1, -(-total // groups))
    # groups of equal cardinality: [rounded size, pieces, their lengths in descending order]
    grouped: list[list] = []
    for x in large:
        n = int(counts[x])
        while n:
            if not grouped or grouped[-1][1] == share:
                grouped.append([x, 0, []])
            take = min(n, share - grouped[-1][1])
            grouped[-1][1] += take
            grouped[-1][2].append([x, take])
            n -= take
    for times, use in _patterns([g[0] for g in grouped], [g[1] for g in grouped], capacity):
        while times:  # as long as the actual lengths in the slots stay the same
            m, taken = times, []
            need: dict[tuple[int, int], int] = {}
            for g in use:
                x = grouped[g][2][0][0]
                need[(g, x)] = need.get((g, x), 0) + 1
                taken.append((g, x))
            m = min(m, *(grouped[g][2][0][1] // k for (g, _), k in need.items()))
            if not m:  # the last few of a length: one sequence, slot by slot
                m, taken = 1, []
                for g in use:
                    taken.append((g, grouped[g][2][0][0]))
                    _take(grouped[g][2], 1)
            else:
                for g, x in taken:
                    _take(grouped[g][2], m)
            at = 0
            for _, x in taken:
                slots.append((x, int(used[x]), m, next_seq, at))
                used[x] += m
                at += x
            left.setdefault(capacity - at, []).append((next_seq, m))
            next_seq += m
            times -= m
    for x in range(min(small, capacity), 0, -1):
        n = int(counts[x])
        rooms = sorted(r for r in left if r >= x and left[r])
        heapq.heapify(rooms)
        while n:
            while rooms and not left.get(rooms[0]):
                heapq.heappop(rooms)
            if not rooms:
                fresh = -(-n // (capacity // x))
                left.setdefault(capacity, []).append((next_seq, fresh))
                heapq.heappush(rooms, capacity)
                next_seq += fresh
            room = rooms[0]
            first, m = left[room].pop()
            each = min(room // x, n)
            whole = min(m, n // each)
            for k in range(each):
                slots.append((x, int(used[x]), whole, first, capacity - room + k * x))
                used[x] += whole
            n -= whole * each
            left.setdefault(room - each * x, []).append((first, whole))
            if m > whole:
                left[room].append((first + whole, m - whole))
    return pd.DataFrame(slots, columns=["length", "rank", "n", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def _take(lengths: list[list[int]], n: int) -> None:
    while n:
        use = min(n, lengths[0][1])
        lengths[0][1] -= use
        n -= use
        if not lengths[0][1]:
            lengths.pop(0)


def pack(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) to the pieces with sequence_id and offset."""
    cut = written(pieces(docs, files, capacity), "pieces")
    held = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in held.items():
        counts[length] = n
    slots = plan(counts, capacity)
    keys = (slots["length"].to_numpy() << 44) + slots["rank"].to_numpy()
    placed = docs.sparkSession.sparkContext.broadcast((keys, slots["rank"].to_numpy(), slots["sequence"].to_numpy(), slots["offset"].to_numpy()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, ranks, sequences, offsets = placed.value
        k = np.searchsorted(at, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[k] + rank.to_numpy() - ranks[k], "offset": offsets[k]})

    buckets = max(1, -(-sum(held.values()) // BUCKET_ROWS))
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")) \
        .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    out = ranked.withColumn("at", place("length", F.col("base") + F.col("own")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
