"""N-gram Jaccard join: documents whose sets of 5-word shingles have similarity 3/4 or more.

1. Every text becomes a set of shingle hashes; equal sets are one class.
2. Each class signs by PartEnum. A task packs its signatures by bucket, so the shuffle moves
   a few bytes a signature: the low 32 bits of it and, once a bucket, of the class (its ref).
   Refs that share a signature meet in its bucket and are tied to the smallest of them, which
   makes (representative, member) rows, never pairs. A ref stands for all classes that have it,
   so those are tied too.
3. A representative's members are compared by sketches (a lower bound of the sets'
   difference), which gives a forest of the members they connect, not the pairs. Many members
   are dealt in blocks: all against the first block, then those not in the most common
   component against all blocks.
4. What sketches connect is compared by the exact sets, again to a forest. A class is in the
   groups of several representatives; its text is sent once, to the component that all of
   them make together, unless that is too large for a task: then once a group. Only texts that
   pass a Bloom filter of fixed size, made of the wanted documents, are shuffled.
5. Components of the exact links, named by their smallest document.

Defined cases: a text without words has an empty set and is linked with nothing; rows
without a doc_id are left out; repeated rows are rows of the result each; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, by_chars, in_bloom, release_memory, small_batches, table, written
from .components import components
from .partenum import signatures
from .shingles import set_key, shingle_sets

BUCKET_SIGNATURES = 1_500_000
BLOCK_SHINGLES, BLOCK_MOST, BLOCK_LEAST = 2_000_000, 2000, 50
MIN_SLOTS, MAX_SLOTS = 128, 1 << 17


def linked(a: int, b: int, common: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def sketch(shingles: np.ndarray) -> bytes:
    """Odd sketch: the parity of the shingles by hash slot, one or two slots a shingle. The
    slots in which two sketches differ are at most the elements in which the sets differ."""
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << len(shingles).bit_length()))
    odd = np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (set size), cls (key of the set, 0 if empty), sketch."""
    @F.pandas_udf("n long, cls long, sketch binary")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part in by_chars(batch.to_frame("text")):
                rows += [(len(s), set_key(s), sketch(s)) for s in shingle_sets(part["text"].tolist())]
            yield pd.DataFrame(rows, columns=["n", "cls", "sketch"])
        release_memory()

    return docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), measured("text").alias("m")).select("doc_id", "text_key", "m.*")


def shared_signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """(rep, ref): refs that share a signature with a ref, the smallest of those."""
    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for part in parts:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for piece in by_chars(part):
                sets = shingle_sets(piece["text"].tolist())
                keys = [set_key(s) for s in sets]
                fresh = [i for i, k in enumerate(keys) if k and not (k in seen or seen.add(k))]  # a class signs once a task
                if fresh:
                    who, sig = signatures([sets[i] for i in fresh])
                    held.append((np.array([keys[i] for i in fresh], np.int64)[who], sig))
            if held:
                yield _packed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), buckets)
        release_memory()

    def met(parts: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(parts["sigs"]), np.uint32)
        cls = np.repeat(np.frombuffer(b"".join(parts["refs"]), np.uint32), np.frombuffer(b"".join(parts["counts"]), np.uint8))
        order = np.sort(sig)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            return pd.DataFrame({"rep": [], "ref": []}).astype("int64")
        mine = twice[np.minimum(np.searchsorted(twice, sig), len(twice) - 1)] == sig
        sig, cls = sig[mine], cls[mine]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        rep = cls[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        found = pd.DataFrame({"rep": rep, "ref": cls})[rep != cls].drop_duplicates().astype("int64")
        del sig, cls, order, mine, first, rep
        release_memory()
        return found

    blobs = docs.filter("doc_id is not null and text is not null").select("text").mapInPandas(packed, "bucket int, refs binary, counts binary, sigs binary")
    return blobs.groupBy("bucket").applyInPandas(met, "rep long, ref long").distinct()


def _packed(cls: np.ndarray, sig: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row a bucket: the refs in it, how many signatures each has, their low 32 bits."""
    bucket, ref = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), cls.astype(np.uint32)
    order = np.argsort((bucket << np.uint64(32)) + ref)  # a ref's signatures in a bucket side by side
    bucket, ref, low = bucket[order], ref[order], sig[order].astype(np.uint32)
    cuts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(bucket)]])
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        starts = np.concatenate([[0], np.nonzero(ref[a + 1 : b] != ref[a : b - 1])[0] + 1])
        sizes = np.diff([*starts, b - a])
        if sizes.max() >= 1 << 8:  # a count in 8 bits: cut long runs
            starts = np.unique(np.concatenate([starts, np.arange(0, b - a, 1 << 7)]))
            sizes = np.diff([*starts, b - a])
        rows.append((int(bucket[a]), ref[a:b][starts].tobytes(), sizes.astype(np.uint8).tobytes(), low[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "refs", "counts", "sigs"])


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of equal keys from sorted batches, one at a time."""
    held: list[pd.DataFrame] = []
    for part in parts:
        change = (part[keys] != part[keys].shift()).any(axis=1).to_numpy().copy()
        change[0] = False
        cuts = [0, *np.nonzero(change)[0], len(part)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            piece = part.iloc[a:b]
            if held and (n or tuple(held[0][keys].iloc[0]) != tuple(piece[keys].iloc[0])):
                yield tuple(held[0][keys].iloc[0]), pd.concat(held)
                held = []
            held.append(piece)
    if held:
        yield tuple(held[0][keys].iloc[0]), pd.concat(held)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member reachable from each of n, by pairs given in pieces."""
    at = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(at[a], at[b])
            np.minimum.at(at, at[a], low)
            np.minimum.at(at, at[b], low)
            while (at[at] != at).any():
                at = at[at]
            left = at[a] != at[b]
            a, b = a[left], b[left]
    return at


def near_sketches(sketches: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that sizes and sketches can't rule out. Linked sets differ by a third in size at
    most, so their sketches have equal lengths, or one twice the other's, which folds."""
    bits = np.array([len(x) for x in sketches])
    for n in np.unique(bits).tolist():
        at = np.nonzero((bits == n) | (bits == 2 * n))[0]
        m = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, n // 8), axis=0) for i in at])
        own, size = bits[at] == n, sizes[at]
        for i in np.nonzero(own)[0].tolist():
            rest = np.nonzero((~own | (np.arange(len(at)) > i)) & (4 * size >= 3 * size[i]) & (4 * size[i] >= 3 * size))[0]
            near = rest[7 * np.bitwise_count(m[rest] ^ m[i]).sum(axis=1, dtype=np.int64) <= size[i] + size[rest]]
            if len(near):
                yield np.full(len(near), at[i]), at[near]


def exact_links(sets: list[np.ndarray], chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that are linked: intersections by matrix products over shared shingles."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    if m < 6:
        found = [(i, j) for i in range(m) for j in range(i + 1, m) if linked(sizes[i], sizes[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True)))]
        if found:
            yield tuple(np.array(found).T)
        return
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))
    often = np.bincount(number)[number] > 1
    number, owner = number[often], owner[often]
    number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(number) else number
    common = np.zeros((m, m), np.float32)
    columns = int(number[-1]) + 1 if len(number) else 0
    for c in range(0, columns, chunk):
        a, b = np.searchsorted(number, [c, c + chunk])
        x = np.zeros((m, min(chunk, columns - c)), np.float32)
        x[owner[a:b], number[a:b] - c] = 1
        common += x @ x.T
    for i in range(m - 1):
        j = np.nonzero(100 * common[i, i + 1 :] >= 75 * (sizes[i] + sizes[i + 1 :] - common[i, i + 1 :]))[0] + i + 1
        if len(j):
            yield np.full(len(j), i), j


def _links(assigned: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """assigned (rep, task, cls) to exact links (a, b) that connect what each task holds."""
    keys = ["rep", "task"]

    def sketched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (rep, task), g in _groups(parts, keys):
            g = g.drop_duplicates("cls")
            at = forest(len(g), near_sketches(g["sketch"].tolist(), g["n"].to_numpy()))
            more = np.bincount(at, minlength=len(g))[at] > 1
            if more.any():
                cls = g["cls"].to_numpy()
                yield pd.DataFrame({"rep": rep, "task": task, "part": cls[at[more]], "cls": cls[more], "doc_id": g["doc_id"].to_numpy()[more], "n": g["n"].to_numpy()[more]})
        release_memory()

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, g in _groups(parts, ["held"]):
            sets = [s for piece in by_chars(g) for s in shingle_sets(piece["text"].tolist())]
            held = {k: s for k, s, c in zip(map(set_key, sets), sets, g["cls"], strict=True) if k == c}
            names = np.array(list(held), np.int64)
            at = forest(len(names), exact_links(list(held.values())))
            rest = at != np.arange(len(at))
            if rest.any():
                yield pd.DataFrame({"a": names[rest], "b": names[at[rest]]})
        release_memory()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = assigned.join(classes, "cls").select("rep", "task", "cls", "doc_id", "n", "sketch")
    near = written(rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(sketched, "rep long, task long, part long, cls long, doc_id long, n long"), "near")
    together = components(near.select(F.col("part").alias("a"), F.col("cls").alias("b")))
    one = near.select("cls", "doc_id", "n").distinct().join(together.withColumnRenamed("node", "cls"), "cls")
    wide = one.groupBy("label").agg(F.count("*").alias("members"), F.sum("n").alias("total")).filter((F.col("members") > BLOCK_MOST) | (F.col("total") > BLOCK_SHINGLES)).select("label")
    wide = written(one.join(wide, "label").select("cls"), "wide")
    small = one.join(wide, "cls", "left_anti").select(F.col("label").alias("held"), "cls", "doc_id")
    groups = small.union(near.join(wide, "cls", "left_semi").select(F.xxhash64("rep", "task", "part"), "cls", "doc_id"))
    texts = in_bloom(docs.select("doc_id", "text"), "doc_id", bloom(near, "doc_id")).join(groups, "doc_id").select("held", "cls", "text")
    return texts.repartition(parts, "held").sortWithinPartitions("held").mapInPandas(compared, "a long, b long").distinct()


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id, text_key (xxhash64 of the text)."""
    small_batches(docs.sparkSession, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = written(with_sets(docs), "sets")
    classes = members.filter("cls <> 0").groupBy("cls").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("c")).select("cls", "c.*")
    total = members.agg(F.sum("n")).first()[0] or 0
    ties = written(shared_signatures(docs, max(1, -(-total * 13 // (10 * BUCKET_SIGNATURES)))), "ties")
    named = members.filter("cls <> 0").select(F.col("cls").bitwiseAND(0xFFFFFFFF).alias("ref"), "cls", "n").distinct()
    refs = named.groupBy("ref").agg(F.count("*").alias("classes"), F.max("n").alias("n"))
    alone = ties.select("rep").union(refs.filter("classes > 1").select("ref")).distinct()
    ties = ties.union(alone.select("rep", F.col("rep").alias("ref")))
    block_rows = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), (F.lit(BLOCK_SHINGLES) / F.col("n")).cast("int")))
    sizes = ties.groupBy("rep").agg(F.count("*").alias("members")).join(refs.withColumnRenamed("ref", "rep"), "rep") \
        .select("rep", F.ceil(F.col("members") / block_rows).cast("int").alias("blocks"))
    dealt = written(ties.join(sizes, "rep").join(named, "ref").select("rep", "cls", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block")), "blocks")
    first = dealt.withColumn("task", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("blocks").cast("long") - 1))))
    links = written(_links(first.select("rep", "task", "cls"), classes, docs), "links")
    labels = components(links)
    crowded = dealt.filter("blocks > 1")
    if not crowded.isEmpty():
        named = crowded.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        main = named.groupBy("rep", "label").count().groupBy("rep").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        minor = named.join(main, "rep").filter("label <> main")
        left = minor.select("rep", "block").distinct().withColumnRenamed("block", "left")
        task = F.col("left") * F.col("blocks") + F.col("block")
        second = minor.withColumn("left", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).select("rep", task.alias("task"), "cls") \
            .union(crowded.join(left, "rep").select("rep", task.alias("task"), "cls"))
        labels = components(links.union(_links(second.distinct(), classes, docs)))
    named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.filter("cls <> 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_key")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group: that with the smallest doc_id, of rows with
    its id and text one. A row is known by id and text, so of rows with one id and different
    texts each is judged by its own text. Rows without an id aren't compared and stay. Only
    documents that a Bloom filter of the others' ids lets through are shuffled."""
    judged = written(similar(docs).select("doc_id", "text_key", (F.col("doc_id") == F.col("component_id")).alias("__stays")), "judged")
    rows = judged.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("__stays").alias("stays"))
    open_ = written(rows.filter("n > 1 or not stays").select("doc_id"), "open")
    pages, key = bloom(open_, "doc_id"), F.xxhash64("text")
    named = docs.filter("doc_id is not null")
    stay = rows.filter("stays").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    maybe = in_bloom(named.withColumns({"__id": F.col("doc_id").cast("long"), "__key": key}), "__id", pages).join(stay, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    sure = in_bloom(named.withColumn("__id", F.col("doc_id").cast("long")), "__id", pages, inside=False)
    return sure.select(*docs.columns).union(maybe.select(*docs.columns)).union(docs.filter("doc_id is null"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


OP1_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on r.b = l.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from w left join n on w.doc_id = n.doc_id join (select a, min(b) as component_id from r group by a) m on m.a = w.doc_id
"""
