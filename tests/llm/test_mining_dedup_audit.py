"""Hard negatives, substring dedup and the filter audit against brute force and their cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidemark.llm import filter_audit, hard_negatives, registry, substrings
from tidemark.llm.words import word_pieces

DOCS = "doc_id long, text string, extra string, key long, n_words int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "e", 7, 3) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_hard_negative_mining", "op12_substring_dedup", "op13_filter_interaction_audit"])
def test_more_rows_match_sql(spark, name):
    at = "/root/testdata/sf0.01"
    same(registry.QUERIES[name](spark, at), registry.ORACLES[name], connect(at))


# ---- 11
@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (33, 65, 70), (130, 67, 201), (3, 200, 300), (100, 1, 100)])
@pytest.mark.parametrize("leaf", [1, 8, 32])
def test_strassen_is_exact(shape, leaf):
    m, d, n = shape
    rng = np.random.default_rng(m + d + n)
    a, b = rng.integers(-(2**40), 2**40, (m, d)), rng.integers(-(2**20), 2**20, (d, n))
    exact = a.astype(object) @ b.astype(object)
    assert (hard_negatives.strassen(a, b, leaf).astype(object) == (exact + 2**63) % 2**64 - 2**63).all()


def test_strassen_recurses(monkeypatch):
    calls, own = [], hard_negatives.strassen
    monkeypatch.setattr(hard_negatives, "strassen", lambda *x: calls.append(x[0].shape) or own(*x))
    hard_negatives.strassen(np.ones((128, 64), int), np.ones((64, 128), int))
    assert calls[0] == (128, 64) and calls.count((64, 32)) == 7


def _mined(rows, anchors, positives=5, negatives=5):
    rows = sorted({(i, k, tuple(np.floor(256 * np.array(v, float)).astype(int))) for i, k, v in rows})
    size = max((len(v) for _, _, v in rows), default=0)
    pad = {r: np.array([*r[2], *[0] * (size - len(r[2]))]) for r in rows}
    out = []
    for a in rows:
        if not anchors(a[0]):
            continue
        scored = sorted(((-int(pad[a] @ pad[r]), r[0], r) for r in rows if r != a))
        own = [(-s, i) for s, i, r in scored if r[1] == a[1]][:positives]
        for p, i in own:
            inside = [(-s, j) for s, j, r in scored if r[1] != a[1] and 80 * p <= -100 * s <= 100 * p][:negatives]
            out += [(a[0], i, k + 1, j, p, s) for k, (s, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(512, 4096), (2, 7)])
def test_mining_brute_force(spark, tiles):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(0, 4, 6) / 4]) for i in range(90)]
    rows += [(200 + i, 1, [0.5] * 6) for i in range(20)] + [(400 + i, 2, [0.5] * 6) for i in range(20)]  # ties
    rows += [rows[0], rows[0], (91, 0, []), (92, 1, [0.9] * 3), (93, 1, [-1.0] * 6), (10, 2, [0.25] * 6)]
    odd = [(94, None, [1.0] * 6), (95, 1, None), (96, 1, [1.0, None]), (97, 1, [float("nan")] * 6), (98, 1, [float("inf")] * 6), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, label int, embedding array<double>, key string, anchors int")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, anchor_tile=tiles[0], candidate_tile=tiles[1])
    want = _mined(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df.limit(1), F.col("vec_id") % 10 == 0).count() == 0


def test_mining_heaps_merge_in_any_order():
    rng = np.random.default_rng(8)
    scores, ids = rng.integers(0, 5, (4, 60)), np.arange(60)
    allowed = rng.random((4, 60)) < 0.7
    want = [sorted((-s, i) for s, i, ok in zip(scores[r], ids, allowed[r], strict=True) if ok)[:5] for r in range(4)]
    for cuts in ([60], [20, 60], [7, 9, 41, 60]):
        held = [[] for _ in range(4)]
        for a, b in itertools.pairwise([0, *cuts]):
            r, c = hard_negatives.heaps(scores[:, a:b], allowed[:, a:b], ids[a:b], 5)
            for i, j in zip(r, c, strict=True):
                held[i].append((-scores[i, a + j], a + j))
        assert [sorted(h)[:5] for h in held] == want


def test_mining_meets_all_tiles(spark):
    """In as many shuffle partitions as tiles might go to, and with scores of which a hundredfold
    doesn't fit in 64 bits."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-99, 400, 6) * 2.0**13]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    conf = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, anchor_tile=4, candidate_tile=20).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = _mined(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100 and max(r[4] for r in want) > 2**63 // 100


# ---- 12
def _deduped(docs):
    """(doc_id, n_words, kept) by looking at all windows."""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    smallest = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - 49):
                k = tuple(w[s : s + 50])
                smallest[k] = min(i, smallest.get(k, i))
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - 49) if i is not None and smallest[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def _texts():
    rng = np.random.default_rng(6)
    text = lambda n, kinds=400: " ".join(f"w{x}" for x in rng.integers(0, kinds, n))
    passage, long = text(50), text(400)
    rows = [(0, None), (1, ""), (2, " \t\r\n"), (3, text(49)), (4, passage), (5, text(30) + " \n" + passage + "\t" + text(30)), (6, passage + " " + passage), (7, passage.upper())]
    rows += [(8, long), (9, long), (9, long), (9, passage), (None, long), (None, None), (10, long[:1400]), (11, text(20) + " " + long[200:]), (12, long[700:] + " " + long[:700])]
    for k in range(25):  # near copies, by single words
        w = long.split()
        for _ in range(k % 5):
            w[rng.integers(len(w))] = f"x{k}"
        rows.append((20 + k, " ".join(w[k : 400 - 2 * k])))
    rows += [(60 + k, f"{text(k, 20)} {passage} {text(5)}") for k in range(15)]  # one passage, different surroundings
    return rows + [(80, "a " * 300), (81, "a " * 120), (82, "b c " * 60), (83, "é漢 " + "a " * 49), (90 - 1, "only " + passage)]


def test_substrings_brute_force(spark):
    docs = _texts()
    out = substrings.remove_repeats(_docs(spark, docs))
    assert set(out.columns) == {"doc_id", "text", "extra", "key", "n_words", "n_removed", "kept"}
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == _deduped(docs)
    assert {(r["extra"], r["key"]) for r in got} == {("e", 7)}
    assert substrings.remove_repeats(_docs(spark, [])).count() == 0


def test_substrings_in_small_pieces(monkeypatch):
    texts = [(t or "").encode() for _, t in _texts()]
    whole = substrings.word_hashes(texts)
    monkeypatch.setattr(substrings, "PIECE", 64)
    again = substrings.word_hashes(texts)
    assert (whole[0] == again[0]).all() and whole[1].tolist() == again[1].tolist() == [len(t.split()) for t in texts]
    windows = lambda piece: sorted((int(n), int(a) + i, int(h)) for number, _, _, lo, _, of in substrings.seeds(*whole, piece) for k, (n, a) in enumerate(zip(number, lo, strict=True)) for i, h in enumerate(of(k)))
    every = windows(1 << 22)
    assert len(every) == sum(max(0, c - 49) for c in whole[1].tolist()) == len({x[:2] for x in every})  # each window has one seed
    assert windows(100) == every
    assert [w for p in word_pieces(texts[8], 50) for w in p] == texts[8].split()


# ---- 13
def _audited(docs, labels):
    known = {}
    for i, q, t in labels:
        known[i] = tuple(max((x for x in (a, b) if x is not None), default=None) for a, b in zip(known.get(i, (None, None)), (q, t), strict=True))
    rows = []
    for i, lang, text in docs:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs)}
        q, x = known.get(i, (None, None)) if i is not None else (None, None)
        rows.append((lang or "", {k for k, v in fails.items() if v}, q == 1, x == 1))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for s, k in enumerate(order):
                before = set(order[:s])
                gone = [r for r in mine if k in r[1] and not r[1] & before]
                shapley[k] += len(gone)
                out[part, "".join(order), s + 1] = [sum(not r[1] & (before | {k}) for r in mine), len(gone), sum(k in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {k} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(shapley[order[s - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(220))
    texts = [many, many, many.upper(), many + " #", "short", "", None, "a " * 300, "a " * 300, "A|" * 9, many + " é漢 " * 10, many + "\n\x0b", None, "x" * 50 + "Y", " \t"]
    docs = [(i, ["en", None, "", "de"][i % 4], t) for i, t in enumerate(texts)] + [(2, "en", texts[2]), (None, "en", many), (None, None, None)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(0, 1, None), (3, None, 1), (None, 1, 1), (500, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, lang string, text string, mask int, part string")
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.cells(filter_audit.failure_masks(frame), known))
    want = _audited(docs, labels)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 3 * 600
    assert filter_audit.audit(filter_audit.cells(filter_audit.failure_masks(frame.limit(0)), known)).count() == 0


def test_prefixes(spark):
    cells = spark.createDataFrame([(0,), (5,), (5,)], "mask int")
    found = filter_audit.prefixes(cells, "XYZ").collect()
    assert len(found) == 2 * (3 + 6 + 6) and len({(r["mask"], r["prefix"]) for r in found}) == 30
    r = next(r for r in found if r["mask"] == 5 and r["prefix"] == "YZX")
    assert (r["letter"], r["step"], r["kept"], r["removed"], r["redundant"], r["alone"]) == ("X", 3, False, False, True, False)
