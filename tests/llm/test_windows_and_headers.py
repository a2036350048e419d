import gzip
import random
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import decontaminate, warc


def _plain(items, docs):
    """Spans and items by comparing every window of every item with every place."""
    out = []
    for words in docs:
        hit, found = set(), set()
        for name, text in items:
            item = decontaminate.words_of(text)
            size = min(decontaminate.WINDOW, len(item))
            for i in range(len(item) - size + 1 if size else 0):
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == item[i : i + size]:
                        hit.update(range(at, at + size))
                        found.add(name)
        out.append((hit, found))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_windows_brute_force(monkeypatch, weak):
    if weak:  # nearly all windows of a length have the same hash
        exact = decontaminate._hashes
        monkeypatch.setattr(decontaminate, "_hashes", lambda ids, size: exact(ids, size) % np.uint64(3))
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [(str(i), text(r.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(25)] + [("none", None), ("", "c " * 12), ("12", "a b a b")]
    docs = [decontaminate.words_of(text(r.randrange(25))) for _ in range(30)] + [[], [b"c"] * 30]
    got = decontaminate.WindowSet(iter(items)).scan(docs)
    assert [({x for a, e in spans for x in range(a, e)}, found) for spans, found in got] == _plain(items, docs)
    assert decontaminate.WindowSet([]).scan(docs) == [([], set())] * len(docs)


def test_window_memory():
    r = random.Random(1)
    words = [str(r.randrange(10**6)) for _ in range(20000)]
    items = [(str(i), " ".join(r.choices(words, k=200))) for i in range(500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = decontaminate.WindowSet(iter(items))
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held.sizes and now < 8 * size and peak < 14 * size  # a fifth of the words are distinct


def test_warc_headers(spark, tmp_path):
    rows = [(1, "http://a/x", "payload " * 20), (2, "http://b/\r\nWARC-Type: x y", "payload " * 20), (3, None, "short"), (4, "", None)]
    path = f"{tmp_path}/a"
    warc.write_archives(warc.dedupe_payloads(spark.createDataFrame(rows, "page_id long, url string, html string")), path, chunk=64)
    text = "".join(gzip.decompress(f.read_bytes()).decode() for f in (tmp_path / "a").glob("*.gz"))
    records = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].strip().split("\r\n")) for r in text.split("WARC/1.1\r\n")[1:]]
    target = {(r["WARC-Record-ID"], r["WARC-Type"]): r["WARC-Target-URI"] for r in records}
    assert target["<urn:page:1>", "revisit"] == "http://a/x" and target["<urn:page:2>", "response"] == "http://b/WARC-Type:xy"
    assert target["<urn:page:3>", "response"] == "urn:page:3" and target["<urn:page:4>", "revisit" if ("<urn:page:4>", "revisit") in target else "response"] == "urn:page:4"
    assert {r["WARC-Segment-Number"]: r.get("WARC-Segment-Total-Length") for r in records if "WARC-Segment-Number" in r} == {"1": None, "2": None, "3": "160"}
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.read_chunks(spark, path).filter("last").collect()) == [(1, 2), (2, None), (3, None), (4, None)]
