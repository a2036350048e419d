"""Suffix arrays of byte strings by two-stage sorting, and what repeats in them.

A suffix smaller than its successor is sorted directly; the others follow from those by
scanning the buckets of first bytes in order: a suffix's predecessor with a larger first
byte (or the same, if it is itself no smaller than its successor) gets the next place in
its bucket. Order is only needed as deep as the matches are long, so direct sorting stops
there and leaves equal prefixes in any order; and only of the places where a match can start,
so other suffixes are left out, except those that wanted ones are placed by.
"""

from __future__ import annotations

import numpy as np

PAIRS = 1 << 16  # compared at a time


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last one is not."""
    n = len(text)
    up, same = np.zeros(n, bool), np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    same[:-1] = text[:-1] == text[1:]
    where = np.where(~same, np.arange(n), n)
    decided = np.minimum.accumulate(where[::-1])[::-1]  # the next place where bytes differ
    return up[np.minimum(decided, n - 1)]


def _sorted_direct(text: np.ndarray, at: np.ndarray, depth: int, alike: np.ndarray | None) -> np.ndarray:
    """The places in at in the order of the ``depth`` bytes from there on. Places that are
    known to begin alike (equal numbers in ``alike``) are sorted once and stay in the order of
    the text, so that successive places have successive neighbours."""
    if not len(at):
        return at
    if alike is None:
        return at[_order(text, at, depth)]
    values = alike[at]
    by = np.argsort(values, kind="stable")
    values = values[by]
    starts = np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0]
    counts = np.diff(np.append(starts, len(at)))
    order = _order(text, at[by[starts]], depth)
    counts, starts = counts[order], starts[order]
    return at[by[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(at))]]


def _eights(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place on as a number, ``more`` places beyond the end included."""
    return np.ndarray(len(text) + more - 7, ">u8", text.tobytes() + bytes(more), strides=(1,))


def _order(text: np.ndarray, at: np.ndarray, depth: int, rounds: int = 4) -> np.ndarray:
    """By eight bytes at a time as long as ``rounds``, then the remaining ties by the rest."""
    whole = text.tobytes()
    eights = _eights(text, 8 * rounds)
    out, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    tied = np.arange(len(at))
    for r in range(rounds):
        keys = eights[at[out[tied]] + 8 * r].astype(np.uint64)
        order = np.lexsort((keys, group[tied])) if r else np.argsort(keys)
        out[tied], keys = out[tied[order]], keys[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[tied[1:]] != group[tied[:-1]])])
        group[tied] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        alone = first & np.concatenate([first[1:], [True]])
        tied = tied[~alone]
        if not len(tied):
            return out
    tails = [whole[p + 8 * rounds : p + depth] for p in at[out[tied]].tolist()]
    perm = list(range(len(tied)))
    starts = np.nonzero(np.concatenate([[True], group[tied[1:]] != group[tied[:-1]]]))[0].tolist()
    for a, b in zip(starts, [*starts[1:], len(tied)], strict=True):
        if b - a > 2:
            perm[a:b] = sorted(perm[a:b], key=tails.__getitem__)
        elif tails[a] > tails[a + 1]:
            perm[a], perm[a + 1] = a + 1, a
    out[tied] = out[tied[perm]]
    return out


def _placed_by(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes and those behind each, to the first one smaller than its successor."""
    at = np.arange(len(small), dtype=np.int32)
    ordered = np.maximum.accumulate(np.where(small, at, np.int32(-1)))
    return np.maximum.accumulate(np.where(wanted, at, np.int32(-1))) > np.concatenate([[np.int32(-1)], ordered[:-1]])


def suffix_array(text: np.ndarray, depth: int, alike: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of a uint8 array, ordered by their first ``depth`` bytes. ``alike`` may
    number the places so that equal numbers have the same ``depth`` bytes. Where it is a masked
    array, masked suffixes aren't needed, and few of them are among the result."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = suffix_types(text)
    held = _placed_by(small, ~np.ma.getmaskarray(alike)) if np.ma.isMaskedArray(alike) else np.ones(n, bool)
    counts = np.bincount(text[held], minlength=256)
    ends = np.cumsum(counts)
    heads = ends - counts
    out = np.full(int(ends[-1]), -1, np.int64)
    direct = _sorted_direct(text, np.nonzero(small & held)[0], depth, None if alike is None else np.ma.getdata(alike))
    larger = held & ~small
    firsts = text[direct]
    per = np.bincount(firsts, minlength=256)
    tails = ends - per  # in a bucket, suffixes smaller than their successor come last
    out[tails[firsts] + np.arange(len(direct)) - np.repeat(np.cumsum(per) - per, per)] = direct
    free = heads.copy()

    def place(found: np.ndarray) -> None:
        """Gives suffixes, in order, the next places of their buckets."""
        c = text[found]
        order = np.argsort(c, kind="stable")
        c, found = c[order], found[order]
        k = np.bincount(c, minlength=256)
        out[free[c] + np.arange(len(c)) - np.repeat(np.cumsum(k) - k, k)] = found
        free[:] += k

    if larger[n - 1]:
        place(np.array([n - 1]))
    for b in np.nonzero(counts)[0]:
        at = heads[b]
        while at < free[b]:  # what the bucket's own scan adds to it comes in the next round
            to = free[b]
            before = out[at:to] - 1
            before = before[before >= 0]
            place(before[larger[before] & (text[before] >= b)])
            at = to
        before = out[tails[b] : ends[b]] - 1
        before = before[before >= 0]
        place(before[larger[before] & (text[before] > b)])
    return out


def _matched(flat: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from a and from b agree, ``most`` at most: 16 bytes, then 128 at a time, for
    the pairs that still agree. Both stay within the text for as long as that."""
    padded = np.concatenate([flat, np.zeros(most + 128, np.uint8)])
    out = np.full(len(a), most, np.int64)
    for low in range(0, len(a), PAIRS):
        live, r, width = np.arange(low, min(low + PAIRS, len(a))), 0, 16
        while r < most and len(live):
            blocks = np.ndarray(len(padded) - width + 1, f"V{width}", padded, strides=(1,))
            differ = (blocks[a[live] + r].view("<u8") ^ blocks[b[live] + r].view("<u8")).reshape(-1, width // 8)
            apart = differ.any(axis=1)
            eight = (differ[apart] != 0).argmax(axis=1)
            first = differ[apart, eight]
            lowest = first & (~first + np.uint64(1))
            out[live[apart]] = np.minimum(most, r + 8 * eight + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
            live = live[~apart]
            r, width = r + width, 128
    return out


def reach(flat: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For suffixes in order: does each have ``size`` bytes in common with the one before it?
    Neighbours of successive suffixes tend to be successive too: along a stretch of places at one
    distance from their neighbours each common prefix is one byte shorter than the last, so it
    is enough to compare the stretch with its neighbours byte by byte, and what follows it."""
    n = len(order)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    before = np.full(len(flat), -1, np.int32)  # the texts of one task; half the memory
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0).astype(np.int32)
    far = at - before[at]
    del before
    new = np.concatenate([[True], (far[1:] != far[:-1]) | (at[1:] != at[:-1] + 1)])
    last = at[np.concatenate([new[1:], [True]])]
    stretch = np.cumsum(new, dtype=np.int32) - 1
    behind = _matched(flat, last + 1, last + 1 - far[np.concatenate([new[1:], [True]])], size)
    following = np.minimum.accumulate(np.where(flat[at] != flat[at - far], at, np.int32(len(flat) + size))[::-1])[::-1]
    ends = (last + 1 + behind).astype(np.int32)
    del far, new, behind
    enough = np.zeros(len(flat), bool)
    enough[at] = np.where(following <= last[stretch], following, ends[stretch]) - at >= size
    return enough[order]


def repeated_starts(texts: list[bytes], size: int, hashes_of=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal ``size``-byte strings in the texts, from their joint suffix array: runs
    of neighbours whose common prefixes, compared byte by byte, reach that length.
    ``hashes_of(flat, a, b)`` may give the hashes of the stretches a to b, so that the sort
    handles equal beginnings once; it has no say in what is equal.
    Returns text number, place and run of every start whose string stands more than once."""
    gap = np.zeros(1, np.uint8)
    flat = np.concatenate([x for t in texts for x in (np.frombuffer(t, np.uint8), gap)])
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    at, ends = np.arange(len(flat)), (begins + sizes - 1)[owner]
    starts = at + size <= ends
    alike = hashes_of(flat, at, np.minimum(at + size, ends)) if hashes_of else at
    order = suffix_array(flat, size, np.ma.array(alike, mask=~starts))
    order = order[starts[order]]
    del alike, at, ends, starts
    if not len(order):
        return order, order, order
    run = np.cumsum(~reach(flat, order, size)) - 1
    more = np.bincount(run)[run] > 1
    at, run = order[more], run[more]
    return owner[at], at - begins[owner[at]], run
