"""PartEnum signatures: sets that are similar enough share one.

Sizes fall into bands of ratio 4/3; a pair belongs to the band of its larger set, so a set
signs for its own band and, if a partner can be there, for the next. In a band the feature
domain is cut into n1 partitions of three parts each. Sets of sizes a and b with Jaccard
similarity of 3/4 or more differ in k = (a + b) / 7 elements at most; if n1 is large enough,
some partition holds one difference at most, and two of its three parts agree: each pair of
parts that isn't empty is a signature. A set whose partitions are too sparsely filled for
that argument also signs with its prefix in hash order, the finest partition.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from .shingles import mixed

PARTS = 3
PAIRS = ((0, 1), (0, 2), (1, 2))
DENSITY = 0.17  # partitions an element of a band's largest set
_SALT = np.uint64(0x2545F4914F6CDD1D)


@functools.cache
def _bands(largest: int) -> np.ndarray:
    """Largest size of each band."""
    out = [0, 1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array([*out, max(out[-1] + 1, out[-1] * 4 // 3)])


def bands(largest: int) -> np.ndarray:
    return _bands(1 << max(10, int(largest).bit_length() + 1))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of every non-empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    tops, flat = bands(sizes.max()), np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    band = np.searchsorted(tops, sizes)
    found = []
    for step in (0, 1):
        most = np.minimum(tops[band + step], sizes * 4 // 3)  # the largest partner
        takes = (sizes > 0) & ((step == 0) | (most > tops[band]))
        found.append(_signed(flat, owner, sizes, band + step, tops[band + step], (sizes + most) // 7, takes))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _signed(flat, owner, sizes, band, top, differ, takes):
    n1 = np.where(takes, np.maximum(1, np.ceil(DENSITY * top)).astype(np.int64), 0)
    base = np.cumsum(n1 * PARTS) - n1 * PARTS
    mine = takes[owner]
    x, who = flat[mine], owner[mine]
    partition = ((x >> np.uint64(32)) * n1[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    slot = base[who] + partition * PARTS + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
    total = np.zeros(int((n1 * PARTS).sum()), np.uint64)
    np.add.at(total, slot, mixed(x + _SALT))
    total = total.reshape(-1, PARTS)
    filled = total != 0
    holder = np.repeat(np.arange(len(n1)), n1)
    number = (np.arange(len(holder)) - np.repeat(np.cumsum(n1) - n1, n1)).astype(np.uint64)
    place = mixed((band[holder].astype(np.uint64) << np.uint64(40)) + (number << np.uint64(4)) + _SALT)
    who_out, sig_out = [], []
    for n, (i, j) in enumerate(PAIRS):
        some = filled[:, i] | filled[:, j]
        sig = mixed(mixed(total[some, i] + place[some]) + total[some, j] * _SALT + np.uint64(n))
        who_out.append(holder[some])
        sig_out.append(sig)
    good = np.bincount(holder[filled.sum(axis=1) >= 2], minlength=len(n1))
    for d in np.nonzero(takes & (good <= differ // 2))[0]:
        at = int(sizes[:d].sum())
        prefix = flat[at : at + sizes[d] - math.ceil(0.75 * sizes[d]) + 1]  # sets are sorted by hash
        who_out.append(np.full(len(prefix), d))
        sig_out.append(mixed((prefix + np.uint64(band[d])) * _SALT + np.uint64(7)))
    return np.concatenate(who_out), np.concatenate(sig_out)
