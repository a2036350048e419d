"""Content-defined anchors of byte strings: equal windows hold the same anchor at the same place."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(31)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
_PLACE = np.uint64((1 << 24) - 1)
PIECE = 1 << 20


@functools.cache
def hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Hashes of any stretch of a byte string."""

    def __init__(self, flat: np.ndarray):
        self.up, self.down = hash_powers(1 << max(16, len(flat).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * self.up[: len(flat)])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.down[a])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces(packed: list[bytes], window: int, limit: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, start, bytes) in batches of about ``limit`` bytes; long texts in pieces
    that overlap by a window."""
    held, size = [], 0
    for k, text in enumerate(packed):
        for a in range(0, max(len(text) - window, 0) + 1, limit):
            piece = text[a : a + limit + window - 1]
            if held and size + len(piece) > limit:
                yield held
                held, size = [], 0
            held.append((k, a, piece))
            size += len(piece)
    if held:
        yield held


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes, np.ndarray]:
    """(text number, place, hash) of the anchors of texts (their length in all under 2^24
    bytes): in each window of ``window`` bytes the ``gram`` bytes of smallest hash, the first of
    equals. Also the hashes of the joined texts and where each begins in them."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = Hashes(flat)
    none = np.zeros(0, np.int64)
    if len(flat) < window:
        return none, none, none.astype(np.uint64), hashes, starts
    at = np.arange(len(flat) - gram + 1)
    h = hashes.of(at, at + gram)
    low = sliding_min((h & ~_PLACE) | at.astype(np.uint64), window - gram + 1)
    ok = np.zeros(len(low), bool)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= window:
            ok[a : a + n - window + 1] = True
    place = np.unique(low[ok] & _PLACE).astype(np.int64)
    return np.searchsorted(starts, place, side="right") - 1, place, h[place], hashes, starts
