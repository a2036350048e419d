"""Sets of word shingles as sorted 64-bit hashes, computed for many whole texts at once."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0xD1342543DE82EF95)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    packed = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    flat = np.frombuffer(b" ".join([*packed, b""]), np.uint8)
    gap = _SEPARATOR[flat]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    limits = np.cumsum([len(p) + 1 for p in packed])
    per_text = np.diff(np.searchsorted(starts, limits), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    sizes = ends - starts
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    inside = np.flatnonzero(~gap)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return mixed(np.add.reduceat(_BYTE[flat[inside]] * powers[place], np.cumsum(sizes) - sizes)), per_text


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; of fewer words the whole sequence is one."""
    words, counts = word_hashes(texts)
    n = len(words) - size + 1
    whole = mixed(sum((words[j : j + n] * _PLACE[j] for j in range(size)), np.zeros(max(n, 0), np.uint64))) if n > 0 else words[:0]
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(whole[at : at + c - size + 1]))
        else:
            few = words[at : at + c]
            out.append(mixed((few * _PLACE[size : size + c]).sum(keepdims=True) + np.uint64(c)) if c else few)
        at += c
    return out


def set_key(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a whole set; 0 for the empty one."""
    if not len(shingles):
        return 0
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64) * _BASE
    key = mixed((mixed(shingles ^ place)).sum(keepdims=True) + np.uint64(len(shingles)))[0]
    return int(key.astype(np.int64)) or 1
