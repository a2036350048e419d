"""Words of whole texts as bytes: maximal runs without space, tab, line or form feeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

GAP = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def word_pieces(data: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words in order, in lists from about ``limit`` bytes each, cut between words."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + limit) if at + limit < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()  # of bytes, split() cuts at exactly these separators
        at = end
