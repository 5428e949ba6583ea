"""A small symbol set for language models of raw text, and n-grams of symbols as numbers."""

from __future__ import annotations

import numpy as np

BITS = 6

_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_PUNCTUATION = b".,;:!?'\"()-_/|#*$%&<>=+@[]{}"


def _symbol(b: int) -> int:
    """64 symbols: letters without case, digit, white space, single marks, and folded bytes of other characters."""
    if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A:
        return 1 + (b | 0x20) - 0x61
    if 0x30 <= b <= 0x39:
        return 27
    if b in _SPACE:
        return 28
    if b in _PUNCTUATION:
        return 29 + min(18, _PUNCTUATION.index(b))
    return 48 + (b & 15) if b >= 0x80 else 0


SYMBOLS = np.array([_symbol(b) for b in range(256)], dtype=np.uint32)


def symbol_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all ``order``-grams (at most 5) of symbols, each text led by order - 1 spaces, and the texts' bounds."""
    lead = b" " * (order - 1)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = SYMBOLS[np.frombuffer(b"".join(lead + t for t in texts) or b" ", dtype=np.uint8)]
    codes = raw[: max(0, len(raw) - order + 1)].copy()
    for i in range(1, order):
        codes <<= np.uint32(BITS)
        codes |= raw[i : len(codes) + i]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    begin = np.repeat(np.arange(len(texts)) * (order - 1), sizes)
    return codes[np.arange(bounds[-1]) + begin], bounds
