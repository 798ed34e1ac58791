"""Vectorised tokens and hashes over batches of texts (numpy on UTF-8 bytes).

Texts are joined with a line break and handled about ``CHUNK`` bytes at a
time; a longer text is one chunk of its own.  A token is a run of bytes of
one class.  Token hashes are polynomial in the bytes, modulo 2**64, and
mixed, so that a token has the same hash wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SPACE, WORD, SYMBOL = 0, 1, 2

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def byte_classes(symbols: int = SYMBOL) -> np.ndarray:
    """ASCII letters, digits and all bytes of non-ASCII characters are word
    bytes; white space and control bytes separate; the rest is ``symbols``."""
    c = np.full(256, symbols, dtype=np.uint8)
    c[:33] = SPACE
    c[127] = SPACE
    c[48:58] = c[65:91] = c[97:123] = WORD
    c[128:] = WORD
    return c


def chunks(texts: list, limit: int = CHUNK, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, start of each text); ``fold``: A-Z to a-z."""
    lo, n = 0, len(texts)
    while lo < n:
        hi, size = lo, 0
        while hi < n and (hi == lo or size + len(texts[hi] or b"") < limit):
            size += len(texts[hi] or b"") + 1
            hi += 1
        part = [t or b"" for t in texts[lo:hi]]
        buf = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        buf = FOLD[buf] if fold else buf
        lens = np.fromiter(map(len, part), np.int64, len(part)) + 1
        yield lo, hi, buf, np.cumsum(lens) - lens
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Spans:
    """Hashes of byte spans of a chunk."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, CHUNK + 4096)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self.powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def tokens(buf: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of one class other than ``SPACE``."""
    c = classes[buf]
    edge = np.flatnonzero(c[1:] != c[:-1]) + 1
    bound = np.concatenate(([0], edge, [len(c)])) if len(c) else np.zeros(1, np.int64)
    start, end = bound[:-1], bound[1:]
    keep = c[start] != SPACE if len(start) else np.zeros(0, bool)
    return start[keep], end[keep]


def owners(start: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """The text (index in the chunk) that each token belongs to."""
    return np.searchsorted(text_starts, start, side="right") - 1
