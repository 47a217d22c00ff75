"""Word and window hashes of many texts at once, in numpy: what tasks compute over Arrow batches.

Words are maximal runs without white space, unchanged. Polynomial hashes modulo 2**64 of bytes in
a word, and of words in a window, come from differences of prefix sums, so that a window costs the
same whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = 2**64 - 1
WORD_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that are hashed in one go, and of texts that a task holds as Python objects at once; a longer text is taken alone.
SLICE_BYTES, BATCH_BYTES = 1 << 21, 1 << 23
#: Values that one stretch of a prefix sum holds; tables of powers are so long.
STRETCH = 1 << 16
_SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
_SEVERAL = re.compile(rb"  +")


def normal(text: str | None) -> bytes:
    """The words of a text, joined by one space, in UTF-8."""
    if not text:
        return b""
    raw = text.encode("utf-8", "surrogatepass").translate(_SPACES).strip(b" ")
    return _SEVERAL.sub(b" ", raw) if b"  " in raw else raw


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of limited total size; a longer text has a range of its own."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def text_ranges(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of an Arrow column, of limited total size; a longer text has a range of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def parts(batches: Iterator[pa.RecordBatch], column: str = "_text") -> Iterator[pa.RecordBatch]:
    """The batches cut into such ranges, so that what is made of a batch's texts has a bound in bytes."""
    for batch in batches:
        for lo, hi in text_ranges(batch.column(column)):
            yield batch.slice(lo, hi - lo)


def _steps(base: int) -> np.ndarray:
    """The powers of base below STRETCH."""
    out = np.full(STRETCH, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _steps(base), _steps(pow(base, -1, 2**64))


def _prefixes(x: np.ndarray, plus: int, at: np.ndarray, base: int) -> np.ndarray:
    """The sums of (x[j] + plus) * base**j for j below each of at, which ascend; x is read stretch by stretch."""
    up, out, before, power = _powers(base)[0], np.zeros(len(at), np.uint64), np.uint64(0), 1
    cuts = np.searchsorted(at, np.arange(0, len(x) + STRETCH, STRETCH), side="right").tolist()
    for k, o in enumerate(range(0, len(x), STRETCH)):
        sums = np.cumsum((x[o : o + STRETCH].astype(np.uint64) + np.uint64(plus)) * up[: min(STRETCH, len(x) - o)])
        sums *= np.uint64(power)
        sums += before
        lo, hi = cuts[k], cuts[k + 1]
        out[lo:hi] = sums[at[lo:hi] - o - 1]
        before, power = sums[-1], power * pow(base, STRETCH, 2**64) & MASK
    return out


def _spans(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int, plus: int = 0) -> np.ndarray:
    """The polynomial hash of x[lo:hi] + plus for each pair of bounds; both ascend."""
    if not len(lo):
        return np.zeros(0, np.uint64)
    out = _prefixes(x, plus, hi, base)
    out -= _prefixes(x, plus, lo, base)
    down, far = _powers(base)[1], pow(pow(base, STRETCH, 2**64), -1, 2**64)
    out *= down[lo % STRETCH]
    for k in range(1, len(x) // STRETCH + 1):
        out[np.searchsorted(lo, k * STRETCH) :] *= np.uint64(far)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a few normal texts: bounds in the joined bytes, 64-bit hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined = b" ".join(t for t in texts if t)
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        raw = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        some = [0] if len(raw) else []
        self.starts, self.ends = np.concatenate([some, gaps + 1]).astype(np.int64), np.concatenate([gaps, [len(raw)] if len(raw) else []]).astype(np.int64)
        h = _spans(raw, self.starts, self.ends, WORD_BASE, 1)
        self.hashes = mixed(h + (self.ends - self.starts).astype(np.uint64))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, valid) of the windows that start at each word; valid where they end in the same text."""
        n = len(self.hashes)
        at = np.arange(max(0, n - width + 1))
        room = np.repeat(self.first[1:], np.diff(self.first))[: len(at)]
        return mixed(_spans(self.hashes, at, at + width, WINDOW_BASE)), at + width <= room

    def all_of(self, i: int) -> np.uint64:
        """The hash of all words of text i as one window."""
        lo, hi = self.first[i : i + 2]
        return mixed(_spans(self.hashes[lo:hi], np.array([0]), np.array([hi - lo]), WINDOW_BASE))[0]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i with room."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0], span * 2
    rest = width - span
    return x if not rest else np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
