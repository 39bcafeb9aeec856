"""Vectorised word splitting and hashing over Arrow batches of texts.

Functions run inside tasks on the bytes of many texts at once: Spark deals out
and gathers the rows, numpy does the arithmetic within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (more only for a single longer text).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over the 256 byte values, true inside the ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: Everything but ASCII white space.
NOT_SPACE = ~byte_class((9, 13), (32, 32))
#: ASCII letters and every byte of a non-ASCII character.
LETTERS = byte_class((65, 90), (97, 122), (128, 255))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Slice:
    """Some texts of a batch: `data` holds their bytes one after the other,
    text i from bounds[i] to bounds[i + 1]; `rows` are their places in the batch."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string array (null: empty) in slices of about
    `limit` bytes, without copying text by text."""
    arr = texts.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if len(arr) == 0:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(arr))
        yield Slice(slice(lo, hi), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def word_spans(part: Slice, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words: runs of word bytes within one text."""
    mask = is_word[part.data]
    before = np.empty_like(mask)
    if len(mask):
        before[0] = False
        before[1:] = mask[:-1]
        first = part.bounds[:-1]
        before[first[first < len(mask)]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    if len(mask):
        after[-1] = False
        after[:-1] = mask[1:]
        last = part.bounds[1:-1]
        after[last[last > 0] - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def word_counts(part: Slice, starts: np.ndarray) -> np.ndarray:
    """Place of the first word of each text, and the number of words at the end."""
    return np.searchsorted(starts, part.bounds)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _CACHE or len(_CACHE[base]) < n:
        _CACHE[base] = _powers(base, max(n, SLICE_BYTES + 1))
    return _CACHE[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (SplitMix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A random 64-bit value for each byte value.
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for every run; equal runs have equal hashes
    wherever they stand. A polynomial over 2**64, scrambled with the length."""
    n = len(values)
    total = np.zeros(n + 1, _U)
    np.cumsum(values * powers(_BASE, n), out=total[1:], dtype=_U)
    h = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(h ^ mix((ends - starts).astype(_U)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return run_hashes(_BYTES[data], starts, ends)
