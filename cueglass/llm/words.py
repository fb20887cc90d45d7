"""Words of whole texts as places and 64-bit hashes, computed on Arrow buffers.

Which bytes make up words is a table of 256 flags, so a caller chooses its own word
rule; A-Z are lower-cased and every other byte is kept. Memory grows with one block of
texts (``shingles.BLOCK_BYTES``) or with the longest text, never with a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cueglass.llm.shingles import mix

_KEPT = np.arange(256, dtype=np.uint8)
_KEPT[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(70001).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_UNDO = pow(_STEP, -1, 1 << 64)
_TURNS = np.random.default_rng(70003).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
#: Bytes of words that are hashed at once; a longer word is hashed by itself.
_SPAN = 1 << 18


def byte_class(but: bytes, and_above: bool = True) -> np.ndarray:
    """Flags of all bytes except those of ``but``; bytes of non-ASCII letters count or not."""
    flags = np.ones(256, bool)
    flags[list(but)] = False
    flags[0x80:] = and_above
    return flags


def lowered(data: np.ndarray) -> np.ndarray:
    return _KEPT[data]


def find_words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in order, and for each text the number of its first word."""
    inside = solid[data]
    begins, lasts = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[texts] = inside[texts]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    lasts[ends] = inside[ends]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(lasts) + 1, np.searchsorted(starts, offsets)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word of lower-cased ``data``, the same wherever the word stands.

    A word's hash is a polynomial in its bytes: the difference of two running sums,
    moved back to place 0.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + _SPAN, "right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[data[low:high]] * _powers(_STEP, high - low), out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        back = _powers(_UNDO, int(a[-1]) + 1)
        out[first:last] = (sums[b] - sums[a]) * back[a]
        first = last
    return mix(out)


def hash_phrases(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, without a look at where texts end."""
    places = max(len(words) - size + 1, 0)
    if size == 1:
        return words
    return mix(sum(words[i : i + places] * _TURNS[i] for i in range(size)) + np.uint64(size))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The bytes from each start to each end as strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], lengths)
    flat = np.ascontiguousarray(data[places])
    return pa.LargeStringArray.from_buffers(
        len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)
    ).cast(pa.string())


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set in a table of ``8 * len(bits)`` bits."""
    at = slot(hashes, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def slot(hashes: np.ndarray, size: int) -> np.ndarray:
    """Place of each hash in a table of ``size`` bits, a power of two: its uppermost bits."""
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)

