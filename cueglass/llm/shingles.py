"""Word shingles of whole texts as sets of 64-bit hashes, computed on Arrow buffers.

A word is a longest run of bytes other than ``\\x20`` and ``\\x09-\\x0D``, with A-Z
lower-cased. A text's set holds the hashes of its five-word shingles; a text of one to
four words has its whole word sequence as its one shingle; a text without words and a
null text have an empty set. Two shingles with one hash are taken for one; among a
billion shingles about one pair in forty does so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 19

_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20011).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.random.default_rng(40009).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each text, nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, or of one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text the number of its first word."""
    solid = _SOLID[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    first = np.flatnonzero(begins[solid])
    lengths = np.diff(first, append=int(np.count_nonzero(solid)))
    if not len(first):
        return np.empty(0, np.uint64), bounds
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTE[data[solid]] * powers[place], first)), bounds


def text_shingles(words: np.ndarray) -> np.ndarray:
    """Shingle hashes, repeats included, of the words of one text."""
    if len(words) >= WORDS:
        places = len(words) - WORDS + 1
        return mix(sum(words[i : i + places] * _WEIGHTS[i] for i in range(WORDS)))
    if not len(words):
        return words
    total = np.add.reduce(words * _WEIGHTS[: len(words)], keepdims=True)
    return mix(total + np.uint64(len(words)))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(texts)
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1]
        words, bounds = word_hashes(data[own[0] : own[-1]], own - own[0])
        for i in range(last - first):
            yield np.unique(text_shingles(words[bounds[i] : bounds[i + 1]]))
