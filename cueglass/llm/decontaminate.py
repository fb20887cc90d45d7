"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

Texts are compared as bytes with letters in lower case and every run of other ASCII
characters as one space. The windows of a benchmark item are all of its stretches of 96
bytes, one from each place on; a shorter item is one window. A document holds a window
if a part of it is within ``edits`` edits of the window, one in ten bytes. Such a part
shares at least ``m + 1 - Q - Q * edits`` q-grams with a window of m bytes, and they lie
on at most ``edits + 1`` neighbouring diagonals. So the q-grams that a text shares with
an item are put into bands of twice that many diagonals, each overlapping the next by
half, and the windows whose stretch of a band reaches the bound are aligned there. Up to
``SKIPPED`` frequent q-grams of a window are not looked up, and its bound is lowered by
their number, so this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.shingles import BLOCK_BYTES, blocks, buffers

Q = 8
WINDOW = 96
#: Bytes for each edit that a window may differ by.
PER_EDIT = 10
#: Most frequent q-grams of a window that are not looked up, at most.
SKIPPED = 8
#: Windows that are aligned at once.
_ALIGNED = 1 << 12
#: Bytes of benchmark text that are searched for in one pass over the documents.
PASS_BYTES = 1 << 20

_SPACE, _END = 0x20, 0
_FOLDED = np.full(256, _SPACE, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLDED[_a:_b] = np.arange(_a, _b)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
_BITS = np.uint64(22)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Index(NamedTuple):
    """Benchmark items, their windows, and where their q-grams stand."""

    items: list  # item of each window
    texts: np.ndarray  # all items one after another
    starts: np.ndarray  # of each window in texts
    lengths: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray  # of each item in texts
    first: np.ndarray  # bounds of each item's windows
    same: np.ndarray  # first of the items with the same name
    needed: np.ndarray  # shared q-grams of a window of the item, at least
    grams: np.ndarray  # sorted
    lists: np.ndarray  # bounds of each gram's places
    places: np.ndarray  # in texts
    filter: np.ndarray


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each ended by a zero; their offsets; where each byte was."""
    folded = _FOLDED[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals among the accented Latin letters
    capital = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    folded[capital] += 0x20
    blank = folded == _SPACE
    kept = np.ones(len(data), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    edges = offsets[:-1][offsets[:-1] < len(data)]
    kept[edges] = True
    origin = np.flatnonzero(kept)
    counts = np.concatenate([[0], np.cumsum(kept)])[offsets]
    ends = counts[1:] + np.arange(1, len(offsets))
    out = np.zeros(len(origin) + len(offsets) - 1, np.uint8)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = folded[origin]
    where = np.empty(len(out), np.int64)
    where[own] = origin
    where[ends - 1] = offsets[1:]
    return out, np.concatenate([[0], ends]), where


def _grams(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    x = text.astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        x = x[:-step] | (x[step:] << np.uint64(bits))
    return x


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _SPREAD) >> (np.uint64(64) - _BITS)


def build_index(items: list, texts: list[str | None]) -> Index | None:
    """Index of items; those below ``Q`` folded bytes are too short to be evidence."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    folded, ends, _ = fold(data, offsets - offsets[0])
    owners, parts = [], []
    for i, item in enumerate(items):
        own = folded[ends[i] : ends[i + 1] - 1]
        lead = int(len(own) > 0 and own[0] == _SPACE)
        own = own[lead : len(own) - int(len(own) > lead and own[-1] == _SPACE)]
        if len(own) >= Q:
            owners.append(item)
            parts.append(own)
    if not parts:
        return None
    sizes = np.array([len(p) for p in parts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    length = np.minimum(sizes, WINDOW)
    budget = np.maximum(0, np.minimum(length // PER_EDIT, length // Q - 2))
    shared = length + 1 - Q - Q * budget
    skipped = np.minimum(SKIPPED, shared - 1)
    windows = sizes - length + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(parts)), windows)
    # The q-grams of a window stand in two stretches of that many places at most, so
    # half of those skipped may come from each; an item of one window is one stretch.
    counts = sizes - Q + 1
    item = np.repeat(np.arange(len(parts)), counts)
    local = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = np.concatenate([_grams(p) for p in parts])
    _, back, often = np.unique(grams, return_inverse=True, return_counts=True)
    stretch = bounds[item] + local // (WINDOW - Q + 1) * (sizes > WINDOW)[item]
    order = np.lexsort((-often[back], stretch))
    heads = np.flatnonzero(np.diff(stretch[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
    most = np.where(sizes > WINDOW, skipped // 2, skipped)
    kept = np.sort(order[rank >= most[item[order]]])
    kept = kept[np.argsort(grams[kept], kind="stable")]
    known, begins = np.unique(grams[kept], return_index=True)
    table = np.zeros(1 << int(_BITS), bool)
    table[_slot(known)] = True
    names: dict = {}
    return Index(
        [owners[i] for i in owner], np.concatenate(parts), bounds[owner] + np.arange(len(owner)) - first[owner],
        length[owner], budget[owner], bounds, first, np.array([names.setdefault(x, i) for i, x in enumerate(owners)]),
        shared - skipped, known, np.append(begins, len(kept)), (bounds[item] + local)[kept], table,
    )


class _Candidates(NamedTuple):
    """Windows that share enough q-grams with a text in a band of diagonals."""

    text: np.ndarray
    window: np.ndarray
    low: np.ndarray  # where the band's first diagonal meets the window's first byte
    near: np.ndarray  # the same for the diagonal of one shared q-gram


def _candidates(folded: np.ndarray, ends: np.ndarray, index: Index) -> _Candidates:
    """Band b of an item with e edits covers the diagonals from b * (e + 1) to below
    (b + 2) * (e + 1)."""
    none = _Candidates(*[np.empty(0, np.int64)] * 4)
    if len(folded) < Q:
        return none
    grams = _grams(folded)
    at = np.flatnonzero(index.filter[_slot(grams)])
    gram = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    same = index.grams[gram] == grams[at]
    at, gram = at[same], gram[same]
    counts = index.lists[gram + 1] - index.lists[gram]
    total = int(counts.sum())
    if not total:
        return none
    place = index.places[np.arange(total) + np.repeat(index.lists[gram] - (np.cumsum(counts) - counts), counts)]
    at = np.repeat(at, counts)
    n_items = len(index.needed)
    item = np.searchsorted(index.bounds, place, "right") - 1
    text = np.searchsorted(ends, at, "right") - 1
    sizes, budget = np.diff(index.bounds), index.edits[index.first[:-1]]
    # Diagonals are counted from the text's start and moved up so that none is negative.
    up = int(sizes.max()) + 2 * WINDOW
    band = (at - ends[text] - (place - index.bounds[item]) + up) // (budget[item] + 1)
    width = int(band.max()) + 2
    key = (text * n_items + item) * width + band
    keys, found = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    keys = keys[found >= index.needed[keys // width % n_items]]
    if not len(keys):
        return none
    # Shared q-grams of each band that is left, in the order of the item.
    hits = []
    for own in (key, key - 1):
        group = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[group] == own)
        hits.append((group[hit] * len(index.texts) + place[hit], (at - place)[hit]))
    spots, one = np.unique(np.concatenate([x[0] for x in hits]), return_index=True)
    shift = np.concatenate([x[1] for x in hits])[one]
    group, place = spots // len(index.texts), spots % len(index.texts)
    item = keys[group] // width % n_items
    length = np.minimum(sizes, WINDOW)[item]
    last = np.arange(len(spots)) + index.needed[item] - 1
    end = np.minimum(last, len(spots) - 1)
    enough = (last == end) & (group[end] == group) & (place[end] - place <= length - Q)
    begin = np.flatnonzero(enough)
    group, item, length = group[begin], item[begin], length[begin]
    lowest = np.maximum(place[end[begin]] - (length - Q), index.bounds[item])
    highest = np.minimum(place[begin], index.bounds[item + 1] - length)
    if not len(begin):
        return none
    heads = np.ones(len(begin), bool)
    heads[1:] = (group[1:] != group[:-1]) | (lowest[1:] > highest[:-1] + 1)
    tails = np.append(heads[1:], True)
    lowest, group, item = lowest[heads], group[heads], item[heads]
    counts = highest[tails] - lowest + 1
    start = np.arange(int(counts.sum())) + np.repeat(lowest - (np.cumsum(counts) - counts), counts)
    group, item = np.repeat(group, counts), np.repeat(item, counts)
    text = keys[group] // width // n_items
    local = start - index.bounds[item]
    return _Candidates(
        text,
        index.first[item] + local,
        keys[group] % width * (budget[item] + 1) - up + ends[text] + local,
        start + shift[np.searchsorted(spots, group * len(index.texts) + start)],
    )


def _align(folded: np.ndarray, ends: np.ndarray, index: Index, found: _Candidates) -> tuple[np.ndarray, ...]:
    """Least edits of each window to a part of the text in its band; the part's bounds.

    Windows that stand in the text letter by letter need no alignment. The others of one
    length are aligned together, row by row over the diagonals of the band and as many
    more on both sides as there may be edits. A cell holds edits and the diagonal its
    alignment began on in one number.
    """
    edits = np.zeros(len(found.text), np.int64)
    begin, end = found.near.copy(), found.near + index.lengths[found.window]
    lengths = index.lengths[found.window]
    for length in np.unique(lengths).tolist():
        chosen = np.flatnonzero(lengths == length)
        for first in range(0, len(chosen), _ALIGNED):
            own = chosen[first : first + _ALIGNED]
            row = np.arange(length)[:, None]
            items = index.texts[index.starts[found.window[own]] + row]
            near = begin[own] + row
            letters = folded[np.clip(near, 0, len(folded) - 1)]
            rest = (letters != items).any(axis=0) | (near[0] < 0) | (near[-1] >= len(folded))
            own, items = own[rest], items[:, rest]
            if not len(own):
                continue
            t = found.text[own]
            e = int(index.edits[found.window[own[0]]])
            low = found.low[own] - e
            width = 2 * (e + 1) + 2 * e
            scale = 64  # above any width, and small enough for cells of 16 bits
            at = low + np.arange(length + width)[:, None]
            inside = (at >= ends[t]) & (at < ends[t + 1] - 1)
            letters = np.where(inside, folded[np.clip(at, 0, len(folded) - 1)], _END)
            column = np.arange(width, dtype=np.int16)[:, None]
            ramp = column * np.int16(scale)
            cells = np.repeat(column, len(own), axis=1)
            for i in range(length):
                stepped = cells + (letters[i : i + width] != items[i]) * np.int16(scale)
                np.minimum(stepped[:-1], cells[1:] + np.int16(scale), out=stepped[:-1])
                stepped -= ramp
                cells = np.minimum.accumulate(stepped, axis=0)
                cells += ramp
            best = cells.argmin(axis=0)
            value = cells[best, np.arange(len(own))].astype(np.int64)
            edits[own] = value // scale
            begin[own] = low + value % scale
            end[own] = low + best + length
    return edits, begin, end


def _search(texts: pa.Array, index: Index) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item, start, end, edits) of all regions; start and end in code points."""
    data, offsets = buffers(texts)
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1]
        raw = data[own[0] : own[-1]]
        folded, ends, origin = fold(raw, own - own[0])
        own_windows = _candidates(folded, ends, index)
        edits, begin, end = _align(folded, ends, index, own_windows)
        found = np.flatnonzero(edits <= index.edits[own_windows.window])
        if not len(found):
            continue
        text = own_windows.text[found]
        item = index.same[np.searchsorted(index.first, own_windows.window[found], "right") - 1]
        begin, end = np.maximum(begin[found], ends[text]), np.minimum(end[found], ends[text + 1] - 1)
        order = np.lexsort((begin, item, text))
        text, item, begin, end, edits = text[order], item[order], begin[order], end[order], edits[found][order]
        other = np.ones(len(found), bool)
        other[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        # The largest end so far, in each text and item.
        part = np.cumsum(other) * (len(folded) + 1)
        reach = np.maximum.accumulate(end + part) - part
        other[1:] |= begin[1:] > reach[:-1]
        heads = np.flatnonzero(other)
        for t, i, a, b, e in zip(
            text[heads].tolist(), item[heads].tolist(), begin[heads].tolist(),
            np.maximum.reduceat(end, heads).tolist(), np.minimum.reduceat(edits, heads).tolist(), strict=True,
        ):
            begins = int(own[t] - own[0])
            points = [len(bytes(raw[begins : origin[x]]).decode(errors="ignore")) for x in (a, b)]
            yield first + t, index.items[index.first[i]], *points, e


def _passes(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """Indexes of the benchmark, one for each ``PASS_BYTES`` of its text."""
    items, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).toLocalIterator()
    for item, own in rows:
        items.append(item)
        texts.append(own)
        size += len((own or "").encode())
        if size >= PASS_BYTES:
            if (index := build_index(items, texts)) is not None:
                yield index
            items, texts, size = [], [], 0
    if items and (index := build_index(items, texts)) is not None:
        yield index


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): regions of documents that hold benchmark text.

    One row for each region, where overlapping windows of an item are one region; start
    and end are code points of the text, edits those of its closest window. The
    benchmark is searched for in passes of about ``PASS_BYTES``, each one scan of the
    whole texts without a shuffle, so what is sent to the tasks has a bound.

    Null and empty texts hold nothing, and null or very short items (below 8 folded
    bytes) are held by nothing; a null doc_id or item_id is reported as null. Repeated
    rows are reported for each; repeated items with one item_id as one. Other columns
    are ignored. Empty tables give an empty result.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits long"
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    context, out = docs.sparkSession.sparkContext, None
    for index in _passes(benchmark, item_id, item_text):
        shared = context.broadcast(index)  # a few dozen bytes for each byte of one pass

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(zip(*_search(batch.column("text"), shared.value), strict=True))
                if found:
                    rows, *columns = found
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), *map(pa.array, columns)],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        own = slim.mapInArrow(run, schema)
        out = own if out is None else out.union(own)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no benchmark passage stands."""
    context = docs.sparkSession.sparkContext
    for index in _passes(benchmark, item_id, item_text):
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [row for row, *_ in _search(batch.column(text), shared.value)]
                clean = np.ones(len(batch), bool)
                clean[held] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
