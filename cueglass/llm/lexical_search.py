"""Ranked lexical search, short lists summed term by term, long lists skipped by document.

The index is inverted in blocks of documents: one row holds the lists of all searched
terms over some thousand documents, so it is built and searched without a shuffle of
its entries. A task goes through its blocks document by document in one order and keeps
each query's best so far, whose last score is the bar for all that follows. For a block
and a query

1. the short lists are summed into accumulators (term at a time);
2. these are from then on one list, with its own greatest score;
3. the lists are taken by greatest score: as long as what is left could lift a document
   over the bar by itself, its documents become candidates; after that the lists that
   are left are only looked up for candidates that can still reach the bar.

All is integer arithmetic and a bound never falls short of a score, so the result is
that of scoring all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from cueglass.llm.bit_table import bits_of
from cueglass.llm.shingles import BLOCK_BYTES, blocks, buffers
from cueglass.llm.store import written
from cueglass.llm.words import byte_class, find_words, has_bit, hash_words, lowered, slot, strings
from cueglass.operators.scale import top_per_group

#: Documents listed for each query.
LISTED = 50
#: A block of the index ends with so many documents or entries.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 20
#: A list is short if it holds at most one in so many documents of its block.
SHORT = 32
#: (query, term) rows that are searched in one pass over the index.
PASS_TERMS = 1 << 18
#: Bits of the table of searched terms: 2 MB.
TABLE_BITS = 1 << 24

_SOLID = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))


class _Terms:
    """The terms of some texts: bytes, places, hashes and number of text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_texts = len(offsets) - 1
        self.data = lowered(data)
        self.starts, self.ends, bounds = find_words(self.data, offsets, _SOLID)
        self.hashes = hash_words(self.data, self.starts, self.ends)
        self.text = np.repeat(np.arange(self.n_texts), np.diff(bounds))

    def spelled(self, which: np.ndarray) -> pa.StringArray:
        return strings(self.data, self.starts[which], self.ends[which])


def _terms_of(texts: pa.Array) -> Iterator[tuple[int, _Terms]]:
    """The number of the first text of each block, and the block's terms."""
    data, offsets = buffers(texts)
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1]
        yield first, _Terms(data[own[0] : own[-1]], own - own[0])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, terms in _terms_of(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query").take(pa.array(first + terms.text)),
                    terms.spelled(np.arange(len(terms.text))),
                    pa.array(slot(terms.hashes, TABLE_BITS)),
                ],
                names=["query", "term", "place"],
            )


INDEX = (
    "docs long, words long, terms array<string>, ends array<int>, "
    "at array<int>, tf array<long>, lengths array<long>"
)


class _Indexer:
    """Puts documents into one block of the index after another."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.entries = [], [], []
        self.n_docs = self.n_entries = 0

    def add(self, ids: pa.Array, terms: _Terms) -> None:
        """Count the searched terms of the next documents; ``ids`` are theirs."""
        searched = np.flatnonzero(has_bit(self.table, terms.hashes))
        order = searched[np.lexsort((terms.hashes[searched], terms.text[searched]))]
        text, hashes = terms.text[order], terms.hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        one = np.flatnonzero(new)
        self.ids.append(ids)
        self.lengths.append(np.bincount(terms.text, minlength=len(ids)))
        self.entries.append((self.n_docs + text[one], terms.spelled(order[one]), np.diff(one, append=len(order))))
        self.n_docs += len(ids)
        self.n_entries += len(one)

    def block(self) -> pa.RecordBatch:
        """The documents in order of id, nulls last; a list for each term, in that order too."""
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.concatenate([x[0] for x in self.entries])
        words = pa.concat_arrays([x[1] for x in self.entries]).dictionary_encode()
        number = words.indices.to_numpy()
        at, tf = place[docs], np.concatenate([x[2] for x in self.entries])
        listed = np.lexsort((at, number))
        ends = np.cumsum(np.bincount(number, minlength=len(words.dictionary)))

        def row(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = {
            "docs": pa.array([int(np.count_nonzero(lengths))]),
            "words": pa.array([int(lengths.sum())]),
            "terms": row(words.dictionary),
            "ends": row(pa.array(ends.astype(np.int32))),
            "at": row(pa.array(at[listed].astype(np.int32))),
            "tf": row(pa.array(tf[listed].astype(np.int64))),
            "lengths": row(pa.array(lengths[order].astype(np.int64))),
            "ids": row(ids.take(pa.array(order))),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _index(table: np.ndarray) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Indexer(table)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, terms in _terms_of(batch.column("text")):
                held.add(ids.slice(first, terms.n_texts), terms)
                if held.n_docs >= BLOCK_DOCS or held.n_entries >= BLOCK_ENTRIES:
                    yield held.block()
                    held.clear()
        if held.n_docs:
            yield held.block()

    return build


class _Best:
    """The best documents of one query so far: score downwards, then id, nulls last."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    @property
    def bar(self) -> int:
        """Least score that can still enter: documents to come may have smaller ids."""
        return max(self.rows[-1][0], 1) if len(self.rows) == LISTED else 1

    def add(self, rows: list[tuple]) -> None:
        ranked = sorted(self.rows + rows, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        self.rows = ranked[:LISTED]


class _Lists:
    """One block of the index, with the greatest share of a score in each list."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.ids = row["ids"]
        self.number = {term: i for i, term in enumerate(row["terms"].to_pylist())}
        ends = row["ends"].to_numpy().astype(np.int64)
        self.starts, self.ends = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends
        self.at = row["at"].to_numpy()
        tf, lengths = row["tf"].to_numpy(), row["lengths"].to_numpy()
        m = 100 - 50 + (50 * lengths * n_docs) // max(n_words, 1)
        self.parts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.at])
        self.most = np.maximum.reduceat(self.parts, self.starts) if len(ends) else np.empty(0, np.int64)
        self.n = len(lengths)

    def best(self, terms: list[tuple[str, int]], bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can reach ``bar``, by place."""
        lists = [(self.number[t], w) for t, w in terms if w > 0 and t in self.number]
        spans = [(int(self.starts[i]), int(self.ends[i]), w, w * int(self.most[i])) for i, w in lists]
        is_short = [SHORT * (b - a) <= self.n for a, b, _, _ in spans]
        every = [
            (self.at[a:b], w * self.parts[a:b], most)
            for (a, b, w, most), short in zip(spans, is_short, strict=True) if not short
        ]
        if any(is_short):
            short = [x for x, yes in zip(spans, is_short, strict=True) if yes]
            at, parts = _sums(
                np.concatenate([self.at[a:b] for a, b, _, _ in short]),
                np.concatenate([w * self.parts[a:b] for a, b, w, _ in short]),
            )
            every.append((at, parts, int(parts.max())))
        every.sort(key=lambda x: -x[2])
        places, scores = np.empty(0, np.int32), np.empty(0, np.int64)
        left = sum(most for _, _, most in every)
        for at, parts, most in every:
            if left >= bar:
                places, scores = _sums(np.concatenate([places, at]), np.concatenate([scores, parts]))
                if len(scores) >= LISTED:
                    bar = max(bar, int(np.partition(scores, -LISTED)[-LISTED]))
            else:
                can = scores + left >= bar
                places, scores = places[can], scores[can]
                if not len(places):
                    break
                hit = np.minimum(np.searchsorted(at, places), len(at) - 1)
                scores = scores + np.where(at[hit] == places, parts[hit], 0)
            left -= most
        reached = scores >= bar
        return places[reached], scores[reached]


def _sums(at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.add.reduceat(parts[order], first)


def _search(queries: list[tuple], n_docs: int, n_words: int, kinds: list[pa.DataType]) -> Callable:
    """Task function: (query, doc_id, score) of the best documents of the task's blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best() for _ in queries]
        for batch in batches:
            for i in range(len(batch)):
                lists = _Lists({c: batch.column(c)[i].values for c in batch.schema.names}, n_docs, n_words)
                for (_, terms), mine in zip(queries, best, strict=True):
                    places, scores = lists.best(terms, mine.bar)
                    if len(places) > LISTED:
                        top = np.lexsort((places, -scores))[:LISTED]
                        places, scores = places[top], scores[top]
                    if len(places):
                        ids = lists.ids.take(pa.array(places)).to_pylist()
                        mine.add(list(zip(scores.tolist(), ids, strict=True)))
        found = [(q, row[1], row[0]) for (q, _), mine in zip(queries, best, strict=True) for row in mine.rows]
        if found:
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["query", "doc_id", "score"]
            )

    return search


def search_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the 50 highest-scoring documents of each item.

    Rows of ``items`` that repeat an id are one query with the terms of all of them. Null
    and empty texts have no terms: such a document is found by no query and does not count
    among the documents, such an item has no rows. Rows that repeat a doc_id are documents
    of their own; equal scores are ordered by doc_id, nulls last. Empty tables give an
    empty table; other columns are ignored. In one block of half a megabyte two terms of
    one document with one 64-bit hash would be counted as one.

    The index is read once for each half ``PASS_TERMS`` (item, term) rows; about that many
    come to the driver at a time and go to the tasks.
    """
    asked = written(
        items.select(F.col(item_id).alias("query"), F.col(item_text).alias("text"))
        .where("query is not null and text is not null")
        .mapInArrow(_query_terms, f"query {items.schema[item_id].dataType.simpleString()}, term string, place long")
        .distinct()
    )
    kind = docs.schema[doc_id].dataType
    index = written(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
            _index(bits_of(asked, "place", TABLE_BITS)), f"{INDEX}, ids array<{kind.simpleString()}>"
        )
    )
    total = index.agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = total[0] or 0, total[1] or 0
    sizes = F.zip_with(
        "ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)), lambda a, b: a - b
    ).alias("n")
    held = index.where(F.size("terms") > 0).select("terms", sizes).select(F.explode(F.arrays_zip("terms", "n")).alias("x"))
    known = held.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weighed = asked.join(known, "term").select("query", "term", weight.cast("bigint").alias("w"))
    weighed = written(weighed)
    passes = -(-2 * weighed.count() // PASS_TERMS)
    kinds = [asked.schema["query"].dataType, kind, LongType()]
    schema = StructType([StructField(n, k) for n, k in zip(("query", "doc_id", "score"), kinds, strict=True)])
    found = asked.sparkSession.createDataFrame([], schema)
    for k in range(passes):
        queries: dict = {}
        for query, term, w in weighed.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == k).collect():
            queries.setdefault(query, []).append((term, w))
        task = _search(list(queries.items()), n_docs, n_words, [to_arrow_type(x) for x in kinds])
        found = found.unionByName(index.drop("docs", "words").mapInArrow(task, schema))
    best = top_per_group(found, ["query"], [F.desc("score"), F.asc_nulls_last("doc_id")], LISTED)
    return best.select(F.col("query").alias("item_id"), "rank", "doc_id", "score")
