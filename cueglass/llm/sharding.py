"""A reproducible shuffle into shards by a Feistel permutation of row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.numbering import number_rows
from cueglass.llm.shingles import mix

ROUNDS = 4


def _round_keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(total: int) -> np.uint64:
    return np.uint64(max(1, ((max(total, 2) - 1).bit_length() + 1) // 2))


def _feistel(x: np.ndarray, bits: np.uint64, keys: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. 2 ** (2 * bits) - 1."""
    mask = np.uint64((1 << int(bits)) - 1)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return (right << bits) | left


def _walk(x: np.ndarray, total: int, bits: np.uint64, keys: np.ndarray) -> np.ndarray:
    """Walk each value along its cycle until it falls below ``total`` again.

    The walk starts below ``total``, so it comes back there at the latest at its start;
    the domain is below four times ``total``, so it takes four steps on average.
    """
    x = _feistel(x, bits, keys)
    while (outside := x >= np.uint64(total)).any():
        x[outside] = _feistel(x[outside], bits, keys)
    return x


def place_of(rows: np.ndarray, total: int, seed: int) -> np.ndarray:
    """New place of each row number, a permutation of 0 .. total - 1."""
    return _walk(rows.astype(np.uint64), total, _half_bits(total), _round_keys(seed)).astype(np.int64)


def row_at(places: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Row number that ``place_of`` puts at each place: the rounds in reverse."""
    keys = _round_keys(seed)[::-1]
    return _walk(places.astype(np.uint64), total, _half_bits(total), keys).astype(np.int64)


def shuffle_into_shards(
    docs: DataFrame,
    shards: int,
    seed: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Rows are numbered in the order of doc_id, size and checksum, and the permutation of
    0 .. n - 1 gives each its place p: shard ``p % shards``, slot ``p // shards``. So
    row counts differ by one at most (law ``rows``), slots have no gaps, and anybody can
    compute where row i is, or with ``row_at`` which row is in a slot, without the data.
    ``grown_shard`` belongs to the law ``key`` and is null.

    The result depends on the rows and the seed alone, not on files or partitions. Null
    doc_ids sort first; a null text counts as empty; equal rows are interchangeable; an
    empty table gives an empty one. Texts stay where they are: only ids, sizes and
    checksums are moved. Other columns are ignored.
    """
    known = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(known) + F.lit(16)).cast("long").alias("size"),
        F.crc32(known.cast("binary")).alias("text_crc32"),
    )

    @F.pandas_udf("long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, totals in parts:
            total = int(totals.iloc[0]) if len(totals) else 0
            yield pd.Series(place_of(rows.to_numpy(), total, seed))

    numbered = number_rows(slim, ["doc_id", "size", "text_crc32"], "row", "total")
    return numbered.withColumn("place", place("row", "total")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
