"""Bottom-k sketches of shingle hashes as document fingerprints.

The sketch of a set of shingles holds its ``K`` smallest hashes. The sketch of a union
comes from two sketches alone, so a text's sketch can be merged from its parts'. From
sketches follow estimates of resemblance, containment and the number of distinct
shingles. Sets of up to ``K`` shingles are kept whole and compared exactly.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.shingles import shingle_sets

K = 128
_SPAN = float(1 << 64)


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest of sorted distinct hashes."""
    return shingles[:k]


def merge(one: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(one, other)[:k]


def _of_union(one: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The union's sketch, and which of its hashes are in both sets.

    If one set is kept whole, so is all that is known of the other up to its last hash.
    """
    both = merge(one, other, k)
    return both, np.isin(both, one, assume_unique=True) & np.isin(both, other, assume_unique=True)


def resemblance(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard likeness; two empty sets are alike."""
    both, shared = _of_union(one, other, k)
    return float(shared.mean()) if len(both) else 1.0


def distinct(own: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below ``k``."""
    if len(own) < k:
        return float(len(own))
    return (k - 1) / (float(own[k - 1]) / _SPAN)


def containment(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """Estimate of the part of the first set that is in the second; 1 for an empty one."""
    both, shared = _of_union(one, other, k)
    size = distinct(one, k)
    return min(1.0, float(shared.mean()) * distinct(both, k) / size) if size else 1.0


def to_text(own: np.ndarray) -> str:
    """A sketch as base64 of its little-endian hashes."""
    return base64.b64encode(own.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


#: Ranges of doc_id for each shuffle partition; more of them even out the tasks.
RANGES = 4


def _neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows in ranges of descending (doc_id, tie), each range followed by the row after it.

    Spark deals the keys alone into ranges of about equal size, so that neither one id on
    many rows nor all null ids make a large range. Of each range the driver learns its
    largest key, so what it holds grows with the number of ranges alone. The rows that
    carry it go to the range before as well, marked as guests that sort last, where the
    first of them is the successor of the range's own last row. The first range's largest
    row is the last range's guest.
    """
    dealt = (
        docs.select("doc_id", "tie")
        .repartitionByRange(ranges, F.desc_nulls_last("doc_id"), F.desc("tie"))
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    )

    def in_order(own_id, tie) -> tuple:
        return (False, tie) if own_id is None else (True, own_id, tie)

    found = sorted(((r["head"]["doc_id"], r["head"]["tie"]) for r in dealt.collect()), key=lambda h: in_order(*h))
    rising = [in_order(*h) for h in found]

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, ties: pa.Array) -> pa.Array:
        # Range 0 holds the largest keys; nulls come after all others.
        keys = (in_order(*key) for key in zip(ids.to_pylist(), ties.to_pylist(), strict=True))
        return pa.array([len(rising) - 1 - bisect_left(rising, key) for key in keys], pa.int32())

    placed = docs.withColumn("range", range_of("doc_id", "tie"))
    heads = [(i, *head) for i, head in enumerate(reversed(found))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.sparkSession.createDataFrame(
        [(*head, heads[i - 1][0]) for i, head in enumerate(heads)],
        f"range int, head_id {kind}, head_tie long, guest_of int",
    )
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("guest_of").alias("to"), F.lit(True).alias("guest"))
    seats = F.when(is_head, F.array(own, guest)).otherwise(F.array(own))
    return (
        placed.join(F.broadcast(table), "range")  # one row for each range
        .select("doc_id", "tie", "text", F.explode(seats).alias("seat"))
        .select("doc_id", "tie", "text", "seat.to", "seat.guest")
        .repartition("to")
        .sortWithinPartitions("to", "guest", F.desc_nulls_last("doc_id"), F.desc("tie"), F.desc("text"))
    )


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of an edited text, and two likenesses.

    In descending order of doc_id (nulls last, ties by a hash of the text) a row's
    edited text has its last third (rounded down, in code points) replaced by as many
    first code points, or all, of the next row's text; the first row follows the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited (the text against the edited text) and near_next (against the next
    text). A null text counts as empty; an empty text has an empty fingerprint, and two
    of them are alike. Repeated rows are rows of their own. An empty table gives an
    empty one. ``doc_id`` is of any type with an order. Other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("tie", F.xxhash64("text"))
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose successor has not come yet
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = part.column("text")
                rows = zip(
                    *(part.column(c).to_pylist() for c in ("doc_id", "to", "guest", "text")),
                    (sketch(x, k) for x in shingle_sets(texts)),
                    strict=True,
                )
                pairs = []
                for row in rows:
                    if last is not None:
                        pairs.append((last, row))
                    last = None if row[2] else row
                if not pairs:
                    continue
                edited = []
                for (_, _, _, own, _), (_, _, _, following, _) in pairs:
                    cut = len(own) // 3
                    edited.append(own[: len(own) - cut] + following[:cut])
                out = []
                sketches = (sketch(x, k) for x in shingle_sets(pa.array(edited, pa.string())))
                for (own, following), new, other in zip(pairs, edited, sketches, strict=True):
                    out.append((
                        own[0], len(own[3]), hashlib.sha256(new.encode()).hexdigest(),
                        to_text(own[4]), to_text(other),
                        resemblance(own[4], other, k), resemblance(own[4], following[4], k),
                    ))
                columns = zip(zip(*out, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=names)

    return _neighbours(slim, ranges).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
