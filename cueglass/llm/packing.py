"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.numbering import number_rows

#: Permitted sequence lengths in tokens. The token of this module is a UTF-8 byte.
LENGTHS = (1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens.
OVERHEAD = 64
#: Length at which attention, which grows with the square, costs as much as all else.
ATTENTION = 1 << 16
#: Documents that are packed together.
GROUP = 1 << 14


def cost(length: int, overhead: int = OVERHEAD, attention: int | None = None) -> float:
    """What a sequence of that length costs: its tokens, its overhead, and its attention."""
    return length + overhead + (length * length / attention if attention else 0)


def pack_jointly(
    sizes: list[int],
    lengths: tuple[int, ...] = LENGTHS,
    overhead: int = OVERHEAD,
    attention: int | None = ATTENTION,
) -> list[tuple[int, int, int]]:
    """``pack`` with that choice of permitted lengths whose filled bins cost least in all.

    Which lengths are worth opening depends on how the sizes at hand fill them, so every
    choice that holds the largest piece is filled on trial; bins shrink to any permitted
    length. Ties go to the choice of fewer and larger lengths.
    """
    most = max(sizes, default=0)
    best = None
    for n in range(1, len(lengths) + 1):
        for opened in combinations(sorted(lengths, reverse=True), n):
            if opened[0] < most:
                continue
            bins = pack(sizes, opened, overhead, attention, lengths)
            total = sum(cost(x, overhead, attention) for x in {own: x for own, _, x in bins}.values())
            if best is None or total < best[0]:
                best = total, bins
    return best[1]


def pack(
    sizes: list[int],
    lengths: tuple[int, ...] = LENGTHS,
    overhead: int = OVERHEAD,
    attention: int | None = None,
    shrunk_to: tuple[int, ...] | None = None,
) -> list[tuple[int, int, int]]:
    """(bin, offset in it, bin length) of each piece; sizes are 1 .. max(lengths).

    Pieces go by decreasing size. A piece goes into the open bin where it leaves the
    least room. If it fits nowhere, a bin is opened of that permitted length whose cost
    is least for each token it can still get: its length, or all that is left if that is
    less. At the end each bin shrinks to the least permitted length (``shrunk_to``, if
    more are permitted than may be opened) that holds its contents. Ties go to the earlier piece, the bin opened last
    and the smaller length.
    """
    room_of: dict[int, list[int]] = {}
    rooms, used = 0, []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    left = sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        # The set bits of rooms are the rooms that some bin has; its lowest bit from
        # ``size`` on is the best fit.
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = room_of[room].pop()
            if not room_of[room]:
                rooms ^= 1 << room
        else:
            costs = ((cost(n, overhead, attention) / min(n, left), n) for n in lengths if n >= size)
            room, own = min(costs)[1], len(used)
            used.append(0)
        placed[i] = own, used[own]
        used[own] += size
        left -= size
        room_of.setdefault(room - size, []).append(own)
        rooms |= 1 << (room - size)
    ordered = sorted(shrunk_to or lengths)
    shrunk = [next(n for n in ordered if n >= x) for x in used]
    return [(own, offset, shrunk[own]) for own, offset in placed]


def pack_documents(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    overhead: int = OVERHEAD,
    group: int = GROUP,
    attention: int | None = ATTENTION,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, first, n_tokens, bin_id, bin_length, offset) for all pieces.

    Each text is cut into pieces of the greatest permitted length and a rest; together
    the pieces hold every byte of every text once (``first`` is where a piece starts).
    Documents are numbered in the order of doc_id and size, and every ``group``
    documents after one another are packed together (``pack_jointly``), so a task's memory
    has a bound and the result depends on the rows alone. Whole pieces of the greatest length fill bins
    of their own without being gathered.

    Empty and null texts have no tokens: one row with piece 0 and no bin, so that no
    document is lost. Null and repeated doc_ids are rows of their own, equal rows are
    interchangeable; an empty table gives an empty one. Other columns are ignored.
    """
    most = max(lengths)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    slim = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"))
    numbered = number_rows(slim, ["doc_id", "size"], "row", "total")
    whole = F.floor(F.col("size") / most)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            bins = pack_jointly([r[4] for r in held], lengths, overhead, attention)
            names = ["doc_id", "row", "piece", "first", "n_tokens", "bin", "offset", "bin_length"]
            rows = [[r[i] for r in held] for i in range(5)]
            rows += [[f"{parcel}-{b}" for b, _, _ in bins], [o for _, o, _ in bins], [n for _, _, n in bins]]
            kinds = [own_type, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names
            )

        held, parcel = [], None
        for batch in batches:
            own_type = batch.schema.field("doc_id").type
            columns = ("doc_id", "row", "piece", "first", "n_tokens", "parcel")
            for *row, at in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if at != parcel:
                    if held:
                        yield packed()
                    held, parcel = [], at
                held.append(row)
        if held:
            yield packed()

    rest = numbered.where(F.col("size") % most > 0).select(
        "doc_id",
        "row",
        whole.alias("piece"),
        (whole * most).alias("first"),
        (F.col("size") % most).alias("n_tokens"),
        F.floor(F.col("row") / group).alias("parcel"),
    )
    tails = (
        rest.repartition("parcel")
        .sortWithinPartitions("parcel", "row")
        .mapInArrow(
            run,
            f"doc_id {kind}, row long, piece long, first long, n_tokens long, "
            "bin string, offset long, bin_length long",
        )
        .select("doc_id", "piece", "first", "n_tokens", F.col("bin").alias("bin_id"), "bin_length", "offset")
    )
    piece = F.explode(F.sequence(F.lit(0), whole - 1))
    full = numbered.where(whole > 0).select("doc_id", "row", piece.alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * most).alias("first"),
        F.lit(most).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin_id"),
        F.lit(most).cast("long").alias("bin_length"),
        F.lit(0).cast("long").alias("offset"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = numbered.where("size = 0").select(
        "doc_id", zero.alias("piece"), zero.alias("first"), zero.alias("n_tokens"),
        F.lit(None).cast("string").alias("bin_id"), none.alias("bin_length"), none.alias("offset"),
    )
    return tails.unionByName(full).unionByName(empty)
