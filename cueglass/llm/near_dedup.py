"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueglass.llm.components import connected
from cueglass.llm.shingles import mix, shingle_sets
from cueglass.llm.store import written

#: 64 permutations give 128 values: a minimum and a maximum each. Four values make a
#: band, so a pair of likeness 0.75 meets in none of the 32 bands with a chance of
#: (1 - 0.75 ** 4) ** 32, five in a million.
PERMUTATIONS, BANDS = 64, 32
#: Least likeness, in percent.
LEAST = 75
#: Shingles that are permuted at once.
_COLUMNS = 1 << 14
#: Shingles of one side of a tile, about.
_TILE = 1 << 17

_FACTORS = np.random.default_rng(60013).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_WEIGHTS = np.random.default_rng(80021).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_BAND_NO = np.arange(BANDS, dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band from the minima and maxima of all permutations.

    A permutation multiplies by an odd number modulo 2 ** 64. Each product serves both
    its minimum and its maximum; a band takes minima and maxima of different
    permutations, which are independent also for small sets.
    """
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), _COLUMNS):
        shuffled = shingles[None, i : i + _COLUMNS] * _FACTORS[:, None]
        np.minimum(low, shuffled.min(axis=1), out=low)
        np.maximum(high, shuffled.max(axis=1), out=high)
    high = np.roll(high, -2)
    values = np.stack([low[0::2], low[1::2], high[0::2], high[1::2]], axis=1)
    return mix((values * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_NO)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, first, second, keys = [], [], [], []
        for own in shingle_sets(batch.column("text")):
            sizes.append(len(own))
            spread = mix(own + np.uint64(1))
            first.append(np.add.reduce(spread))
            second.append(np.bitwise_xor.reduce(spread * np.uint64(0xD6E8FEB86659FD93)))
            keys.append(band_keys(own) if len(own) else np.empty(0, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("digest"),
                pa.array(sizes, pa.int64()),
                pa.array(np.array(first, np.uint64).view(np.int64)),
                pa.array(np.array(second, np.uint64).view(np.int64)),
                _lists(keys),
            ],
            names=["doc_id", "digest", "n_shingles", "sum", "xor", "keys"],
        )


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(ends, flat.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            own = _lists(list(shingle_sets(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("class"), own], names=["class", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components that a link joins, tile by tile; rows arrive sorted by tile."""
    held: list[tuple] = []

    def links() -> tuple[list, list]:
        side = np.array([x[0] for x in held])
        group = np.array([x[1] for x in held], np.int64)
        sets = [x[2] for x in held]
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        names, counts = np.unique(group, return_counts=True)
        largest, both = names[np.argmax(counts)], len(set(side)) == 2
        seen = np.zeros(int(flat.max()) + 1, bool)
        ours, theirs = [], []
        for i in np.flatnonzero(group != largest):
            mine = flat[starts[i] : starts[i] + sizes[i]]
            seen[mine] = True
            common = np.add.reduceat(seen[flat], starts, dtype=np.int64)
            seen[mine] = False
            near = (100 * common >= LEAST * (sizes + sizes[i] - common)) & (group != group[i])
            if both:
                near &= side != side[i]
            found = np.flatnonzero(near)
            _, one = np.unique(group[found], return_index=True)
            ours += [group[i]] * len(one)
            theirs += group[found[one]].tolist()
        return ours, theirs

    def emit() -> Iterator[pa.RecordBatch]:
        if len({x[1] for x in held}) > 1:
            ours, theirs = links()
            yield pa.RecordBatch.from_arrays([pa.array(ours, pa.int64()), pa.array(theirs, pa.int64())], names=["a", "b"])
        held.clear()

    tile = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")), strict=True))
        shingles = batch.column("shingles")
        side, group = (batch.column(c).to_pylist() for c in ("side", "component"))
        for i, key in enumerate(keys):
            if key != tile:
                yield from emit()
                tile = key
            held.append((side[i], group[i], shingles[i].values.to_numpy(zero_copy_only=False).copy()))
    yield from emit()


def _is_link(common: Column, one: Column, other: Column) -> Column:
    return 100 * common >= LEAST * (one + other - common)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows with equal shingle sets form a class; only classes are compared. Classes that
    share a band key form a bucket, and buckets with the same members count once. In
    each bucket every member is compared with the class of the smallest doc_id. Pairs
    of other members that are still in different components are compared in tiles:
    a tile holds two bounded parts of one bucket and gives at most one link for each
    member and component, so a group of copies never turns into all its pairs and no
    link between components is lost.

    A null or blank text has no shingles and is linked with nothing. Rows with a null
    doc_id take part; their component_id is the smallest doc_id they are linked with,
    or null, and then they are kept. Rows that repeat a doc_id are rows of their own.
    Other columns are ignored.
    """
    named, signed, classes = _classified(docs, doc_id, text)
    component = _component_ids(classes, _components(named, classes))
    out = signed.select("doc_id", "n_shingles", "class").join(component, "class", "left")
    own = F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id")))
    return out.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"),
    )


def _classified(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with their digests; (doc_id, digest, class) and more of every row; the classes."""
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest")
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    signed = written(
        named.mapInArrow(
            _sign,
            f"doc_id {kind}, digest long, n_shingles long, sum long, xor long, keys array<long>",
        ).withColumn(
            "class", F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "sum", "xor"))
        )
    )
    classes = written(
        signed.where("class is not null")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("first"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("row"),
            F.min(F.when(F.col("doc_id").isNull(), F.col("digest"))).alias("unnamed"),
            F.any_value("n_shingles").alias("n"),
            F.any_value("keys").alias("keys"),
        )
    )
    return named, signed, classes


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all columns, of each group: the first by doc_id, then text digest.

    Rows are told apart by doc_id and text, so rows that share a doc_id but are not alike
    all stay, and rows without shingles do. Of a group's rows with a null doc_id the first
    by text digest stays as well, as nothing says that they are the named document.
    """
    taken = {c.lower() for c in docs.columns}
    key_name = "near_dedup_key"  # tells rows apart, by doc_id and text
    while key_name in taken:
        key_name += "_"
    named, _, classes = _classified(docs, doc_id, text)
    named_row = F.when(F.col("first").isNotNull(), F.struct("row.doc_id", "row.digest"))
    nobody = F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id")
    unnamed_row = F.when(F.col("unnamed").isNotNull(), F.struct(nobody, F.col("unnamed").alias("digest")))
    chosen = (
        classes.join(_components(named, classes).withColumnRenamed("node", "class"), "class", "left")
        .select(F.coalesce("label", "class").alias("label"), named_row.alias("row"), unnamed_row.alias("unnamed"))
        .groupBy("label")
        .agg(F.min("row").alias("row"), F.min("unnamed").alias("unnamed"))
        .select(F.explode(F.array("row", "unnamed")).alias(key_name))
        .where(F.col(key_name).isNotNull())
    )
    blank = F.coalesce(F.trim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    key = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"))
    one = docs.where(~blank).withColumn(key_name, key).join(chosen, key_name, "left_semi").dropDuplicates([key_name])
    return one.drop(key_name).union(docs.where(blank))


def _component_ids(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(class, component_id): the smallest doc_id of each class's component."""
    labelled = classes.select("class", "first").join(
        found.withColumnRenamed("node", "class"), "class", "left"
    )
    smallest = (
        labelled.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    )
    return labelled.join(smallest, "label", "left").select(
        "class", F.coalesce("least", "first").alias("component_id")
    )


def _components(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the classes that have links."""
    members = classes.select("class", "first", "n", F.explode("keys").alias("key"))
    buckets = (
        members.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min(F.struct("first", "class")).alias("hub"),
            F.bit_xor("class").alias("mixed"),
            F.bit_xor(F.xxhash64("class")).alias("remixed"),
        )
        .where("size > 1")
        .groupBy("size", "mixed", "remixed")
        .agg(F.min("key").alias("key"), F.any_value("hub.class").alias("hub"))
        .select("key", "size", "hub")
    )
    met = written(members.join(buckets, "key").where("class <> hub").drop("first"))
    needed = met.select("class").union(met.select("hub")).distinct()
    sets = _class_sets(named, classes.join(needed, "class"))
    hubs = sets.select(F.col("class").alias("hub"), F.col("shingles").alias("others"))
    common = F.size(F.array_intersect("shingles", "others"))
    star = connected(
        met.select("class", "hub")
        .distinct()
        .join(sets, "class")
        .join(hubs, "hub")
        .where(_is_link(common, F.size("shingles"), F.size("others")))
        .select(F.col("class").alias("a"), F.col("hub").alias("b"))
    )
    later = connected(_rest(met, star, sets)).select(
        F.col("node").alias("old"), F.col("label").alias("new")
    )
    return star.join(later, F.col("label") == F.col("old"), "full").select(
        F.coalesce("node", "old").alias("node"), F.coalesce("new", "label").alias("label")
    )


def _class_sets(named: DataFrame, chosen: DataFrame) -> DataFrame:
    """(class, shingles) of the chosen classes, from the text of one row of each."""
    wanted = chosen.select(
        "class", F.col("row.doc_id").alias("id"), F.col("row.digest").alias("hash")
    )
    same = named["doc_id"].eqNullSafe(wanted["id"]) & (named["digest"] == wanted["hash"])
    rows = named.join(wanted, same).select("doc_id", "digest", "class", "text").distinct()
    return written(
        rows.select("class", "text").mapInArrow(_sets, "class long, shingles array<long>")
    )


def _rest(met: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components that links between other members than the hubs join."""
    labelled = (
        met.where("size > 2")
        .join(found.withColumnRenamed("node", "class"), "class", "left")
        .select("key", "class", "n", F.coalesce("label", "class").alias("component"))
    )
    open_buckets = (
        labelled.groupBy("key")
        .agg(
            F.min("component").alias("one"),
            F.max("component").alias("other"),
            F.ceil(F.sum("n") / _TILE).cast("int").alias("tiles"),
        )
        .where("one <> other")
        .select("key", "tiles")
    )
    own = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    placed = (
        labelled.join(open_buckets, "key")
        .withColumn("side", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "key", "class", "component", "side",
            F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"),
        )
    )
    tile = ["key", "low", "high"]
    return (
        placed.join(sets, "class")
        .drop("class")
        .repartition(*tile)
        .sortWithinPartitions(*tile)
        .mapInArrow(_alike, "a long, b long")
    )
