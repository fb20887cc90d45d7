"""SimHash fingerprints, linked at two or fewer differing bits by Golay-code hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that
differ in two bits at most agree in one segment, and differ in at most two bits of the
segment after it. That segment is taken for a word of 23 bits and decoded with the
binary Golay code: its indices are the codewords within four bits, one or six of them,
and any two words that differ in two bits at most have such a codeword in common (a
test goes through all cases). So the exact segment and one index make a key of 33 or 34
bits, each fingerprint has 3 to 18 keys, and every link has a key in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.components import connected
from cueglass.llm.shingles import BLOCK_BYTES, blocks, buffers
from cueglass.llm.store import written
from cueglass.llm.words import byte_class, find_words, lowered

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
WORDS, SEED, RADIUS = 3, 42, 2
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one side of a tile, about.
TILE = 2048
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 14
_SOLID = byte_class(b" \t\n\x0b\x0c\r")


def _fingerprint(hashes: np.ndarray, ones: np.ndarray) -> int:
    return int(np.packbits(2 * ones > hashes).view(">u8")[0])


def _text_fingerprint(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> int:
    """From words that stand in ``joined`` with one space between them."""
    if not len(starts):
        return 0
    size = min(WORDS, len(starts))
    firsts, lasts = starts[: len(starts) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(firsts), _AT_ONCE):
        spans = zip(firsts[i : i + _AT_ONCE].tolist(), lasts[i : i + _AT_ONCE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return _fingerprint(len(firsts), ones)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each whole text: a bit is 1 if it is in over half of the shingle hashes."""
    data, offsets = buffers(texts)
    out = np.zeros(len(texts), np.uint64)
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1] - offsets[first]
        part = lowered(data[offsets[first] : offsets[last]])
        starts, ends, bounds = find_words(part, own, _SOLID)
        # Words move together until one byte, turned into a space, is between them;
        # where two texts touch there is none, and no shingle goes over that place.
        keep = np.append(_SOLID[part], False)
        after = ends[~keep[ends]]
        keep[after] = True
        place = np.cumsum(keep) - keep
        joined = np.append(part, np.uint8(32))
        joined[after] = 32
        joined = joined[keep].tobytes()
        starts, ends = place[starts], place[ends - 1] + 1
        for i in range(last - first):
            mine = slice(bounds[i], bounds[i + 1])
            out[first + i] = _text_fingerprint(joined, starts[mine], ends[mine])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = pa.array(fingerprints(batch.column("text")).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bits], names=["doc_id", "bits"])


# --- keys -----------------------------------------------------------------------------

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code of 23 bits.
GENERATOR = 0b101011100011


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator: 0 for the codewords."""
    rest = np.array(words, np.int64)
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


@cache
def error_patterns() -> np.ndarray:
    """For every syndrome the errors of at most four bits that have it, zero-padded: the
    first by weight comes first, and a second one equal to it means that there is none."""
    of: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        errors = [sum(1 << i for i in places) for places in combinations(range(23), weight)]
        for error, rest in zip(errors, syndromes(np.array(errors)).tolist(), strict=True):
            of[rest].append(error)
    return np.array([(x + x[:1] * 6)[:6] for x in of])


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Six columns of 12-bit codeword indices; those that repeat the first one are none."""
    return (np.asarray(words, np.int64)[:, None] ^ error_patterns()[syndromes(words)]) >> 11


def keys_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of the fingerprints."""
    bits = bits.view(np.uint64)
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        index = golay_indices(parts[(i + 1) % 3])
        real = np.ones(index.shape, bool)
        real[:, 1:] = index[:, 1:] != index[:, :1]
        row, column = np.nonzero(real)
        keys.append((np.int64(i) << 40) | (parts[i][row] << 12) | index[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column("bits").to_numpy()
        keys, rows = keys_of(bits)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bits[rows])], names=["key", "bits"])


def spanning_links(bits: np.ndarray) -> list[tuple[int, int]]:
    """At most one link fewer than fingerprints, which join all that links join."""
    left, links = bits, []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            found = left[near].tolist()
            left = left[~near]
            links += [(int(at), x) for x in found]
            reached += found
    return links


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by tile; a tile that batches cut is put together."""
    held, tile = [], None

    def emit() -> pa.RecordBatch:
        links = np.array(spanning_links(np.unique(np.concatenate(held))), np.uint64).reshape(-1, 2)
        both = [pa.array(links[:, i].view(np.int64)) for i in range(2)]
        return pa.RecordBatch.from_arrays(both, names=["a", "b"])

    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
        bits = batch.column("bits").to_numpy().view(np.uint64)
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(bits)], strict=True):
            if first == last:
                continue
            name = tuple(names[:, first].tolist())
            if held and name != tile:
                yield emit()
                held.clear()
            tile = name
            held.append(bits[first:last].copy())
    if held:
        yield emit()


def _links(classes: DataFrame) -> DataFrame:
    """(a, b): enough links between fingerprints to join all that are connected."""
    keyed = written(classes.select("bits").mapInArrow(_keyed, "key long, bits long"))
    buckets = (
        keyed.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor("bits").alias("mixed"),
            F.bit_xor(F.xxhash64("bits")).alias("remixed"),
        )
        .where("size > 1")
        .groupBy("size", "mixed", "remixed")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    )
    side = F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int")
    placed = (
        keyed.join(buckets, "key")
        .withColumn("side", side)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "bits")
    )
    tile = ["key", "low", "high"]
    return placed.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tile_links, "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints form a class; classes that share a key form a bucket. A bucket is
    compared in tiles of a bounded size, each of which gives a spanning forest of its
    links, so a group of copies is never turned into all its pairs and no link is lost.
    Buckets with the same members are compared once.

    A null or blank text has fingerprint zero and is linked like any other. Rows with a
    null doc_id take part; a component of such rows alone has a null component_id. Rows
    that repeat a doc_id are rows of their own. Other columns are ignored; an empty
    table gives an empty table.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = written(named.mapInArrow(_sign, f"doc_id {kind}, bits long"))
    classes = written(signed.groupBy("bits").agg(F.min("doc_id").alias("first")))
    found = connected(_links(classes)).withColumnRenamed("node", "bits")
    labelled = classes.join(found, "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    component = labelled.join(least, "label").select("bits", "component_id")
    return signed.join(component, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )
