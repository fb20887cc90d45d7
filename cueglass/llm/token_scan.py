"""Token counts of documents by scanning flat token files for separators.

A token file holds nothing but token ids of fixed width, documents one after another,
each ended by a separator id. It is handled in blocks. Each block is searched for
separators at once; what reaches over a block's edges is put together by a prefix scan
over block summaries, so blocks of one file are counted on many machines.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueglass.llm.store import written

#: Tokens of one block; a token is an unsigned little-endian 16-bit number.
BLOCK = 1 << 16
WIDTH = 2
#: Blocks whose summaries are scanned in one task.
CHUNK = 4096
#: The vocabulary file and the id that it leaves free for the separator.
VOCABULARY, SEPARATOR = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: Fixed value: how the published byte-level vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[bytes, object] = {}


def _encoding(ranks: bytes):
    """One encoder for each Python worker."""
    if ranks not in _encodings:
        import tiktoken

        pairs = map(bytes.split, ranks.splitlines())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encodings[ranks] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[ranks]


def write_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    separator: int = SEPARATOR,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Tokenize ``docs`` into one token file for each input partition.

    Returns the blocks (file, block, tokens) and the order of documents in the files
    (file, document, doc_id). Both are written to the shared folder in one pass; a task
    that is run again writes the same file. Null texts are written as empty ones, a
    separator alone.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # under 1 MB
    names = ["file", "block", "tokens", "document", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value).encode_ordinary
        file, number, document, rest = TaskContext.get().partitionId(), 0, 0, b""

        def rows(id_type: pa.DataType, blocks: list, documents: list, ids: pa.Array) -> pa.RecordBatch:
            n, m = len(blocks), len(documents)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (n + m), pa.int64()),
                    pa.array([*range(number - n, number), *[None] * m], pa.int64()),
                    pa.array([*blocks, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *documents], pa.int64()),
                    pa.concat_arrays([pa.nulls(n, id_type), ids]),
                ],
                names=names,
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                pieces = [rest]
                for own in part.column("text"):
                    ids = encode(own.as_py() or "")
                    ids.append(separator)
                    pieces.append(np.array(ids, "<u2").tobytes())
                data = b"".join(pieces)
                size = block * WIDTH
                cut = len(data) - len(data) % size
                blocks = [data[at : at + size] for at in range(0, cut, size)]
                rest, number = data[cut:], number + len(blocks)
                documents = list(range(document, document + len(part)))
                document += len(part)
                yield rows(id_type, blocks, documents, part.column("doc_id"))
        if rest:
            number += 1
            yield rows(id_type, [rest], [], pa.array([], id_type))

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    both = written(
        slim.mapInArrow(run, f"file long, block long, tokens binary, document long, doc_id {kind}")
    )
    return (
        both.where("tokens is not null").select("file", "block", "tokens"),
        both.where("document is not null").select("file", "document", "doc_id"),
    )


def read_tokens(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, tokens) of flat files; a file is read whole, so it must be below 2 GB."""
    size = block * WIDTH
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    last = F.ceil(F.col("length") / size) - 1
    return (
        files.where("length > 0")
        .select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        .select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("tokens"))
    )


def _scan(separator: int):
    """Summary of each block and the lengths of the documents that lie inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = pa.int64()
        for batch in batches:
            sizes, found, heads, tails, inner = [], [], [], [], []
            for tokens in batch.column("tokens"):
                ids = np.frombuffer(tokens.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == separator)
                sizes.append(len(ids))
                found.append(len(ends))
                heads.append(int(ends[0]) if len(ends) else len(ids))
                tails.append(len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids))
                inner.append((np.diff(ends) - 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"), batch.column("block"), pa.array(sizes, long), pa.array(found, long),
                    pa.array(heads, long), pa.array(tails, long), pa.array(inner, pa.list_(long)),
                ],
                names=["file", "block", "size", "found", "head", "tail", "inner"],
            )

    return run


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, document, n_tokens, complete): tokens of each document of each file.

    Separators are not counted. Documents are numbered from 0 in each file; an empty
    document has no tokens. Tokens after a file's last separator are a document that is
    not complete. Blocks are numbered from 0 without gaps in each file; empty files and
    an empty table give no rows. Only block summaries are moved.

    The scan has two levels: inside chunks of blocks and over the chunks of a file.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    scanned = written(
        blocks.select("file", "block", "tokens")
        .mapInArrow(
            _scan(separator),
            f"file {kind}, block long, size long, found long, head long, tail long, inner array<long>",
        )
        .withColumn("chunk", F.floor(F.col("block") / CHUNK))
    )
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    slim = scanned.drop("inner").withColumn("at", F.coalesce(F.sum("size").over(inside), zero))
    # A place is counted in tokens from the chunk's start; open is where a document goes on.
    opened = F.when(F.col("found") > 0, F.col("at") + F.col("size") - F.col("tail"))
    slim = slim.withColumn("opened", opened)
    local = slim.select(
        "file", "chunk", "block", "at", "head", "found",
        F.coalesce(F.sum("found").over(inside), zero).alias("earlier"),
        F.max("opened").over(inside).alias("open"),
    )
    chunks = slim.groupBy("file", "chunk").agg(
        F.sum("size").alias("size"), F.sum("found").alias("found"), F.max("opened").alias("opened")
    )
    across = Window.partitionBy("file").orderBy("chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("size").over(before), zero))
    bases = chunks.select(
        "file", "chunk", "base",
        F.coalesce(F.sum("found").over(before), zero).alias("base_documents"),
        F.coalesce(F.max(F.col("base") + F.col("opened")).over(before), zero).alias("base_open"),
    )
    start = F.coalesce(F.col("base") + F.col("open"), F.col("base_open"))
    stitched = local.where("found > 0").join(bases, ["file", "chunk"]).select(
        "file", "block",
        (F.col("base_documents") + F.col("earlier")).alias("first"),
        (F.col("base") + F.col("at") - start + F.col("head")).alias("joined"),
    )
    lengths = F.posexplode(F.concat(F.array("joined"), "inner")).alias("i", "n_tokens")
    whole = (
        scanned.where("found > 0").select("file", "block", "inner")
        .join(stitched, ["file", "block"])
        .select("file", "first", lengths)
        .select("file", (F.col("first") + F.col("i")).alias("document"), "n_tokens", F.lit(True).alias("complete"))
    )
    ends = chunks.groupBy("file").agg(
        F.sum("found").alias("document"),
        (F.sum("size") - F.coalesce(F.max(F.col("base") + F.col("opened")), zero)).alias("n_tokens"),
    )
    return whole.union(ends.where("n_tokens > 0").withColumn("complete", F.lit(False)))


def document_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``, counted in its token files.

    A null text has no tokens. Null and repeated doc_ids are rows of their own.
    """
    blocks, order = write_tokens(docs, doc_id, text, **options)
    counted = count_tokens(blocks, options.get("separator", SEPARATOR))
    return order.join(counted, ["file", "document"]).select("doc_id", "n_tokens")
