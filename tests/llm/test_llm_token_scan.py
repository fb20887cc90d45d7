"""Separator scan against a plain split of the token stream."""

import random

import numpy as np

from cueglass.llm import token_scan
from cueglass.llm.token_scan import count_tokens, document_tokens, read_tokens, write_tokens

SEP = 9


def brute(ids):
    """(document, n_tokens, complete) of one stream."""
    out, size = [], 0
    for token in ids:
        if token == SEP:
            out.append((len(out), size, True))
            size = 0
        else:
            size += 1
    return out + [(len(out), size, False)] * bool(size)


def blocks_of(file, ids, block):
    data = np.array(ids, "<u2").tobytes()
    return [(file, i // (2 * block), data[i : i + 2 * block]) for i in range(0, len(data), 2 * block)]


def test_random_streams(spark, monkeypatch):
    monkeypatch.setattr(token_scan, "CHUNK", 3)
    rng = random.Random(6)
    streams = [[rng.choice([1, 2, SEP] if rng.random() < p else [1, 2]) for _ in range(n)] for p, n in
               [(0.1, 500), (0.9, 200), (0.01, 700), (1, 1), (0, 40), (0, 4)]]
    streams += [[SEP], [1], [SEP] * 40, [1] * 39 + [SEP], []]
    rows = [b for i, s in enumerate(streams) for b in blocks_of(i, s, 4)]
    rng.shuffle(rows)
    got = count_tokens(spark.createDataFrame(rows, "file long, block long, tokens binary"), SEP).collect()
    expected = [(i, *r) for i, s in enumerate(streams) for r in brute(s)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_documents(spark):
    texts = [None, "", "a", "Hello, world! été 日本", "x " * 30_000] + [f"number {i}" for i in range(300)]
    rows = [(i if i != 5 else None, t, 1) for i, t in enumerate(texts)] + [(7, "number 2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(3)
    encode = token_scan._encoding(open(token_scan.VOCABULARY, "rb").read()).encode_ordinary
    got = document_tokens(docs, block=64).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(doc_id={i}, n_tokens={len(encode(t or ''))})" for i, t, _ in rows
    )
    assert document_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_flat_files(spark, tmp_path):
    streams = {"a.bin": [1, 2, SEP, 3, SEP], "b.bin": [SEP, 5, 5, 5], "empty.bin": []}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = count_tokens(read_tokens(spark, str(tmp_path), block=2), SEP).collect()
    expected = [(name, *r) for name, ids in streams.items() for r in brute(ids)]
    assert sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in got) == sorted(expected)


def test_texts_come_back_from_the_files(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "drei é")], "doc_id long, text string").coalesce(1)
    blocks, order = write_tokens(docs, block=2)
    data = b"".join(r.tokens for r in sorted(blocks.collect(), key=lambda r: r.block))
    import_ids = np.frombuffer(data, "<u2").tolist()
    encoding = token_scan._encoding(open(token_scan.VOCABULARY, "rb").read())
    texts = [encoding.decode(x) for x in _split(import_ids)]
    assert texts == ["one two", "drei é"]
    assert sorted((r.document, r.doc_id) for r in order.collect()) == [(0, 1), (1, 2)]


def _split(ids):
    out = [[]]
    for token in ids:
        if token == token_scan.SEPARATOR:
            out.append([])
        else:
            out[-1].append(token)
    return out[:-1]
