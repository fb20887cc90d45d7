"""Sketches, merging, and the edited texts of neighbours."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from cueglass.llm import fingerprint as fp
from cueglass.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string"


def hashes(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


def test_sketches_merge():
    rng = np.random.default_rng(1)
    for n in (0, 3, 100, 127, 128, 129, 5000):
        one, other = hashes(rng, n), hashes(rng, 700)
        assert (fp.merge(fp.sketch(one), fp.sketch(other)) == fp.sketch(np.union1d(one, other))).all()
        assert (fp.from_text(fp.to_text(fp.sketch(one))) == fp.sketch(one)).all()


def test_estimates():
    rng = np.random.default_rng(2)
    common, left, right = (hashes(rng, n) for n in (6000, 2000, 4000))
    one, other = (fp.sketch(np.union1d(common, x), 1024) for x in (left, right))
    assert abs(fp.resemblance(one, other, 1024) - 0.5) < 0.05
    assert abs(fp.containment(one, other, 1024) - 0.75) < 0.08
    assert abs(fp.distinct(one, 1024) / 8000 - 1) < 0.1
    empty = np.empty(0, np.uint64)
    assert fp.resemblance(empty, empty) == 1.0
    assert fp.resemblance(empty, one) == 0.0
    assert fp.containment(empty, one) == 1.0
    small, more = hashes(rng, 20), hashes(rng, 20)
    assert fp.resemblance(small, np.union1d(small, more)) == 0.5
    assert fp.distinct(small) == 20


def brute(rows):
    """Expected (doc_id, n_chars, edited_sha256, fingerprint, edited fingerprint)."""
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        new = text[: len(text) - cut] + following[:cut]
        prints = [fp.to_text(fp.sketch(s)) for s in shingle_sets(pa.array([text, new]))]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), *prints))
    return out


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["é", "b", "日本", "dd"]) for _ in range(rng.randrange(0, 400)))) for i in range(3, 150)]
    rows += [(1000, "x y " * 50_000), (1001, ""), (2, "a b c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", to int").repartition(5)
    got = fp.fingerprint_documents(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute(sorted(rows, reverse=True)))
    for r in got:
        one, other = fp.from_text(r.fingerprint), fp.from_text(r.edited_fingerprint)
        assert r.near_edited == fp.resemblance(one, other)
    by_id = sorted(got, key=lambda r: -r.doc_id)
    for r, following in zip(by_id, by_id[1:] + by_id[:1], strict=True):
        assert r.near_next == fp.resemblance(fp.from_text(r.fingerprint), fp.from_text(following.fingerprint))


def test_odd_rows(spark):
    rows = [(1, "same text here"), (1, "same text here"), (2, None), (None, "n"), (None, None)]
    got = fp.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 14), ("1", 14), ("2", 0), ("None", 0), ("None", 1)]
    assert fp.fingerprint_documents(spark.createDataFrame([(4, "abcdef")], SCHEMA)).collect()[0].edited_sha256 == (
        hashlib.sha256(b"abcdab").hexdigest()
    )
    assert fp.fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_id_and_null_ids_are_dealt_out_and_ids_may_be_strings(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(12)) for _ in range(300)]
    ids = [None] * 100 + ["hot"] * 100 + [f"d{i}" for i in range(98)] + ["", "日本"]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string").repartition(4)
    tied = docs.select("doc_id", fp.F.xxhash64("text").alias("tie"), "text").collect()
    ordered = sorted(tied, key=lambda r: (r.doc_id is not None, r.doc_id or "", r.tie, r.text), reverse=True)
    want = sorted(brute([(r.doc_id, r.text) for r in ordered]), key=repr)
    assert sorted((tuple(r)[:5] for r in fp.fingerprint_documents(docs).collect()), key=repr) == want
    slim = docs.withColumn("tie", fp.F.xxhash64("text"))
    ranges = fp._neighbours(slim, 16).where("NOT guest").groupBy("to").count().collect()
    assert len(ranges) >= 12 and max(r["count"] for r in ranges) < 60
