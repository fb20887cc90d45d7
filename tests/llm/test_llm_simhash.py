"""Golay-code hashing against all pairs of fingerprints."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cueglass.llm import simhash
from cueglass.llm.simhash import error_patterns, fingerprints, golay_indices, keys_of, simhash_components, spanning_links

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    spans = [words[i : i + 3] for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    bits = [brute_bits(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (bits[i] ^ bits[j]).bit_count() <= 2:
            a, b = root(i), root(j)
            group[max(a, b)] = min(a, b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if root(j) == root(i) and r[0] is not None]
        out.append((doc, f"{bits[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_words_two_bits_apart_share_an_index():
    leaders = error_patterns()[:, 0]
    assert sorted(int(x).bit_count() for x in leaders) == sorted([0] + [1] * 23 + [2] * 253 + [3] * 1771)
    one = golay_indices(leaders)
    for places in [(), *combinations(range(23), 1), *combinations(range(23), 2)]:
        other = golay_indices(leaders ^ sum(1 << p for p in places))
        assert (one[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(2))
        b = a
        for p in rng.choice(64, 2, replace=False):
            b ^= 1 << int(p)
        keys = [set(keys_of(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1] and max(map(len, keys)) <= 18


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé \t\n\x0b\xa0.", max_size=40)), max_size=12))
def test_fingerprints_are_those_of_the_rule(texts):
    got = fingerprints(pa.array(texts, pa.string()))
    assert got.tolist() == [brute_bits(t) for t in texts]


def test_long_text_and_blocks(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 2, 5, 40_000]))) for _ in range(12)]
    want = [brute_bits(t) for t in texts]
    assert fingerprints(pa.array(texts)).tolist() == want
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 64)
    assert fingerprints(pa.array(texts)).tolist() == want


def test_spanning_links_join_what_links_join():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    bits = np.unique([b ^ sum(np.uint64(1) << np.uint64(p) for p in rng.choice(64, 3)) for b in base for _ in range(60)])
    links = spanning_links(bits)
    assert len(links) < len(bits) and all((a ^ b).bit_count() <= 2 for a, b in links)
    group = {int(b): int(b) for b in bits}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        group[root(a)] = root(b)
    for a, b in combinations(map(int, bits), 2):
        if (a ^ b).bit_count() <= 2:
            assert root(a) == root(b)


def corpus(rng):
    rows = []
    for i in range(40):
        words = [f"{rng.choice('abcdefg')}{rng.randrange(300)}" for _ in range(rng.choice([1, 4, 30, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "x"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (None, "only here"), (3, "again 3"), (3, "again 3")]


@pytest.mark.parametrize("tile", [2048, 3])
def test_components_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = corpus(random.Random(tile))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bits", "'x' as fingerprint", "2 as key")
    got = simhash_components(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id string, text string")).collect() == []
