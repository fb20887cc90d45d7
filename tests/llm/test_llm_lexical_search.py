"""Bounded search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from cueglass.llm import lexical_search as search
from cueglass.llm.lexical_search import search_documents

UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    bags = [(doc, bag) for doc, bag in bags if bag]
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in wanted if df[t]}
        scored = []
        for doc, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n // total
            score = sum(w * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m)) for t, w in weights.items() if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[: search.LISTED], 1):
            out.append((item, rank, None if null else doc, -score))
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "ÀB"]

    def text(size):
        return "".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))])[0] + rng.choice([" ", "-", "\n"]) for _ in range(size))

    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(90)]
    docs += [(None, text(20)), (None, None), (5000, None), (5001, " .-"), (3, text(10)), (3, "w1"), (6000, text(20_000))]
    items = [(i, text(rng.choice([1, 3, 10, 40]))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "unseen term"), (None, "w1"), (4, text(5)), (53, docs[7][1])]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("block", "short", "per_pass"), [(4096, 32, 1 << 18), (16, 4, 40), (64, 1, 1 << 18), (64, 10**9, 200)])
def test_equals_scoring_everything(spark, monkeypatch, block, short, per_pass):
    for name, value in (("BLOCK_DOCS", block), ("SHORT", short), ("PASS_TERMS", per_pass), ("BLOCK_BYTES", 4000)):
        monkeypatch.setattr(search, name, value)
    docs, items = corpus(random.Random(block), 250)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as score", "'z' as term")
    got = search_documents(table, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as place"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_lists_are_skipped():
    """Where the bar is high, frequent words alone make no document a candidate."""
    import numpy as np
    import pyarrow as pa

    n = 1000
    at = np.concatenate([np.arange(5), np.arange(n)]).astype(np.int32)
    row = {
        "ids": pa.array(range(n)),
        "terms": pa.array(["rare", "often"]),
        "ends": pa.array([5, 5 + n], pa.int32()),
        "at": pa.array(at),
        "tf": pa.array(np.ones(len(at), np.int64)),
        "lengths": pa.array(np.full(n, 10)),
    }
    lists = search._Lists(row, n, 10 * n)
    merged = []
    real = search._sums
    search._sums = lambda at, parts: merged.append(len(at)) or real(at, parts)
    try:
        most = int(lists.most[0])
        places, scores = lists.best([("rare", 5000), ("often", 1)], 4000 * most)
    finally:
        search._sums = real
    assert places.tolist() == [0, 1, 2, 3, 4] and set(scores.tolist()) == {5001 * most}
    assert max(merged) <= 5


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "cat dog"), ("a", "cat dog"), (None, "cat"), ("c", "bird")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "Cat!")], "item_id string, text string")
    got = [tuple(r)[:3] for r in search_documents(docs, items).orderBy("rank").collect()]
    assert got == [("q", 1, None), ("q", 2, "a"), ("q", 3, "b")]
    assert search_documents(docs.limit(0), items).collect() == []
    assert search_documents(docs, items.limit(0)).collect() == []
