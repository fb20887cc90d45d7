"""Passage search against a full alignment of every window with every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cueglass.llm import decontaminate
from cueglass.llm.decontaminate import build_index, drop_contaminated, find_passages
from cueglass.llm.shingles import buffers

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
SYLLABLES = ["tion", "er", "the", "an", "re", "on", "st", "ing", "ble", "ha", "é"]


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def edit(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def least_edits(pattern, text):
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for letter in pattern:
        new = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + (text != letter)]))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def folded(text):
    data, offsets = buffers(pa.array([text], pa.string()))
    return decontaminate.fold(data, offsets)[0][:-1]


def brute(docs, items):
    index = build_index([i for i, _ in items], [t for _, t in items])
    found = set()
    for doc, text in docs:
        own = folded(text or "")
        for w, item in enumerate(index.items):
            window = index.texts[index.starts[w] : index.starts[w] + index.lengths[w]]
            if least_edits(window, own) <= index.edits[w]:
                found.add((doc, item))
    return found


def found(spark, docs, items):
    rows = find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return {(r.doc_id, r.item_id) for r in rows}


def test_equals_full_alignment(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([5, 12, 40]))) for i in range(8)]
    docs = []
    for i in range(120):
        own = edit(rng, rng.choice(items)[1], rng.randrange(0, 30))
        docs.append((i, f"{prose(rng, rng.randrange(0, 60))} {own.upper() if i % 5 == 0 else own}. {prose(rng, rng.randrange(0, 60))}"))
    docs += [(i, prose(rng, 200)) for i in range(120, 150)]
    expected = brute(docs, items)
    assert 40 < len(expected) < 140
    assert found(spark, docs, items) == expected


def test_spans_and_columns(spark):
    rng = random.Random(3)
    item = prose(rng, 40)
    text = f"É {prose(rng, 30)}\n{item}. Then {prose(rng, 30)} {item}"
    docs = spark.createDataFrame([(1, text, 9), (2, prose(rng, 90), 9)], DOCS + ", item_id int")
    rows = find_passages(docs, spark.createDataFrame([(5, item)], ITEMS)).orderBy("start").collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in rows] == [(1, 5, 0)] * 2
    assert [text[r.start : r.end] for r in rows] == [item] * 2
    kept = drop_contaminated(docs, spark.createDataFrame([(5, item)], ITEMS))
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [2]


def test_odd_rows(spark):
    rng = random.Random(4)
    item = prose(rng, 25)
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "x" * 2_000_000 + " " + item), (5, item[:30])]
    items = [(1, item), (1, item), (None, prose(rng, 20)), (2, None), (3, ""), (4, "short"), (5, "!!! ???")]
    rows = find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "4", "None"]
    assert {r.item_id for r in rows} == {1}
    assert found(spark, docs, []) == set()
    assert found(spark, [], items) == set()


@pytest.mark.parametrize("size", [1, 200])
def test_passes(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
    rng = random.Random(5)
    items = [(i, prose(rng, 20)) for i in range(4)]
    docs = [(i, f"{prose(rng, 9)} {t}") for i, t in items]
    assert found(spark, docs, items) == {(i, i) for i in range(4)}
    kept = drop_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[1:], ITEMS))
    assert [r.doc_id for r in kept.collect()] == [0]


def windows_at_every_offset(text):
    own = folded(text)
    size = min(len(own), 96)
    edits = max(0, min(size // 10, size // 8 - 2))
    return [(own[i : i + size], edits) for i in range(len(own) - size + 1)]


def test_quotes_at_every_offset(spark):
    """A verbatim quote of 87 bytes holds a window, wherever in the item it begins."""
    rng = random.Random(12)
    item = prose(rng, 70).replace("é", "e")[:394].strip()
    docs = []
    for size in (87, 100, 120):
        for begin in range(0, len(item) - size + 1, 1 if size == 87 else 7):
            docs.append((len(docs), f"zqx zqx {item[begin : begin + size]} zqx zqx"))
    assert len(item) > 380
    assert found(spark, docs, [(1, item)]) == {(i, 1) for i in range(len(docs))}
    kept = drop_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS))
    assert kept.count() == 0


def test_equals_alignment_of_every_offset(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 34, 12))]
    docs = []
    for i in range(30):
        text = rng.choice(items)[1]
        begin, size = rng.randrange(len(text) // 2), rng.randrange(70, 130)
        own = edit(rng, text[begin : begin + size], rng.randrange(0, 8))
        docs.append((i, f"{prose(rng, rng.randrange(0, 12))} {own} {prose(rng, rng.randrange(0, 12))}"))
    expected = {
        (doc, item)
        for doc, own in docs
        for item, text in items
        if any(least_edits(w, folded(own)) <= e for w, e in windows_at_every_offset(text))
    }
    assert 7 < len(expected) < 30
    assert found(spark, docs, items) == expected
