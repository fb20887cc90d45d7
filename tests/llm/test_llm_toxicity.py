"""The ordinal model: held-out accuracy, order of grades, odd rows."""

import random

import numpy as np

from cueglass.llm import toxicity
from cueglass.llm.toxicity import drop_toxic, fit, fit_ordinal, score_documents

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
BAD = ["vermin", "filth", "zogu"]


def corpus(rng, n):
    """Texts of invented words; a toxic one has bad words or words that begin so."""
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "ko", "ri", "ten", "lu"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(60)] = rng.choice(BAD) + rng.choice(["", "ba", "ten"])
        rows.append((i, " ".join(words), int(any(w.startswith(tuple(BAD)) for w in words))))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(7), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 2], LABELS)
    model = fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    held = [(t, got[i]) for i, _, t in rows if not i % 2]
    assert sum(r.toxic == bool(t) for t, r in held) / len(held) > 0.98
    assert not any(r.toxic for t, r in held if not t)
    assert all(0 <= r.severity <= 3 and (r.grade >= 1) == r.toxic for r in got.values())
    counts = np.array([sum(w.startswith(tuple(BAD)) for w in t.split()) for _, t, _ in rows])
    severity = np.array([got[i].severity for i, _, _ in rows])
    assert np.corrcoef(counts, severity)[0, 1] > 0.8
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}


def test_features():
    assert toxicity.features("Réeuxon réeuxai, LE le le") == {
        "réeuxon", "réeuxai", "le", "réeu*1", "réeu*2", "réeux*1", "réeux*2", "réeuxo*1", "réeuxa*1",
    }
    assert toxicity.features(None) == set() == toxicity.features("12 34 __")


def test_ordinal_weights_are_shared():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3)) < 0.5
    score = x @ np.array([3.0, 2.0, 0.0]) + rng.logistic(size=3000)
    grades = np.searchsorted([1.5, 4.0], score)
    weights, limits = fit_ordinal([np.flatnonzero(r) for r in x], grades, 3, 3)
    assert np.allclose(weights, [3, 2, 0], atol=0.3)
    assert np.allclose(limits, [1.5, 4.0], atol=0.3)


def test_odd_rows(spark):
    rows = corpus(random.Random(1), 200)
    docs = spark.createDataFrame(
        [(i, t, 1) for i, t, _ in rows] + [(None, None, 1), (900, "", 1), (901, "x" * 1_000_000, 1), (902, "vermin " * 100_000, 1)] * 2,
        DOCS + ", toxic int",
    )
    labels = spark.createDataFrame(
        [(i, None, t) for i, _, t in rows] + [(1, 0, None), (None, 1, 1), (12345, 1, 1), (2, 1, rows[2][2])], LABELS
    )
    got = score_documents(docs, fit(docs, labels)).collect()
    assert len(got) == 208
    assert [r.toxic for r in got if r.doc_id in (900, 901) or r.doc_id is None] == [False] * 6
    assert [r.toxic for r in got if r.doc_id == 902] == [True] * 2


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "vermin")], DOCS)
    for labels in ([], [(1, 1, 1)], [(1, 1, 0)]):
        model = fit(docs, spark.createDataFrame(labels, LABELS))
        assert [(r.grade, r.toxic) for r in score_documents(docs, model).collect()] == [(0, False)]
    empty = spark.createDataFrame([], DOCS)
    assert score_documents(empty, fit(empty, spark.createDataFrame([], LABELS))).collect() == []
