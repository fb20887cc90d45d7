"""Severity of toxic language by cumulative-link ordinal regression.

The model gives P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all
thresholds t_0 < t_1 < ...; x marks which words a text has, and which word beginnings
it has once, twice or three times. The expected severity is the sum of these
probabilities over j, and a text is toxic if P(grade > 0) is at least one half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueglass.llm.store import written

#: Labelled rows that the model is fitted on, at most; taken by a hash of doc_id.
SAMPLE = 8000
#: Features of the model, at most, and the least association with toxic texts (G
#: squared) that one must show in the sample.
FEATURES, LEAST_G = 4096, 15.0
#: Features of the toxic sample that are weighed at all: the most frequent ones.
WEIGHED = 50_000
#: Grades: 0 is clean, the others are equal parts of the toxic sample.
GRADES = 4
#: Lengths of word beginnings, and how often one may have to occur.
STEMS, TIMES = (4, 5, 6, 7, 8), 3
RIDGE, ROUNDS, RATE = 0.03, 800, 0.1

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    places: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def features(text: str | None, known: dict[str, int] | None = None, heads: set[str] | None = None) -> set[str]:
    """Words of a text in lower case, and beginnings of longer words with their number.

    ``réeu*2`` says that words that begin with ``réeu`` occur twice or more. With
    ``known`` only those features are made; ``heads`` are their first letters.
    """
    found: set[str] = set()
    begun: Counter[str] = Counter()
    for word, times in Counter(_WORD.findall((text or "").lower())).items():
        if heads is not None and word[: STEMS[0]] not in heads:
            continue
        found.add(word)
        for n in STEMS:
            if len(word) > n:
                begun[word[:n]] += times
    for stem, times in begun.items():
        found.update(f"{stem}*{n}" for n in range(1, min(times, TIMES) + 1))
    return found if known is None else found & known.keys()


def _heads(known: dict[str, int]) -> set[str]:
    return {feature.partition("*")[0][: STEMS[0]] for feature in known}


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows one after another, and the row of each."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return flat, np.repeat(np.arange(len(rows)), [len(own) for own in rows])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by gradient ascent (Adam).

    Thresholds are kept in order by fitting the first and the logarithms of the gaps.
    """
    flat, owner = _flat(rows)
    own = np.zeros(n_features + n_grades - 1)
    own[n_features] = 1.0
    first, second = np.zeros_like(own), np.zeros_like(own)
    for step in range(1, ROUNDS + 1):
        weights, gaps = own[:n_features], np.exp(own[n_features + 1 :])
        limits = np.concatenate([[-np.inf], own[n_features] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(owner, weights[flat], len(rows))
        upper, lower = _sigmoid(limits[grades + 1] - score), _sigmoid(limits[grades] - score)
        likely = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        slope = np.empty_like(own)
        slope[:n_features] = np.bincount(flat, (down - up)[owner], n_features) - RIDGE * weights
        by_limit = np.bincount(grades, up, n_grades)[:-1] - np.bincount(grades, down, n_grades)[1:]
        tails = by_limit[::-1].cumsum()[::-1]
        slope[n_features] = tails[0]
        slope[n_features + 1 :] = tails[1:] * gaps
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        own += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    limits = own[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(own[n_features + 1 :]))])
    return own[:n_features], limits


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on a sample of the labelled documents (at most ``SAMPLE`` rows of ``labels``).

    Labels say toxic or not. Toxic texts are graded 1, 2, ... in equal parts by how many
    of the features that mark toxic texts they have. Labels that are null or have a null
    doc_id are not used. Without toxic or without clean labels nothing is toxic. Exact
    copies of a text count once.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic"))
        .where("id is not null and toxic is not null")
        .orderBy(F.xxhash64("id"), "id", "toxic")
        .limit(SAMPLE)
    )

    sample = written(
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most SAMPLE rows
        .groupBy("text")
        .agg(F.max(F.col("toxic") > 0).alias("toxic"))
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(features(own.as_py())), pa.string())], names=["feature"])

    frequent = (
        sample.where("toxic").select("text").mapInArrow(spread, "feature string")
        .groupBy("feature").count().where("count >= 3")
        .orderBy(F.desc("count"), "feature").limit(WEIGHED).collect()
    )
    weighed = {r["feature"]: i for i, r in enumerate(frequent)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _heads(weighed)
        for batch in batches:
            own = [sorted(weighed[f] for f in features(x.as_py(), weighed, heads)) for x in batch.column("text")]
            packed = [np.array(x, np.int32).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary())], names=["toxic", "own"])

    # SAMPLE rows at most, a few kilobytes each.
    pairs = sorted((r["toxic"], bytes(r["own"])) for r in sample.mapInArrow(known, "toxic boolean, own binary").collect())
    marked = np.array([toxic for toxic, _ in pairs], bool)
    rows = [np.frombuffer(own, np.int32) for _, own in pairs]
    kept = _associated(rows, marked, len(weighed))
    if not len(kept):
        return Model({}, np.empty(0), np.full(GRADES - 1, 30.0))
    place = np.full(len(weighed), -1, np.int64)
    place[kept] = np.arange(len(kept))
    rows = [own[own >= 0] for own in (place[x] for x in rows)]
    counts = np.array([len(own) for own in rows])
    cuts = np.quantile(counts[marked], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(marked, 1 + np.searchsorted(cuts, counts, "left"), 0)
    weights, thresholds = fit_ordinal(rows, grades, len(kept), GRADES)
    names = list(weighed)
    return Model({names[old]: i for i, old in enumerate(kept)}, weights, thresholds)


def _associated(rows: list[np.ndarray], marked: np.ndarray, n_features: int) -> np.ndarray:
    """The features that go most with marked rows, by G squared; at most ``FEATURES``."""
    if not marked.any() or marked.all():
        return np.empty(0, int)
    flat, owner = _flat(rows)
    both = np.bincount(flat, minlength=n_features)
    bad = np.bincount(flat[marked[owner]], minlength=n_features)
    share = marked.mean()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)

    g = 2 * (part(bad, both * share) + part(both - bad, both * (1 - share)))
    g[bad <= both * share] = 0.0
    best = np.argsort(-g, kind="stable")[:FEATURES]
    return best[g[best] >= LEAST_G]


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    """P(grade > j) of each text, a column for each j."""
    heads = _heads(model.places)
    sums = []
    for own in texts:
        found = sorted(model.places[f] for f in features(own.as_py(), model.places, heads))
        sums.append(float(model.weights[found].sum()) if found else 0.0)
    return _sigmoid(np.array(sums)[:, None] - model.thresholds[None, :])


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) for every row.

    ``severity`` is the expected grade, ``grade`` the number of thresholds that are
    passed with a probability of one half or more. Null and empty texts have no
    features and count as clean. Whole texts are read; no rows are moved. Null and
    repeated doc_ids stay as they are; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = _scores(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(above.sum(axis=1).round(6), pa.float64()),
                    pa.array((above >= 0.5).sum(axis=1), pa.int32()),
                    pa.array(above[:, 0] >= 0.5, pa.bool_()),
                ],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(text), model)[:, 0] < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
