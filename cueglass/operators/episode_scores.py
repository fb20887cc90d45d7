"""All pairs of a request and an episode in podcasts of few pairs, scored podcast by podcast.

Rows of both kinds are dealt out by podcast and sorted, and a fold over the Arrow batches
holds one podcast at a time. A podcast's words are looked up in a dictionary of its title
words, so words that are not related cost nothing; the rest is NumPy matrices of one
number per pair. Texts are moved as they were written and normalised behind the shuffle;
scores are those of ``functions.text``. The same fold scores texts that meet by a key.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cueglass.operators.episode_search import SCORE_UNIT

_BLANKS = " \t\n\x0b\f\r"
_BLANK = re.compile(f"[{_BLANKS}]+")
#: Word matches that are held before they are counted.
_MATCHES = 1 << 20

#: Scores (nan: not to be chosen) and places that break ties, both with a row for each request.
Scores = tuple[np.ndarray, np.ndarray]
#: Columns that scores need by name, as lists: of the requests, and of the episodes.
Scorer = Callable[[dict[str, list], dict[str, list]], Scores]
#: Takes pairs by scores, places and those columns: their rows, columns and ranks.
Pick = Callable[[np.ndarray, np.ndarray, dict[str, list], dict[str, list]], tuple[np.ndarray, ...]]
#: What a score needs of a row: a column of it, or what is made of its columns.
Key = str | Callable[[Callable[[str], Column]], Column]


class _Texts:
    """Finds the texts that hold another one, in one search over all of them."""

    def __init__(self, texts: list[str | None]):
        self.places = [i for i, t in enumerate(texts) if t is not None]
        known = [texts[i] for i in self.places]
        self.joined, self.starts, self.ends = "\0".join(known), [], []
        at = 0
        for text in known:
            self.starts.append(at)
            self.ends.append(at + len(text))
            at += len(text) + 1

    def holding(self, part: str) -> list[int]:
        found, at, last = [], 0, len(self.places) - 1
        while last >= 0 and (at := self.joined.find(part, at)) >= 0:
            k = bisect_right(self.starts, at) - 1
            if at + len(part) > self.ends[k]:  # beyond the end of a text
                at += 1
                continue
            found.append(self.places[k])
            if k == last:
                break
            at = self.starts[k + 1]
        return found


class _Words:
    """Texts by word, and by the relations of their words to asked ones of ``least``
    characters or more. A text is listed as often as it holds such a word."""

    def __init__(self, texts: list[list[str]], asked: set[str], least: int):
        self.holds, self.begun, self.known = defaultdict(list), defaultdict(list), {}
        for i, text in enumerate(texts):
            for word in text:
                self.holds[word].append(i)
        lengths = sorted({len(w) for w in asked if len(w) >= least})
        for word, places in self.holds.items():
            for n in lengths:
                if n >= len(word):
                    break
                if word[:n] in asked:
                    self.begun[word[:n]].extend(places)
        self.lengths = sorted({len(w) for w in self.holds if len(w) >= least})

    def related(self, word: str) -> list[int]:
        """Texts with a word, not the same, that begins this one or is begun by it."""
        found = list(self.begun.get(word, ()))
        for n in self.lengths:
            if n >= len(word):
                break
            if word[:n] in self.holds:
                found += self.holds[word[:n]]
        return found


class _Counts:
    """How often each pair of a request and a text was added."""

    def __init__(self, requests: int, texts: int):
        self.shape, self.open = (requests, texts), []
        self.total = np.zeros(requests * texts, dtype=np.int64)

    def add(self, request: int, texts: list[int]) -> None:
        if texts:
            base = request * self.shape[1]
            self.open += [base + i for i in texts]
            if len(self.open) > _MATCHES:
                self.result()

    def result(self) -> np.ndarray:
        if self.open:
            self.total += np.bincount(self.open, minlength=len(self.total))
            self.open = []
        return self.total.reshape(self.shape)


def _counted(requests: list[list[str]], texts: int, matches: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Both kinds of ``matches`` of a word, counted over the words of each request."""
    counts = _Counts(len(requests), texts), _Counts(len(requests), texts)
    known, size = {}, 0
    for i, words in enumerate(requests):
        for word in words:
            if word not in known:
                if size > _MATCHES:
                    known, size = {}, 0
                known[word] = matches(word)
                size += sum(map(len, known[word])) + 1
            for count, found in zip(counts, known[word], strict=True):
                count.add(i, found)
    return counts[0].result(), counts[1].result()


def _split(texts: list[str | None]) -> list[list[str]]:
    return [_BLANK.split(t) if t is not None else [] for t in texts]


#: Up to so many pairs are scored one by one, which then costs less than the dictionaries.
_SINGLY = 12


def _boosted(exact, part, n_search, longer) -> np.ndarray:
    """Scores of counted word matches, as :func:`norm_similarity` has them."""
    score = (exact + 0.6 * part) / np.maximum(longer, 1)
    some = part > 0
    boost = np.where(some & (exact > 0), 0.15, np.where(some & (0.6 * part >= 0.5 * n_search), 0.1, 0.0))
    return np.where(boost > 0, np.minimum(1.0, score + boost), score)


def _singly(a_words: list[list[str]], b_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    exact, part = np.zeros((2, len(a_words), len(b_words)), dtype=np.int64)
    for i, words in enumerate(a_words):
        for j, others in enumerate(b_words):
            for x in words:
                for y in others:
                    if x == y:
                        exact[i, j] += 1
                    elif len(x) >= 2 and len(y) >= 2 and (x.startswith(y) or y.startswith(x)):
                        part[i, j] += 1
    return exact, part


def word_scores(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """:func:`norm_similarity` of normalised texts but for texts that hold each other."""
    a_words, b_words = _split(a), _split(b)
    if len(a) * len(b) <= _SINGLY:
        exact, part = _singly(a_words, b_words)
    else:
        words = _Words(b_words, {w for words in a_words for w in words}, 2)
        exact, part = _counted(
            a_words, len(b), lambda w: (words.holds.get(w, []), words.related(w) if len(w) >= 2 else [])
        )
    n_search = np.array([len(w) for w in a_words])[:, None]
    longer = np.maximum(n_search, np.array([len(w) for w in b_words]))
    return _boosted(exact, part, n_search, longer)


def similarities(asked: dict[str, list], held: dict[str, list]) -> Scores:
    """:func:`norm_similarity` of each request's and episode's ``norm``; ties by ``ord``."""
    a, b = asked["norm"], held["norm"]
    score = word_scores(a, b)

    def inside(i: int, j: int) -> None:
        n, m = len(a[i]), len(b[j])
        score[i, j] = 1.0 if a[i] == b[j] else 0.8 + 0.2 * (min(n, m) / max(n, m))

    for side, others, by in ((a, b, inside), (b, a, lambda j, i: inside(i, j))):
        texts = _Texts(others)
        for k, text in enumerate(side):
            if text is not None:
                for other in texts.holding(text):
                    by(k, other)
    return score, np.broadcast_to(np.array(held["ord"]), score.shape)


def first_similar(above: float) -> Scorer:
    """0 for pairs more similar than ``above``; ties by ``ord``, those without one first.

    A ``norm`` without a letter or digit is like any other.
    """

    def scores(asked: dict[str, list], held: dict[str, list]) -> Scores:
        place = np.array([-(1 << 62) if n is None else n for n in held["ord"]])
        score, place = similarities(asked, held | {"ord": place})
        known, blank = ([np.array([test(t) for t in side["norm"]]) for side in (asked, held)]
                        for test in (lambda t: t is not None, lambda t: t is not None and not t.strip(_BLANKS)))
        like = (score > above) | blank[0][:, None] | blank[1]
        return np.where(like & known[0][:, None] & known[1], 0.0, np.nan), place

    return scores


def _keyword_shares(asked: dict[str, list], held: dict[str, list], least: float) -> np.ndarray:
    """:func:`shared_keywords` of each request's ``keys`` and title's ``low``, nan below ``least``."""
    lows, lists = held["low"], [keys or [] for keys in asked["keys"]]
    texts = _Texts(lows)
    words = _Words(_split(lows), {k for keys in lists for k in keys}, 0)
    exact, part = _counted(
        lists, len(lows), lambda k: (texts.holding(k), list({*words.holds.get(k, ()), *words.related(k)}))
    )
    n = np.array([len(keys) for keys in lists])[:, None]
    score = (exact + 0.5 * part) / np.maximum(n, 1)
    usable = (n > 0) & (score >= least) & np.array([t is not None for t in lows])
    return np.where(usable, score, np.nan)


def by_keywords(least: float) -> Scorer:
    """The share of keywords, at least ``least``; ties by ``place``."""

    def scores(asked: dict[str, list], held: dict[str, list]) -> Scores:
        share = _keyword_shares(asked, held, least)
        return share, np.broadcast_to(np.array(held["place"]), share.shape)

    return scores


def by_tier(least: float) -> Scorer:
    """100 less the tier of ``search`` and ``low``, ties by ``ord``; else :func:`by_keywords`.

    An empty title is in no tier.
    """
    keywords = by_keywords(least)

    def scores(asked: dict[str, list], held: dict[str, list]) -> Scores:
        score, place = keywords(asked, held)
        place, lows, searches = place.copy(), [t or None for t in held["low"]], asked["search"]
        trimmed = [t and t.strip(_BLANKS) for t in lows]

        def put(i: int, j: int, tier: int) -> None:
            score[i, j], place[i, j] = 100.0 - tier, held["ord"][j]

        texts, terms = _Texts(lows), _Texts(searches)
        for j, low in enumerate(lows):
            for i in terms.holding(low) if low else ():
                put(i, j, 3)
        for i, search in enumerate(searches):
            for j in texts.holding(search) if search is not None else ():
                put(i, j, 1 if trimmed[j] == search else 2)
        return score, place

    return scores


def best_row(score: np.ndarray, place: np.ndarray, *_: dict[str, list]) -> tuple[np.ndarray, ...]:
    """The best pair of each request; scores within a unit are equal, the lowest place wins."""
    usable = ~np.isnan(score)
    units = np.where(usable, np.floor(np.where(usable, score, 0.0) * SCORE_UNIT + 0.5), -np.inf)
    best = np.where(units == units.max(axis=1, keepdims=True), place, 1 << 62).argmin(axis=1)
    rows = np.flatnonzero(usable.any(axis=1))
    return rows, best[rows], np.ones(len(rows), dtype=np.int32)


def ranked_rows(above: float, most: int | None = None) -> Pick:
    """Pairs above a score, the first ``most`` of a ``term`` by score, then place. Requests
    of the same term share one ranking."""

    def pick(score: np.ndarray, place: np.ndarray, asked: dict[str, list], _: dict[str, list]) -> tuple[np.ndarray, ...]:
        numbers: dict = {}
        term = np.array([numbers.setdefault(t, len(numbers)) for t in asked["term"]])
        rows, cols = np.nonzero(score > above)
        order = np.lexsort((place[rows, cols], -score[rows, cols], term[rows]))
        rows, cols = rows[order], cols[order]
        rank = np.arange(len(rows)) - np.searchsorted(term[rows], term[rows]) + 1
        kept = rank <= most if most else slice(None)
        return rows[kept], cols[kept], rank[kept].astype(np.int32)

    return pick


def _folder(
    groups: list[str], asked_keys: dict[str, str], held_keys: dict[str, str], out: list[tuple[str, str, int]],
    scores: Scorer, pick: Pick, once: str | None, every: bool,
):
    def scored(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        kind = table.column("_kind").to_numpy()
        needed = {*asked_keys.values(), *held_keys.values(), *([once] if once else [])}
        values = {c: table.column(c).to_pylist() for c in needed}
        found = []
        for s, e in zip(starts, [*starts[1:], len(table)], strict=True):
            mid = s + int(np.searchsorted(kind[s:e], 1))
            if s < mid < e or (every and s < mid):
                at = np.arange(s, mid)
                if once and mid - s > 1:
                    first: dict = {}
                    for i in range(s, mid):
                        first.setdefault(values[once][i], i)
                    at = np.array(list(first.values()))
                left = np.arange(len(at)) if every else np.arange(0)
                if mid < e:
                    asked = {k: [values[c][i] for i in at] for k, c in asked_keys.items()}
                    held = {k: values[c][mid:e] for k, c in held_keys.items()}
                    score, place = scores(asked, held)
                    rows, cols, rank = pick(score, place, asked, held)
                    found.append((at[rows], cols + mid, score[rows, cols], rank))
                    left = np.setdiff1d(left, rows)
                if len(left):
                    none = np.full(len(left), -1)
                    found.append((at[left], none, np.full(len(left), np.nan), none.astype(np.int32)))
        if found:
            rows, cols, score, rank = map(np.concatenate, zip(*found, strict=True))
            none = cols < 0
            made = {"score": pa.array(score, mask=none), "rank": pa.array(rank, mask=none)}
            sides = [pa.array(rows), pa.array(cols, mask=none)]
            arrays = [made[name] if side == 2 else table.column(column).take(sides[side]) for name, column, side in out]
            yield from pa.table(arrays, names=[name for name, *_ in out]).to_batches()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not len(table):
                continue
            changed = np.zeros(len(table) - 1, dtype=bool)
            for group in groups:
                values = table.column(group).to_numpy(zero_copy_only=False)
                changed |= values[1:] != values[:-1]
            starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
            if starts[-1]:
                yield from scored(table.slice(0, starts[-1]).combine_chunks(), starts[:-1])
            rest = table.slice(starts[-1])
        if rest is not None:
            yield from scored(rest.combine_chunks(), [0])

    return fold


def _scored(
    requests: DataFrame, episodes: DataFrame, groups: list[str], asked_keys: dict[str, Key], held_keys: dict[str, Key],
    shown: list[str], scores: Scorer, pick: Pick, once: str | None = None, every: bool = False,
) -> DataFrame:
    """All columns of ``requests``, ``shown`` of ``episodes``, ``score`` and ``rank`` of the
    pairs that ``pick`` takes among those with equal ``groups``, which are not null.

    ``asked_keys`` and ``held_keys`` are what ``scores`` reads. Of requests of a group that
    are equal in ``once`` only one counts. With ``every`` there is a row of nulls for each
    request without a pair."""
    own = [c for c in requests.columns if c not in groups]
    needed = dict.fromkeys([*shown, *[v for v in held_keys.values() if isinstance(v, str)]])
    if any(callable(v) for v in held_keys.values()):
        needed["title"] = None
    asked = requests.select(*groups, F.lit(0).alias("_kind"), *[F.col(c).alias(f"a_{c}") for c in own])
    held = episodes.select(*groups, F.lit(1).alias("_kind"), *[F.col(c).alias(f"h_{c}") for c in needed])
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.unionByName(held, allowMissingColumns=True)
    out = [*[(c, c, 0) for c in groups], *[(c, f"a_{c}", 0) for c in own], *[(c, f"h_{c}", 1) for c in shown],
           ("score", "", 2), ("rank", "", 2)]
    types = {c: rows.schema[column].dataType for c, column, side in out if side < 2}
    types |= {"score": DoubleType(), "rank": IntegerType()}

    made, keys = [], []
    for side, named in (("a", asked_keys), ("h", held_keys)):
        made += [v(lambda c: F.col(f"{side}_{c}")).alias(f"{side}k_{k}") for k, v in named.items() if callable(v)]
        keys.append({k: f"{side}k_{k}" if callable(v) else f"{side}_{v}" for k, v in named.items()})
    fold = _folder(groups, *keys, out, scores, pick, once and f"a_{once}", every)
    return (
        rows.repartition(tasks, *groups)
        .sortWithinPartitions(*groups, "_kind")
        .select("*", *made)
        .mapInArrow(fold, StructType([StructField(c, types[c]) for c, *_ in out]))
    )


def score_podcasts(
    requests: DataFrame,
    episodes: DataFrame,
    asked_keys: dict[str, Key],
    held_keys: dict[str, Key],
    shown: list[str],
    scores: Scorer,
    pick: Pick,
    every: bool = False,
) -> DataFrame:
    """All columns of ``requests``, ``shown`` of ``episodes``, ``score`` and ``rank`` of the
    pairs that ``pick`` takes in each podcast. ``asked_keys`` and ``held_keys`` are what
    ``scores`` reads; a key that is made is made of a ``term`` or a ``title``. Requests that
    are a podcast and a ``term`` and nothing else count once for :func:`best_row`. With ``every`` there is a row
    of nulls for each request of a podcast without a pair."""
    sides = [df.where("podcast_id is not null") for df in (requests, episodes)]
    once = "term" if pick is best_row and {*requests.columns} == {"podcast_id", "term"} else None
    return _scored(*sides, ["podcast_id"], asked_keys, held_keys, shown, scores, pick, once, every)


def pairs_by_key(
    terms: DataFrame, titles: DataFrame, keys: list[str], min_similarity: float, inclusive: bool
) -> DataFrame:
    """``(*keys, term, title, similarity)`` of normalised texts that have a key in common,
    above a similarity, without those that hold each other."""

    def scores(asked: dict[str, list], held: dict[str, list]) -> Scores:
        score = word_scores(asked["norm"], held["norm"])
        return score, score

    def pick(score: np.ndarray, _, asked: dict[str, list], held: dict[str, list]) -> tuple[np.ndarray, ...]:
        rows, cols = np.nonzero(score >= min_similarity if inclusive else score > min_similarity)
        a, b = asked["norm"], held["norm"]
        apart = [a[i] not in b[j] and b[j] not in a[i] for i, j in zip(rows.tolist(), cols.tolist(), strict=True)]
        rows, cols = rows[apart], cols[apart]
        return rows, cols, np.ones(len(rows), dtype=np.int32)

    found = _scored(
        terms.select(*keys, "term"), titles.select(*keys, "title"), keys, {"norm": "term"}, {"norm": "title"},
        ["title"], scores, pick,
    )
    return found.drop("rank").withColumnRenamed("score", "similarity")
