"""Min-max hashing and connected components against brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cueglass.llm.components import connected
from cueglass.llm.near_dedup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all rows with all rows."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def ordered(rows):
    return sorted(rows, key=str)


def result(spark, rows):
    return [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, number = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 300]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.1):
            rows.append((number, edited(rng, words, share)))
            number += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, corpus):
    assert ordered(result(spark, corpus)) == ordered(brute(corpus))


def test_group_whose_first_row_is_not_its_centre(spark):
    """Copies alike to the source only, the source last; the hub finds none of them."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, words, 0.02)) for i in range(60)] + [(60, " ".join(words))]
    assert ordered(result(spark, rows)) == ordered(brute(rows))


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, text), (7, text.upper()),
        (7, text), (None, text), (None, None), (8, "É a b c d"), (9, "é a b c d"), (10, text + " "),
    ]
    assert ordered(result(spark, rows)) == ordered(brute(rows))


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(10**6)) for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-10])), (3, "x" * 3_000_000)]
    assert ordered(result(spark, rows)) == [(1, 119_996, 1, True), (2, 119_986, 1, False), (3, 1, 3, True)]


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], SCHEMA + ", class long, key string")
    assert ordered(map(tuple, near_duplicates(docs).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b", "x"), (2, "A b", "y"), (3, None, "z"), (None, "a b", "n"), (1, "a b", "x")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA + ", lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert ordered(r.doc_id for r in kept.collect()) == [1, 3, None]


def test_rows_that_share_a_doc_id(spark):
    """(7, near copy of A) goes, (7, B) stays; copies without an id shrink to one."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(3, " ".join(a)), (7, " ".join(a[:-1])), (7, " ".join(b)), (9, " \t"), (9, None)]
    rows += [(1, f"text {i} of one and the same id") for i in range(5)]
    rows += [(None, "copied text")] * 20 + [(None, "Copied text"), (None, None), (None, None)]
    kept = [tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    copies = [r for r in kept if (r[1] or "").lower() == "copied text"]
    assert len(copies) == 1
    expected = [r for r in rows if (r[1] or "").lower() != "copied text" and r != (7, " ".join(a[:-1]))]
    assert ordered(r for r in kept if r not in copies) == ordered(expected)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, links):
    group = {n: n for link in links if link[0] != link[1] for n in link}
    for _ in group:
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == group


def test_components_of_a_chain(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(None, 3)]
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == dict.fromkeys(range(200), 0)


def test_columns_named_like_the_key(spark):
    rows = [(1, "a b c", 5, 6), (2, "a b c", 7, 8), (3, "d", 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_dedup_key int, NEAR_DEDUP_KEY_ int")
    assert sorted(map(tuple, drop_near_duplicates(docs).collect())) == [rows[0], rows[2]]
