"""The blocked fuzzy join against scoring every pair, and the catalog lookups."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cueglass.config import Limits
from cueglass.functions.text import title_norm, title_similarity
from cueglass.operators import catalog, scale


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "the", "a", "hidden", "hid", "brain", "brains", "br", "daily", "show", "news",
             "news!", "new", "science", "sci", "talk", "talks", "x", "y", "-", "2.0", "in", "inn"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(n)]
    return out + ["! hidden", "? the", "日本", "", "the the the", "abc hidden xyz", "idden", "a", "ab"]


def brute_force(spark, terms, titles, low, inclusive):
    t = spark.createDataFrame([(x,) for x in terms], "t string")
    c = spark.createDataFrame([(x,) for x in titles], "c string")
    n = t.withColumn("term", title_norm(F.col("t"))).where(F.col("term").rlike(r"\S"))
    m = c.withColumn("title", title_norm(F.col("c"))).where(F.col("title").rlike(r"\S"))
    rows = (
        n.dropDuplicates(["term"])
        .crossJoin(m.dropDuplicates(["title"]))
        .withColumn("s", title_similarity(F.col("t"), F.col("c")))
        .collect()
    )
    out = {}
    for r in rows:
        if r.s > low or (inclusive and r.s >= low):
            out[r.term, r.title] = round(r.s, 9)
    return out


@pytest.mark.parametrize("low,inclusive", [(0.7, False), (0.85, True), (0.5, False), (0.0, False)])
@pytest.mark.parametrize("limits", [Limits(), Limits(hot_pairs=30)])
def test_fuzzy_pairs_lose_nothing(spark, low, inclusive, limits):
    terms, titles = texts(1, 150), texts(2, 200)
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    c = spark.createDataFrame([(x,) for x in titles], "title string")
    got = catalog.fuzzy_pairs(
        catalog.norm_texts(t, "term"), catalog.norm_texts(c, "title"), low, inclusive,
        limits=limits,
    ).collect()
    found = {(r.term, r.title): round(r.similarity, 9) for r in got}
    assert len(found) == len(got)
    assert found.pop(("\0日本", "\0日本")) == 1.0
    assert found == brute_force(spark, terms, titles, low, inclusive)


def test_no_nested_loop_or_python_in_plan(spark):
    t = spark.createDataFrame([("hidden brain",)], "term string")
    c = spark.createDataFrame([("hidden brain",)], "title string")
    pairs = catalog.fuzzy_pairs(catalog.norm_texts(t, "term"), catalog.norm_texts(c, "title"), 0.7)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert bad not in plan


PODCASTS = [
    (1, "Hidden Brain"), (2, "Hidden Brain Weekly"), (3, "Science Talks"), (4, "Daily News"),
    (5, "hidden brain!"), (6, "Planet Money"),
]


def test_match_podcasts_best_then_lowest_id(spark):
    podcasts = spark.createDataFrame(PODCASTS, "podcast_id bigint, title string")
    terms = spark.createDataFrame(
        [("HIDDEN BRAIN",), ("Hidd Brain",), ("Sci Talks",), ("nothing like it",)], "term string"
    )
    got = {r.term: (r.podcast_id, round(r.similarity, 6))
           for r in catalog.match_podcasts(terms, podcasts).collect()}
    assert got == {"hidden brain": (1, 1.0), "hidd brain": (1, 0.95), "sci talks": (3, 0.95)}


def test_search_podcasts_is_exact_top_ten(spark):
    titles = [t for t in dict.fromkeys(texts(5, 120)) if t.strip()]
    podcasts = spark.createDataFrame(list(enumerate(titles)), "podcast_id bigint, title string")
    terms = ["hidden brain", "the daily show", "sci", "inn", "zzz"]
    term_df = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {}
    for r in catalog.search_podcasts(term_df, podcasts).collect():
        got.setdefault(r.term, []).append((r.rank, r.podcast_id))
    scored = brute_force(spark, terms, titles, 0.0, False)
    norms = {r.podcast_id: r.n for r in podcasts.select("podcast_id", title_norm(F.col("title")).alias("n")).collect()}
    for term in terms:
        rows = sorted((-scored[term, n], i) for i, n in norms.items() if (term, n) in scored)[:10]
        assert [i for _, i in sorted(got.get(term, []))] == [i for _, i in rows]


EPISODES = [
    (1, 11, "Pilot", "2020-01-01"), (1, 12, "The Hidden Persuaders", "2021-01-01"),
    (1, 13, "Persuaders again", "2022-01-01"), (2, 21, "You 2.0: The Passion Pill", "2020-05-05"),
]


def episodes(spark):
    return spark.createDataFrame(
        EPISODES, "podcast_id bigint, episode_id bigint, title string, d string"
    ).select("podcast_id", "episode_id", "title", F.to_timestamp("d").alias("release_date"))


def test_episode_lookups(spark):
    listing = catalog.catalog_episodes(episodes(spark))
    requests = spark.createDataFrame(
        [(1, "the pilot"), (1, "persuaders of men"), (1, "zzz"), (2, "passion")],
        "podcast_id bigint, term string",
    )
    best = {(r.podcast_id, r.term): (r.episode_id, round(r.similarity, 4))
            for r in catalog.best_match(requests, listing).collect()}
    assert best[1, "the pilot"] == (11, round(0.8 + 0.2 * 5 / 9, 4))
    assert best[1, "zzz"] == (13, 0.0)  # nothing alike: first of the listing (newest)
    assert {(r.term) for r in catalog.match_episodes(requests, listing).collect()} == {
        "the pilot", "persuaders of men", "passion"
    }
    fuzzy = {r.term: (r.episode_id, round(r.confidence, 4))
             for r in catalog.fuzzy_episodes(requests, listing).collect()}
    assert fuzzy["the pilot"] == (11, 0.9)
    # "persuaders" is exact and partial in two titles, "men" in none: the newer title wins
    assert fuzzy["persuaders of men"] == (13, round(0.5 + 0.3 * 0.75, 4))
    assert "zzz" not in fuzzy
    keyword = {r.term: r.episode_id for r in catalog.keyword_episode(requests, listing).collect()}
    assert keyword == {"the pilot": 11, "persuaders of men": 13, "passion": 21}


def test_listing_is_bounded(spark):
    rows = [(1, i, f"t{i}", None) for i in range(250)]
    df = spark.createDataFrame(
        rows, "podcast_id bigint, episode_id bigint, title string, release_date timestamp"
    )
    listing = catalog.episode_listing(df).first().listing
    assert [e.episode_id for e in listing] == list(range(200))
    assert list(itertools.islice((e.ord for e in listing), 3)) == [1, 2, 3]


def test_short_and_other_scripts_are_matched(spark):
    titles = ["Go daily", "IT", "日本語ラジオ", "Émission", "!!!", "x" * 10_000]
    podcasts = spark.createDataFrame(list(enumerate(titles)), "podcast_id bigint, title string")
    terms = ["Go", "IT daily", "日本語ラジオ ", "émission", "!!!", "日本", "x" * 10_000, " ", None]
    got = {r.term: r.podcast_id for r in catalog.match_podcasts(
        spark.createDataFrame([(t,) for t in terms], "term string"), podcasts).collect()}
    assert got == {
        "go": 0, "it daily": 1, "\0日本語ラジオ": 2, "mission": 3, "\0!!!": 4, "x" * 10_000: 5
    }


def test_long_words_meet_by_their_beginnings(spark):
    word = "abcdefghijklmnopqrstuvwxyz"
    t = spark.createDataFrame([(f"{word[:20]} news",), (f"{word[:16]} show",)], "term string")
    c = spark.createDataFrame([(f"news {word}",), (f"show {word[:17]}",)], "title string")
    got = catalog.fuzzy_pairs(catalog.norm_texts(t, "term"), catalog.norm_texts(c, "title"), 0.7).collect()
    assert {(r.term[-4:], r.title[:4]) for r in got} == {("news", "news"), ("show", "show")}


def test_all_episodes_are_matched(spark):
    rows = [(1, i, f"part {i}", f"2020-01-{1 + i % 28:02d}") for i in range(300)]
    rows.append((1, 999, "the oldest of all", "2001-01-01"))
    old = spark.createDataFrame(rows, "podcast_id bigint, episode_id bigint, title string, d string").select(
        "podcast_id", "episode_id", "title", F.to_timestamp("d").alias("release_date"))
    requests = spark.createDataFrame([(1, "oldest of all")], "podcast_id bigint, term string")
    listed = catalog.catalog_episodes(old)
    for find in (catalog.match_episodes, catalog.search_episodes, catalog.keyword_episode,
                 catalog.best_by_keywords, catalog.fuzzy_episodes):
        assert [r.episode_id for r in find(requests, listed).collect()] == [999]


def test_best_match_is_a_hash_aggregate(spark, tmp_path):
    catalog.catalog_episodes(episodes(spark)).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([(1, "a")], "podcast_id bigint, term string").write.parquet(f"{tmp_path}/r")
    best = catalog.best_match(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/e"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_places_in_a_podcast_with_a_third_of_all_episodes(spark, monkeypatch):
    """Places equal those of one window per podcast; no range holds much more than others."""
    rows = [(1 if i % 3 == 0 else 2 + i % 200, i, f"t{i}", [None, "1950-01-01", f"20{10 + i % 9}-0{1 + i % 7}-11", "1970-01-01"][i * 7 % 4])
            for i in range(6000)]
    rows += [(None, 7000, "x", None), (None, 7001, "y", "2000-01-01"), (1, 7002, None, "1969-12-31")]
    df = spark.createDataFrame(rows, "podcast_id bigint, episode_id bigint, title string, d string").select(
        "podcast_id", "episode_id", "title", F.to_timestamp("d").alias("release_date"))
    dealt = []
    real = scale.cut
    monkeypatch.setattr(scale, "cut", lambda x: dealt.append(real(x)) or dealt[-1])
    got = {r.episode_id: (r.ord, r.newest) for r in catalog.catalog_episodes(df).collect()}
    of_podcast = Window.partitionBy("podcast_id")
    as_of_1970 = F.coalesce(F.unix_micros("release_date"), F.lit(0))
    want = df.select(
        "episode_id",
        F.row_number().over(of_podcast.orderBy(F.desc_nulls_last("release_date"), "episode_id")).alias("ord"),
        F.row_number().over(of_podcast.orderBy(as_of_1970.desc(), F.desc_nulls_last("release_date"), "episode_id")).alias("newest"),
    )
    assert got == {r.episode_id: (r.ord, r.newest) for r in want.collect()}
    sizes = sorted(r["count"] for r in dealt[0].groupBy("_range").count().collect())
    assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_pairs_of_small_podcasts_need_no_index(spark, monkeypatch):
    """Both ways find the pairs of scoring every text against every title of its podcast."""
    parts = ["ab", "abc", "abcd", "x", "xy", "Talk", "talks", "ab ab", "", "日本", "on-air"]
    texts = [(k % 3, " ".join(parts[(k * 7 + i * i) % 11] for i in range(1 + k % 4))) for k in range(60)]
    asked = spark.createDataFrame(texts[:30], "podcast_id int, term string")
    held = spark.createDataFrame(texts[20:], "podcast_id int, title string")
    sides = [catalog.norm_texts(asked, "term", ["podcast_id"]), catalog.norm_texts(held, "title", ["podcast_id"])]
    has_word = lambda r: not r[1].startswith("\0") and not r[2].startswith("\0")
    every = {tuple(r) for r in catalog.podcast_pairs(*sides, 0.7, Limits(hot_pairs=1)).collect() if has_word(r)}
    monkeypatch.delattr(catalog, "fuzzy_pairs")
    direct = [tuple(r) for r in catalog.podcast_pairs(*sides, 0.7).collect()]
    assert len(direct) == len(set(direct)) and set(direct) == every and len(every) > 30


def test_match_keys_are_made_for_distinct_texts(spark, monkeypatch):
    """Copies of a text cost one key, as do all but the first podcasts of a title."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(title):
        made.add(1)
        return title and title.lower()

    monkeypatch.setattr(catalog, "match_key", key)
    titles = [f"{w} {v}" for w in ("Hidden", "Daily", "Science", "Planet") for v in ("Brain", "News", "Talks")]
    rows = [(i, titles[i % 12]) for i in range(3000)]
    podcasts = spark.createDataFrame(rows, "podcast_id bigint, title string")
    terms = podcasts.select("podcast_id", F.upper("title").alias("term"))
    assert catalog.norm_texts(terms, "term").count() == 12
    assert made.value < 300
    found = catalog.search_podcasts(terms, podcasts).collect()
    best = [(r.podcast_id, r.rank) for r in found if r.term == "hidden news"]
    assert len(found) == 120 and sorted(best) == [(1 + 12 * i, i + 1) for i in range(10)]
    assert {r.podcast_id for r in catalog.match_podcasts(terms, podcasts).collect()} == set(range(12))
    assert made.value < 3000


def test_each_pair_is_found_once_and_only_keys_of_titles_are_moved(spark, monkeypatch):
    """A text that holds the other one, meeting it by several words, gives one row unmoved."""
    t = spark.createDataFrame([(x,) for x in texts(7, 80)], "term string")
    c = spark.createDataFrame([(x,) for x in texts(8, 30) if "x" not in x], "title string")
    stored, real = [], catalog.cut
    monkeypatch.setattr(catalog, "cut", lambda df: stored.append(real(df)) or stored[-1])
    terms, titles = catalog.norm_texts(t, "term"), catalog.norm_texts(c, "title")
    pairs = {}
    for few in (0, 100_000):
        stored.clear()
        rows = catalog.fuzzy_pairs(terms, titles, 0.5, limits=Limits(few_keys=few)).collect()
        pairs[few] = {(r.term, r.title, round(r.similarity, 9)) for r in rows}
        assert len(pairs[few]) == len(rows)
        assert sum("term_side" in df.columns for df in stored) == (few > 0)
    assert pairs[0] == pairs[100_000] and len(rows) > 50
    keys = {r.key for df in stored if "term_side" in df.columns for r in df.collect()}
    assert "=hidden" in keys and "=x" not in keys


def test_texts_of_a_key_are_scored_together(spark, monkeypatch):
    """No row for each pair that meets: rows that are moved are texts with a key."""
    made = []
    real = catalog.episode_scores.pairs_by_key

    def watched(asked, held, *rest):
        made.append((asked.count(), held.count()))
        return real(asked, held, *rest)

    monkeypatch.setattr(catalog.episode_scores, "pairs_by_key", watched)
    t = spark.createDataFrame([(f"Daily Show {i} a",) for i in range(300)], "term string")
    c = spark.createDataFrame([(f"Show Daily {i} b",) for i in range(300)], "title string")
    terms, titles = catalog.norm_texts(t, "term"), catalog.norm_texts(c, "title")
    got = {(r.term, r.title): round(r.similarity, 9) for r in catalog.fuzzy_pairs(terms, titles, 0.5).collect()}
    # Three equal words of four; or two, and a number that the other one begins with.
    want = {}
    for i in range(300):
        for j in range(300):
            a, b = str(i), str(j)
            part = 0 if a == b else int(min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a)))
            score = (2 + (a == b) + 0.6 * part) / 4 + 0.15 * part
            if score > 0.5:
                want[f"daily show {i} a", f"show daily {j} b"] = round(score, 9)
    assert got == want and len(want) > 300
    assert sum(map(sum, made)) < 300 * 300 / 2
