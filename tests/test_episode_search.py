"""Bounded episode search against scoring every text with every title of its podcast."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cueglass.config import Limits
from cueglass.functions.text import (
    low_title,
    match_tier,
    norm_similarity,
    plain_keywords,
    ranked_keywords,
    shared_keywords,
    split_words,
    title_norm,
)
from cueglass.operators import catalog, scale
from cueglass.operators.episode_search import contained, holding_words, related_words
from cueglass.workload import inputs

STOCK = [
    "the", "a", "an", "art", "smart", "part", "artist", "go", "going", "gone", "episode", "12", "1", "2", "é", "naïve",
    "supplier#0001", "supplier#0002", "january", "jan", "x", "xx", "!!!", "1-urgent", "urgent", "of", "日本", "radio-show",
]


def corpus(seed):
    rng = random.Random(seed)

    def text():
        words = [rng.choice(STOCK) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 7]))]
        return rng.choice(["", "", " "]) + rng.choice([" ", " ", "  "]).join(words) + rng.choice(["", "", " ", "."])

    titles = [(rng.choice([1, 1, 1, 2, 3]), i, text(), f"20{rng.randrange(10, 20)}-01-01") for i in range(120)]
    titles += [(4, 900, None, "2019-01-01"), (4, 901, "", None), (5, 902, "日本語", None), (5, 903, "日本", "2011-01-01")]
    titles += [(1, 1000 + i, "same title", "2012-01-01") for i in range(30)]
    terms = [(rng.choice([1, 1, 2, 3, 4, 5, 9]), text()) for _ in range(120)]
    for podcast, _, title, _ in titles[:40]:
        cut_at = rng.randrange(len(title) + 1)
        terms += [(podcast, title[:cut_at]), (podcast, title[cut_at:]), (podcast, f"on {title} today")]
    terms += [(1, None), (4, "a"), (5, "x"), (5, "日本"), (1, " "), (1, "going going gone"), (1, "nothing like it")]
    return titles, terms + terms[:30]


@pytest.fixture(params=[(2, 50_000), (3, 20)], ids=["whole", "split"])
def case(spark, request):
    seed, hot = request.param
    titles, terms = corpus(seed)
    episodes = spark.createDataFrame(titles, "podcast_id long, episode_id long, title string, d string").select(
        "podcast_id", "episode_id", "title", F.to_timestamp("d").alias("release_date")
    )
    requests = spark.createDataFrame(terms, "podcast_id long, term string")
    listed = scale.cut(catalog.catalog_episodes(episodes))
    return requests, listed, Limits(hot_pairs=hot)


def best_of_all(requests, listed, score, place, least=None):
    pairs = requests.distinct().join(listed, "podcast_id").withColumn("score", score)
    if least is not None:
        pairs = pairs.where(F.col("score") >= least)
    order = F.struct(-F.round(F.coalesce("score", F.lit(0.0)) * 10**7), place)
    rows = pairs.groupBy("podcast_id", "term").agg(F.min_by(F.struct("ord", "score"), order).alias("x"))
    return sorted([(r.podcast_id, r.term, r.x.ord, round(r.x.score or 0, 6)) for r in rows.collect()], key=str)


def rows_of(found, score):
    return sorted([(r.podcast_id, r.term, r.ord, round(r[score] or 0, 6)) for r in found.collect()], key=str)


def test_best_match(case):
    requests, listed, limits = case
    norm = title_norm(F.col("term"))
    score = norm_similarity(norm, F.col("norm"), split_words(norm), F.col("norm_words"))
    want = best_of_all(requests, listed, score, F.col("ord"))
    assert rows_of(catalog.best_match(requests, listed, limits), "similarity") == want


@pytest.mark.parametrize("kind", ["ranked", "plain"])
def test_keywords(case, kind):
    requests, listed, limits = case
    keywords = ranked_keywords(F.col("term")) if kind == "ranked" else plain_keywords(F.col("term"))
    score = shared_keywords(F.lower("title"), F.col("low_words"), keywords)
    if kind == "ranked":
        want = best_of_all(requests, listed, score, F.col("ord"), limits.keyword_score)
        found = catalog.keyword_episode(requests, listed, limits)
    else:
        want = best_of_all(requests, listed, score, F.col("newest"), limits.any_keyword_score)
        found = catalog.best_by_keywords(requests, listed, limits)
    assert rows_of(found, "score") == want and want


def test_title_tiers_go_before_keywords(case):
    requests, listed, limits = case
    tier = match_tier(F.col("term"), F.col("title"))
    score = shared_keywords(F.lower("title"), F.col("low_words"), plain_keywords(F.col("term")))
    rows = requests.distinct().join(listed, "podcast_id").select("*", tier.alias("tier"), score.alias("score"))
    rows = rows.where("tier is not null or score >= 0.00001")
    order = F.struct(
        F.coalesce("tier", F.lit(4)),
        F.when(F.col("tier").isNull(), -F.round(F.col("score") * 10**7)),
        F.when(F.col("tier").isNull(), F.col("newest")).otherwise(F.col("ord")),
    )
    want = rows.groupBy("podcast_id", "term").agg(F.min_by("ord", order).alias("ord"))
    got = catalog.fuzzy_episodes(requests, listed, limits)
    key = lambda df: sorted([(r.podcast_id, r.term, r.ord) for r in df.collect()], key=str)
    assert key(got) == key(want)


@pytest.mark.parametrize("find,above,most", [
    (catalog.search_episodes, 0.1, 10), (catalog.rank_episodes, 0.3, 10**9)], ids=["search", "rank"])
def test_listed_episodes(case, find, above, most):
    """Every pair above the floor, ranked; a request that comes twice has each episode twice."""
    requests, listed, limits = case
    if find is catalog.search_episodes:
        requests = requests.where("length(term) >= 2")
    norm = title_norm(F.col("term"))
    score = norm_similarity(norm, F.col("norm"), split_words(norm), F.col("norm_words"))
    rows = requests.join(listed, "podcast_id").withColumn("s", score).where(F.col("s") > above)
    order = Window.partitionBy("podcast_id", "term").orderBy(F.desc("s"), "ord")
    want = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    key = lambda df, s: sorted([(r.podcast_id, r.term, r["rank"], r.ord, r.episode_id, r.title, r[s]) for r in df.collect()], key=str)
    got = find(requests, listed, limits)
    assert got.columns == ["podcast_id", "term", "ord", "episode_id", "title", "release_date", "similarity", "rank"]
    assert key(got, "similarity") == key(want, "s") and got.count() > 300


def test_pairs_of_small_podcasts_are_scored_in_place(case):
    """No row for each pair: episodes meet requests in one fold, and no window ranks them."""
    requests, listed, _ = case
    requests = scale.cut(requests)
    for find in (catalog.best_match, catalog.search_episodes, catalog.rank_episodes,
                 catalog.keyword_episode, catalog.best_by_keywords, catalog.fuzzy_episodes):
        plan = find(requests, listed)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Window" not in plan


def test_podcasts_across_batches(spark):
    """A podcast may begin in one Arrow batch and end in another one."""
    titles = [(k % 7, k, f"part {k} of {'abcdef'[k % 6] * 3}") for k in range(300)]
    episodes = spark.createDataFrame(titles, "podcast_id long, episode_id long, title string")
    listed = scale.cut(catalog.catalog_episodes(episodes.withColumn("release_date", F.lit(None).cast("timestamp"))))
    requests = spark.createDataFrame([(p, title[:-1]) for p, _, title in titles], "podcast_id long, term string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        found = {(r.podcast_id, r.term): r.episode_id for r in catalog.best_match(requests, listed).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(p, title[:-1]): k for p, k, title in titles}


def test_contained_finds_all(spark):
    titles, terms = corpus(7)
    def distinct(rows):
        df = spark.createDataFrame(rows, "podcast_id long, text string").select("podcast_id", low_title(F.col("text")).alias("text"))
        return df.where("text is not null").distinct().withColumn("words", split_words(F.col("text")))
    short, long = distinct(terms), distinct([(t[0], t[2]) for t in titles])
    for a, b in ((short, long), (long, short)):
        want = a.select("podcast_id", F.col("text").alias("short")).join(
            b.select("podcast_id", F.col("text").alias("long")), "podcast_id").where(F.contains("long", F.col("short")))
        got = contained(a, b)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_word_relations(spark):
    words = ["", "a", "ab", "abc", "b", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrs", "zabc", "é"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for least in (0, 2):
        want = {(a, b) for a in words for b in words if a == b or (min(len(a), len(b)) >= least and (a.startswith(b) or b.startswith(a)))}
        assert {tuple(r) for r in related_words(df, df, least).collect()} == want
    want = {(a, b) for a in words for b in words if a and a in b}
    assert {tuple(r) for r in holding_words(df, df).collect()} == want


def test_repeated_words_do_not_overflow(spark):
    title = " ".join(["word"] * 450)
    episodes = spark.createDataFrame([(1, 1, f"{title} end"), (1, 2, "other")], "podcast_id long, episode_id long, title string")
    listed = catalog.catalog_episodes(episodes.withColumn("release_date", F.lit(None).cast("timestamp")))
    requests = spark.createDataFrame([(1, f"start {title}")], "podcast_id long, term string")
    assert [r.episode_id for r in catalog.best_match(requests, listed).collect()] == [1]


def test_few_pairs_are_scored(spark):
    """Of all pairs of a request and an episode of its podcast, under a tenth is looked at."""
    t = inputs.Tables(spark, "/root/testdata/sf0.01")
    requests, listed = inputs.episode_terms(t), scale.cut(catalog.catalog_episodes(inputs.episodes(t)))
    everything = requests.join(listed, "podcast_id").count()
    _, scored = catalog.similar_episodes(requests, listed)
    assert scored.count() < everything / 10
    _, scored = catalog.keyword_candidates(requests, listed, plain_keywords, 0.00001, "newest")
    assert scored.count() < everything / 10


def test_a_podcast_with_most_episodes_is_split(spark, monkeypatch):
    """One podcast, one word in every title: its pairs are dealt over many tasks."""
    rows = [(1, i, f"daily news {i % 40} of {i}") for i in range(1500)]
    episodes = spark.createDataFrame(rows, "podcast_id long, episode_id long, title string")
    listed = scale.cut(catalog.catalog_episodes(episodes.withColumn("release_date", F.lit(None).cast("timestamp"))))
    requests = spark.createDataFrame([(1, f"news daily {chr(97 + i % 26)}{i}") for i in range(400)], "podcast_id long, term string")
    seen = []
    real = scale.skew_join

    def watched(many, few, keys, limits):
        out = real(many, few, keys, limits)
        seen.append(out)
        return out

    monkeypatch.setattr("cueglass.operators.episode_search.skew_join", watched)
    _, scored = catalog.similar_episodes(requests, listed, Limits(hot_pairs=2000))
    assert scored.where("score > 0").distinct().count() == 400 * 1500
    sizes = [max(n for (n,) in df.groupBy(F.spark_partition_id()).count().select("count").collect()) for df in seen if not df.isEmpty()]
    assert max(sizes) < 400 * 1500 / 3


def test_requests_and_episodes_move_once(spark):
    """Requests that come twice count once, and nothing is moved to find them."""
    titles, terms = corpus(3)
    episodes = spark.createDataFrame([t[:3] for t in titles], "podcast_id long, episode_id long, title string")
    listed = catalog.catalog_episodes(episodes.withColumn("release_date", F.lit(None).cast("timestamp")))
    asked = scale.cut(spark.createDataFrame([*terms, *terms], "podcast_id long, term string"))
    for find in (catalog.best_by_keywords, catalog.fuzzy_episodes):
        best = find(asked, listed)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1
        rows = [(r.podcast_id, r.term) for r in best.collect()]
        assert len(rows) == len(set(rows)) > 0
