"""Looking up noisy titles in a catalog.

``fuzzy_pairs`` is the blocked fuzzy join everything else stands on. It works on
distinct normalised texts, so copies of a term or a title cost nothing, and finds
every pair above a similarity without comparing all texts of a common word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueglass.config import DEFAULT, Limits
from cueglass.functions.text import (
    NO_WORD,
    keyword_confidence,
    low_title,
    match_key,
    non_empty,
    norm_similarity,
    plain_keywords,
    ranked_keywords,
    shared_keywords,
    split_words,
    tier_of,
    title_norm,
    trim_blank,
)
from cueglass.operators import episode_scores
from cueglass.operators.episode_search import (
    best_of,
    by_podcast_size,
    contained,
    counted_best,
    holding_words,
    related_words,
)
from cueglass.operators.scale import cut, first_by, rank_in_group, salted, shuffled, skew_join, top_per_group

# The largest boost that similarity adds to counted word matches.
MAX_BOOST = 0.15
# A title's words are indexed for queries that repeat a word start 1, 2, 3 or more times.
LEVELS = 4
SLACK = 1e-9


def norm_texts(df: DataFrame, column: str, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct match keys of texts that are not blank, per ``scope`` columns if given.

    The distinct texts are stored before their keys are made: Spark would move the test of
    a key below the distinct, to every copy of a text and into the few tasks that read it.
    """
    texts = cut(df.select(*scope, column).distinct())
    return cut(
        texts.select(*scope, match_key(F.col(column)).alias("norm"))
        .where(F.col("norm").isNotNull())
        .distinct()
        .withColumn("words", split_words(F.col("norm")))
        .withColumn("all_starts", F.transform("words", lambda w: F.substring(w, 1, 2)))
        .withColumn("starts", F.array_distinct("all_starts"))
        .withColumn("level", F.least(_most_repeats("starts", "all_starts"), F.lit(LEVELS)))
        .drop("all_starts")
    )


#: Longest word beginning that is a join key.
LONGEST_START = 16


def _starts(word: Column) -> Column:
    """Proper prefixes of 2, 3, ... characters, up to ``LONGEST_START`` of them."""
    return F.when(
        F.length(word) > 2,
        F.transform(
            F.sequence(F.lit(2), F.least(F.length(word) - 1, F.lit(LONGEST_START))),
            lambda n: F.substring(word, F.lit(1), n),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _word_keys(word: Column, whole_in: str, starts_in: str) -> Column:
    """Join keys of a word: itself, and its beginnings, tagged by their role.

    Role ``=`` joins equal words; in the two other roles one side gives the whole
    word and the other side its beginnings. A word longer than the longest beginning
    is joined by its own beginning of that length, so a long word has few keys.
    """
    key = lambda role, text: F.concat(F.lit(role), text)
    return F.concat(
        F.array(key("=", word), key(whole_in, F.substring(word, 1, LONGEST_START))),
        F.transform(_starts(word), lambda s: key(starts_in, s)),
    )


def _most_repeats(distinct: str, values: str) -> Column:
    """How often the most frequent value occurs."""
    return F.array_max(
        F.transform(distinct, lambda s: F.size(F.filter(values, lambda y: y == s)))
    )


def _title_index(
    titles: DataFrame, share: float, scope: Sequence[str], limits: Limits
) -> DataFrame:
    """Index rows ``(key, level, title, title_side)`` over the rare words of titles.

    A pair is only accepted if matched words make up more than ``share`` of the
    longer text. One title word matches at most ``level`` query words when the query
    repeats no word start more often than that, so at least ``share * n / level`` of
    the n title words must match and one of the others plus one always does. The
    rarest ones are taken. How rare a word is only steers cost, never the result.
    """
    placed = titles.select(
        *scope,
        F.col("norm").alias("title"),
        F.size("words").alias("n"),
        F.posexplode("words").alias("pos", "word"),
    )
    sized = placed.join(placed.groupBy("word").count(), "word")
    by_rarity = F.sort_array(F.collect_list(F.struct("count", "word", "pos")))
    n = F.col("n")

    def words_for(level: int) -> Column:
        if share <= 0 or level == LEVELS:
            return n
        return n - F.greatest(F.lit(1), F.ceil(n * (share / level) - SLACK)).cast("int") + 1

    taken = F.array(
        *[F.struct(F.lit(v).alias("level"), words_for(v).alias("count")) for v in range(1, LEVELS + 1)]
    )
    keys = F.transform(
        F.slice("ranked.word", 1, F.col("take.count")), lambda w: _word_keys(w, "<", ">")
    )
    ranked = cut(
        sized.groupBy(*scope, "title").agg(
            F.first("n").alias("n"), by_rarity.alias("ranked")
        )
    )
    return (
        ranked.withColumn("take", F.explode(taken))
        .select(
            *scope,
            "title",
            "take.level",
            F.explode(F.array_distinct(F.flatten(keys))).alias("key"),
        )
    )


def _can_reach(share: float) -> Column:
    """Cheap test before scoring: are enough word starts shared to reach ``share``?

    Words only match within a start, and a start holds at most ``level`` words a side.
    """
    a, b = F.col("term_side"), F.col("title_side")
    shared = F.size(F.array_intersect(a.starts, b.starts)) * a.level * b.level
    longer = F.greatest(F.size(a.words), F.size(b.words))
    return (a.level == LEVELS) | (b.level == LEVELS) | (shared > share * longer - SLACK)


def _query_probes(terms: DataFrame, scope: Sequence[str]) -> DataFrame:
    keys = F.transform(F.array_distinct("words"), lambda w: _word_keys(w, ">", "<"))
    return terms.select(
        *scope,
        F.col("norm").alias("term_side"),
        "level",
        F.explode(F.array_distinct(F.flatten(keys))).alias("key"),
    )


def _grams(norm: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` characters; none for a shorter text."""
    return F.when(
        F.length(norm) >= size,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(norm) - size + 1),
                lambda i: F.substring(norm, i, size),
            )
        ),
    )


def _contained(
    short: DataFrame, long: DataFrame, scope: Sequence[str], limits: Limits
) -> DataFrame:
    """``(short, long)`` pairs where the first text stands inside the second.

    The shorter text is looked up by its rarest piece of three characters (the text
    itself if it is shorter than that). There are fewer than 100,000 such pieces of
    normalised text, so their counts are safe to broadcast.
    """
    norm = F.col("norm")
    own_size = F.least(F.length(norm), F.lit(3)).alias("size")
    asked = short.withColumn("size", own_size)
    sizes = F.broadcast(asked.select("size").distinct())
    pieces = (
        long.select(*scope, norm.alias("long"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("size"))
        .join(sizes, "size")
        .select(*scope, "long", F.explode(_grams(F.col("long"), F.col("size"))).alias("gram"))
    )
    counts = F.broadcast(pieces.groupBy("gram").count())
    held = F.coalesce("count", F.lit(0))
    # A text with a piece that no longer text has stands inside none.
    rarest = cut(
        asked.select(*scope, norm.alias("short"), F.explode(_grams(norm, F.col("size"))).alias("gram"))
        .join(counts, "gram", "left")
        .groupBy(*scope, "short")
        .agg(F.min_by("gram", F.struct(held, "gram")).alias("gram"), F.min(held).alias("_held"))
        .where("_held > 0")
        .drop("_held")
    )
    # Only pieces that some shorter text is looked up by are worth a shuffle.
    used = F.broadcast(rarest.select("gram").distinct())
    wanted = cut(pieces.join(used, "gram", "left_semi").drop("size"))
    pairs = skew_join(wanted, rarest, [*scope, "gram"], limits)
    return pairs.where(F.contains("long", F.col("short"))).select(*scope, "short", "long")


def _spread(texts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Store texts evenly over all tasks: each one is about to grow a hundredfold."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(texts.repartition(tasks, *scope, "norm"))


def fuzzy_pairs(
    terms: DataFrame,
    titles: DataFrame,
    min_similarity: float,
    inclusive: bool = False,
    scope: Sequence[str] = (),
    limits: Limits = DEFAULT,
) -> DataFrame:
    """``(term, title, similarity)`` of normalised texts above a similarity.

    ``terms`` and ``titles`` come from :func:`norm_texts`; with ``scope`` columns only
    texts of the same scope are compared. The result is the same as scoring every
    term against every title, but for texts without any ASCII letter or digit: those
    are matched if they are equal, and to no other text. (By the letter of the scoring
    rule they would be contained in every text.)
    """
    no_word = F.startswith("norm", F.lit(NO_WORD))
    equal = (
        terms.where(no_word).select(*scope, F.col("norm").alias("term"))
        .join(titles.where(no_word).select(*scope, F.col("norm").alias("term")), [*scope, "term"])
        .select(*scope, "term", F.col("term").alias("title"), F.lit(1.0).alias("similarity"))
    )
    terms, titles = _spread(terms.where(~no_word), scope), _spread(titles.where(~no_word), scope)
    used_levels = terms.select("level").distinct()
    index = _title_index(titles, min_similarity - MAX_BOOST, scope, limits).join(
        F.broadcast(used_levels), "level"
    )
    probes = _query_probes(terms, scope)
    met_by = [*scope, "key", "level"]
    index_keys = cut(index.select(*met_by).distinct())
    if index_keys.count() <= limits.few_keys:
        # Only keys that some title has are worth a shuffle.
        probes = cut(probes.join(F.broadcast(index_keys), met_by, "left_semi"))
    # Texts that meet by a key are scored together, in blocks of about hot_pairs pairs at most.
    asked, held = salted(probes, index, met_by, limits)
    scored = episode_scores.pairs_by_key(
        asked.withColumnRenamed("term_side", "term"), held, [*met_by, "_salt"], min_similarity, inclusive
    )
    inside = _contained(terms, titles, scope, limits).select(
        *scope, F.col("short").alias("term"), F.col("long").alias("title")
    )
    around = _contained(titles, terms, scope, limits).where("short <> long").select(
        *scope, F.col("long").alias("term"), F.col("short").alias("title")
    )
    part = F.least(F.length("term"), F.length("title")) / F.greatest(
        F.length("term"), F.length("title")
    )
    held = inside.unionByName(around).withColumn(
        "similarity", F.when(F.col("term") == F.col("title"), 1.0).otherwise(0.8 + 0.2 * part)
    )
    wanted = F.col("similarity") > min_similarity
    if inclusive:
        wanted = F.col("similarity") >= min_similarity
    # A pair may meet by several words, but each one that holds the other is found once; there
    # may be very many of these, so they are not moved again.
    counted = scored.groupBy(*scope, "term", "title").agg(F.max("similarity").alias("similarity"))
    return counted.unionByName(held.where(wanted)).unionByName(equal.where(wanted))


def podcast_pairs(
    terms: DataFrame, titles: DataFrame, min_similarity: float, limits: Limits = DEFAULT
) -> DataFrame:
    """``(podcast_id, term, title)`` of :func:`fuzzy_pairs` within podcasts.

    In a podcast of few terms and titles each pair is tested as it stands: that moves every
    text once, where the index moves one row for each beginning and piece of a text.
    """
    scope = ["podcast_id"]

    def of_few(terms: DataFrame, titles: DataFrame) -> DataFrame:
        def side(texts: DataFrame, name: str) -> DataFrame:
            texts = texts.where(~F.startswith("norm", F.lit(NO_WORD)))
            return texts.select(
                *scope, F.col("norm").alias(name), F.struct("words", "starts", "level").alias(f"{name}_side")
            )

        term, title = F.col("term"), F.col("title")
        holds = F.contains(term, title) | F.contains(title, term)
        score = norm_similarity(term, title, F.col("term_side.words"), F.col("title_side.words"))
        return (
            side(terms, "term").join(shuffled(side(titles, "title")), "podcast_id")
            .where(holds | _can_reach(min_similarity - MAX_BOOST))
            .where(score > min_similarity)
            .select(*scope, "term", "title")
        )

    def of_many(terms: DataFrame, titles: DataFrame) -> DataFrame:
        found = fuzzy_pairs(terms, titles, min_similarity, scope=scope, limits=limits)
        return found.select(*scope, "term", "title")

    return by_podcast_size(cut(terms), cut(titles), limits, of_few, of_many)


def _title_ids(catalog: DataFrame) -> DataFrame:
    """``(title, podcast_id)`` by match key."""
    return catalog.select(match_key(F.col("title")).alias("title"), "podcast_id")


def match_podcasts(terms: DataFrame, podcasts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(term, podcast_id, similarity)``: the best podcast above 0.7 per match key."""
    pairs = fuzzy_pairs(
        norm_texts(terms, "term"), norm_texts(podcasts, "title"), limits.podcast_similarity,
        limits=limits,
    )
    # Once by title, so that a match key is made for each title and not for each podcast.
    first = podcasts.groupBy("title").agg(F.min("podcast_id").alias("podcast_id"))
    ids = _title_ids(cut(first)).groupBy("title").agg(F.min("podcast_id").alias("podcast_id"))
    return first_by(
        pairs.join(ids, "title").drop("title"),
        ["term"],
        [-F.col("similarity"), F.col("podcast_id")],
    )


def close_titles(terms: DataFrame, podcasts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(term, title, similarity)``: all titles of podcasts at 0.85 or above, by match key."""
    return fuzzy_pairs(
        norm_texts(terms, "term"), norm_texts(podcasts, "title"),
        limits.fuzzy_podcast_similarity, inclusive=True, limits=limits,
    )


def podcasts_by_title(podcasts: DataFrame) -> DataFrame:
    """``(title, podcast_id, nth)``: the podcasts of each match key, numbered by id."""
    ids = cut(_title_ids(podcasts).where("title is not null"))
    return rank_in_group(ids, "title", [F.col("podcast_id")], "nth")


def close_podcasts(terms: DataFrame, podcasts: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``(term, podcast_id, similarity)``: all podcasts at 0.85 or above."""
    return close_titles(terms, podcasts, limits).join(_title_ids(podcasts), "title").drop("title")


def search_podcasts(
    terms: DataFrame, podcasts: DataFrame, limits: Limits = DEFAULT, first_floor: float = 0.5
) -> DataFrame:
    """``(term, podcast_id, similarity, rank)``: the ten most similar podcasts per term.

    Any similarity above 0 counts. Terms that already have ten podcasts above
    ``first_floor`` are done, as nothing below can enter their list; only the others
    are searched without a floor.
    """
    k = limits.podcast_page
    wanted = norm_texts(terms.where(F.length("term") >= limits.min_term_chars), "term")
    titles = norm_texts(podcasts, "title")
    # Of equal titles no more than the first ten ids can be in a list. They are taken by title
    # first, so that match keys are made for few podcasts and not in the tasks that read them.
    by_id = [F.col("podcast_id")]
    few = cut(top_per_group(podcasts.select("title", "podcast_id"), ["title"], by_id, k).drop("rank"))
    ids = cut(top_per_group(_title_ids(few), ["title"], by_id, k).drop("rank"))

    def listed(texts: DataFrame, floor: float) -> DataFrame:
        rows = fuzzy_pairs(texts, titles, floor, limits=limits).join(ids, "title").drop("title")
        return top_per_group(rows, ["term"], [F.desc("similarity"), F.col("podcast_id")], k)

    good = cut(listed(wanted, first_floor))
    full = good.where(F.col("rank") == k).select(F.col("term").alias("norm"))
    rest = wanted.join(full, "norm", "left_anti")
    done = good.join(full.withColumnRenamed("norm", "term"), "term", "left_semi")
    return done.unionByName(listed(rest, 0.0))


# --- episodes -------------------------------------------------------------------------


def episode_listing(episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """One row per podcast with its listing: the newest 200 episodes, in order.

    A listed episode has its description, duration and artwork (the small one first)
    where ``episodes`` has them.
    """
    order = [F.desc_nulls_last("release_date"), F.col("episode_id")]
    page = top_per_group(episodes, ["podcast_id"], order, limits.episode_page)
    art = [F.col(c) for c in ("artwork_100", "artwork_600") if c in episodes.columns]
    shown = [c for c in ("description", "duration_ms") if c in episodes.columns]
    if art:
        art = [F.coalesce(*map(non_empty, art)).alias("artwork_url")]
    fields = [F.col("rank").alias("ord"), "episode_id", "title", "release_date", *shown, *art]
    return page.groupBy("podcast_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("listing"))


def catalog_episodes(episodes: DataFrame) -> DataFrame:
    """Every episode, with its title prepared for scoring.

    ``ord`` is its place in its podcast, newest first (nulls last), then by id;
    ``newest`` is the same with a missing date as that of 1970. Titles are stored as they
    stand; what is made of them is made where it is read. ``episodes`` is not read again.
    """
    date = F.col("release_date")
    early = F.unix_micros(date.cast("timestamp")) < 0
    named = episodes.select("podcast_id", "episode_id", "title", "release_date")
    ranked = rank_in_group(named, "podcast_id", [F.desc_nulls_last("release_date"), F.col("episode_id")], "ord")
    # Seen as from 1970, episodes without a date go before all older ones.
    moved = cut(
        ranked.groupBy("podcast_id")
        .agg(F.count(F.when(early, 1)).alias("_early"), F.count(F.when(date.isNull(), 1)).alias("_undated"))
        .where("_early > 0 and _undated > 0")
    )
    if moved.isEmpty():
        placed = ranked.withColumn("newest", F.col("ord"))
    else:
        step = F.when(date.isNull(), -F.col("_early")).when(early, F.col("_undated"))
        placed = ranked.join(moved, "podcast_id", "left").withColumn(
            "newest", (F.col("ord") + F.coalesce(step, F.lit(0))).cast("int")
        )
    placed = placed.select("podcast_id", "episode_id", "ord", "newest", "title", "release_date")
    return placed.select(
        "*",
        title_norm(F.col("title")).alias("norm"),
        split_words(title_norm(F.col("title"))).alias("norm_words"),
        low_title(F.col("title")).alias("low"),
        split_words(F.lower("title")).alias("low_words"),
    )


#: Columns of an episode that results carry.
_SHOWN = ["ord", "episode_id", "title", "release_date"]


def _scored_by_norm(requests: DataFrame, episodes: DataFrame, pick: Callable) -> DataFrame:
    asked_keys = {"norm": lambda c: title_norm(c("term")), "term": "term"}
    held_keys = {"norm": lambda c: title_norm(c("title")), "ord": "ord"}
    return episode_scores.score_podcasts(
        requests, episodes, asked_keys, held_keys, _SHOWN, episode_scores.similarities, pick
    ).withColumnRenamed("score", "similarity")


def _similar(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each request with each episode of its podcast and their similarity."""
    norm = title_norm(F.col("term"))
    keyed = requests.withColumn("_n", norm).withColumn("_w", split_words(F.col("_n")))
    score = norm_similarity(F.col("_n"), F.col("norm"), F.col("_w"), F.col("norm_words"))
    return keyed.join(episodes, "podcast_id").select(
        *requests.columns, *_SHOWN, score.alias("similarity")
    )


def _with_episode(best: DataFrame, episodes: DataFrame) -> DataFrame:
    return best.join(episodes, ["podcast_id", "ord"])


def _either_way(texts: DataFrame, titles: DataFrame, limits: Limits) -> DataFrame:
    """``(podcast_id, text, title)`` where one stands inside the other."""
    named = titles.select("podcast_id", F.col("title").alias("text"), "words")
    inside = contained(texts, named, limits).withColumnsRenamed({"short": "text", "long": "title"})
    around = contained(named, texts, limits).withColumnsRenamed({"short": "title", "long": "text"})
    return inside.unionByName(around).distinct()


def _similarity(text: str, title: str) -> Column:
    a, b = F.col(text), F.col(title)
    return norm_similarity(a, b, split_words(a), split_words(b))


def similar_episodes(
    requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """``(podcast_id, text, ord, score)`` of the most similar title per normalised text, and
    the pairs that were scored to find it; texts like no title at all are left out."""
    norm = requests.select("podcast_id", title_norm(F.col("term")).alias("text"))
    texts = cut(norm.where("text is not null").distinct().withColumn("words", split_words(F.col("text"))))
    titles = (
        episodes.where("norm is not null")
        .groupBy("podcast_id", F.col("norm").alias("title"))
        .agg(F.min("ord").alias("ord"))
        .withColumn("words", split_words(F.col("title")))
        .withColumn("_all", F.transform("words", lambda w: F.substring(w, 1, 2)))
        .withColumn("_starts", F.array_distinct("_all"))
        .withColumn("repeats", _most_repeats("_starts", "_all"))
        .select("podcast_id", "title", "words", "ord", F.col("ord").alias("place"), "repeats")
    )
    titles = cut(titles)
    places = titles.select("podcast_id", "title", "ord", "place")
    known = _either_way(texts, titles, limits).join(places, ["podcast_id", "title"])
    words = [cut(df.select(F.explode("words").alias("word")).distinct()) for df in (texts, titles)]
    gain = F.max(F.when(F.col("word") == F.col("held"), 1.0).otherwise(0.6)) * F.max("repeats")
    return counted_best(
        texts, titles, related_words(*words, least=2), gain, lambda gains, n: gains / n + MAX_BOOST,
        _similarity("text", "title"), known, limits=limits,
    )


def best_match(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Most similar episode per ``(podcast_id, term)``; the first one on ties, and the
    first of the podcast when nothing is similar at all.

    Scores that differ by less than a ten-millionth count as equal. ``episodes`` of this
    and the next functions comes from :func:`catalog_episodes`. In a podcast of very many
    requests and episodes only pairs that can be best are scored.
    """

    columns = ["podcast_id", "term", *_SHOWN, "similarity"]

    def of_few(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        return _scored_by_norm(requests, episodes, episode_scores.best_row).select(*columns)

    def of_many(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        best, _ = similar_episodes(requests, episodes, limits)
        asked = requests.select("podcast_id", "term", title_norm(F.col("term")).alias("text"))
        named = asked.join(best, ["podcast_id", "text"], "left").select(
            "podcast_id", "term",
            F.when(F.col("score") > 0, F.col("ord")).otherwise(1).alias("ord"),
            F.coalesce("score", F.lit(0.0)).alias("similarity"),
        )
        return _with_episode(named, episodes).select(*columns)

    asked = requests.select("podcast_id", "term").distinct()
    return by_podcast_size(asked, episodes, limits, of_few, of_many)


def match_episodes(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Best episode with a similarity above 0.2."""
    return best_match(requests, episodes).where(F.col("similarity") > limits.episode_similarity)


def search_episodes(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Up to ten episodes above 0.1 per request, most similar first."""
    usable = requests.where(F.length("term") >= limits.min_term_chars)
    return _listed(usable, episodes, limits.episode_list_similarity, limits.episode_results, limits)


def _listed(
    requests: DataFrame, episodes: DataFrame, above: float, most: int | None, limits: Limits
) -> DataFrame:
    """The first ``most`` episodes above a similarity per request, with their ``rank``."""
    columns = [*requests.columns, *_SHOWN, "similarity", "rank"]

    def of_few(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        return _scored_by_norm(requests, episodes, episode_scores.ranked_rows(above, most)).select(*columns)

    def of_many(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        rows = _similar(requests, episodes).where(F.col("similarity") > above)
        order = [F.desc("similarity"), F.col("ord")]
        return top_per_group(rows, ["podcast_id", "term"], order, most or 2**31 - 1).select(*columns)

    return by_podcast_size(requests, episodes, limits, of_few, of_many)


def rank_episodes(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """All episodes above 0.3 with their place by similarity."""
    return _listed(requests, episodes, limits.episode_rank_similarity, None, limits)


def keyword_candidates(
    requests: DataFrame, episodes: DataFrame, keywords: Callable[[Column], Column], least: float, place: str, limits: Limits = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """``(podcast_id, text, ord, score)`` of the title with the best share of keywords per
    term, at least ``least``, then by ``place``; and the pairs scored to find it."""
    texts = requests.select("podcast_id", F.col("term").alias("text")).where("text is not null").distinct()
    texts = cut(texts.withColumn("words", keywords(F.col("text"))).where(F.size("words") > 0))
    titles = cut(
        episodes.where("title is not null")
        .groupBy("podcast_id", F.lower("title").alias("title"))
        .agg(F.min_by("ord", place).alias("ord"), F.min(place).alias("place"))
        .withColumns({"words": split_words(F.col("title")), "repeats": F.lit(1)})
    )
    asked, held = (df.select(F.explode("words").alias("word")).distinct() for df in (texts, titles))
    asked, held = cut(asked), cut(held)
    related = related_words(asked, held, least=0).union(holding_words(asked, held, limits)).distinct()
    exact = F.max(F.contains("held", F.col("word")).cast("int"))
    part = F.max((F.startswith("held", F.col("word")) | F.startswith("word", F.col("held"))).cast("int"))
    score = shared_keywords(F.col("title"), split_words(F.col("title")), keywords(F.col("text")))
    none = texts.select("podcast_id", "text", F.lit("").alias("title"), F.lit(0).alias("ord"), F.lit(0).alias("place"))
    return counted_best(
        texts, titles, related, exact + 0.5 * part, lambda gains, n: gains / n, score, none.limit(0), least, limits
    )


def _by_keywords(
    requests: DataFrame, episodes: DataFrame, keywords: Callable[[Column], Column], least: float, place: str,
    limits: Limits,
) -> DataFrame:
    """Episode with the best share of keywords, at least ``least``, then by ``place``."""

    columns = ["podcast_id", "term", *_SHOWN, "score"]

    def of_few(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        return episode_scores.score_podcasts(
            requests, episodes,
            {"keys": lambda c: keywords(c("term"))}, {"low": lambda c: F.lower(c("title")), "place": place},
            _SHOWN, episode_scores.by_keywords(least), episode_scores.best_row,
        ).select(*columns)

    def of_many(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        best = keyword_candidates(requests, episodes, keywords, least, place, limits)[0]
        return _with_episode(best.withColumnRenamed("text", "term"), episodes).select(*columns)

    asked = requests.select("podcast_id", "term")
    best = by_podcast_size(asked, episodes, limits, of_few, of_many)
    return best.withColumn("confidence", keyword_confidence(F.col("score")))


def keyword_episode(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Episode with the best share of ranked keywords, at least 0.3; first on ties."""
    keywords = lambda text: ranked_keywords(text, limits.max_keywords)
    return _by_keywords(requests, episodes, keywords, limits.keyword_score, "ord", limits)


def best_by_keywords(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Episode with the best share of plain keywords; the newest one on ties."""
    return _by_keywords(requests, episodes, plain_keywords, limits.any_keyword_score, "newest", limits)


def _tier_matches(requests: DataFrame, episodes: DataFrame, limits: Limits) -> DataFrame:
    """``(podcast_id, term, ord)`` of the first title of the best tier per term."""
    search = trim_blank(low_title(F.col("term")))
    asked = cut(requests.select("podcast_id", "term", search.alias("text")).where("text is not null").distinct())
    texts = asked.select("podcast_id", "text").distinct().withColumn("words", split_words(F.col("text")))
    titles = cut(
        episodes.where("low is not null")
        .groupBy("podcast_id", F.col("low").alias("title"))
        .agg(F.min("ord").alias("ord"))
        .withColumn("words", split_words(F.col("title")))
    )
    pairs = _either_way(texts, titles, limits).join(titles.drop("words"), ["podcast_id", "title"])
    tier = tier_of(F.col("text"), F.col("title"))
    best = best_of(pairs.withColumns({"score": 100.0 - tier, "place": F.col("ord")}))
    return asked.join(best, ["podcast_id", "text"]).select("podcast_id", "term", "ord")


def fuzzy_episodes(requests: DataFrame, episodes: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Title match (equal, contained, containing) at confidence 0.9, else plain keywords.

    A title match goes before every keyword match.
    """
    search, low = trim_blank(low_title(F.col("term"))), F.lower("title")
    columns = ["podcast_id", "term", *_SHOWN]

    def of_few(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        return episode_scores.score_podcasts(
            requests, episodes,
            {"keys": lambda c: plain_keywords(c("term")), "search": lambda c: trim_blank(low_title(c("term")))},
            {"low": lambda c: F.lower(c("title")), "place": "newest", "ord": "ord"},
            _SHOWN, episode_scores.by_tier(limits.any_keyword_score), episode_scores.best_row,
        ).select(*columns)

    def of_many(requests: DataFrame, episodes: DataFrame) -> DataFrame:
        requests = requests.distinct()
        named = cut(_tier_matches(requests, episodes, limits))
        rest = requests.join(named, ["podcast_id", "term"], "left_anti")
        by_words, _ = keyword_candidates(
            rest, episodes, plain_keywords, limits.any_keyword_score, "newest", limits
        )
        best = named.unionByName(by_words.select("podcast_id", F.col("text").alias("term"), "ord"))
        return _with_episode(best, episodes).select(*columns)

    asked = requests.select("podcast_id", "term")
    best = by_podcast_size(asked, episodes, limits, of_few, of_many)
    found = best.select(
        *columns, tier_of(search, low_title(F.col("title"))).alias("tier"),
        shared_keywords(low, split_words(low), plain_keywords(F.col("term"))).alias("score"),
    )
    confidence = F.when(F.col("tier").isNotNull(), F.lit(0.9)).otherwise(keyword_confidence(F.col("score")))
    return found.withColumn("confidence", confidence)
