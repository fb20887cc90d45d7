"""Text expressions: normalising, tokens, similarity, keywords, title matching.

All functions take and return Columns, so they stay inside the JVM. Character
classes are ASCII on purpose: an accented letter counts as punctuation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored by the ranked keyword list.
RANKED_STOP_WORDS = """
the and for with that this but not you are was were been have has had will would could should
from into during including until against among throughout despite towards upon concerning to of
in on at by since ago before after within without under over above below between behind front
next near far away out off onto up down again further then once here there when where why how
all any both each few more most other some such no nor only own same so than too very can just
don now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
shan shouldn wasn weren won wouldn
""".split()

# Words ignored by the plain keyword list.
PLAIN_STOP_WORDS = """
the a an and or but in on at to for of with by is are was were be been being have has had do does
did will would could should may might can this that these those
""".split()

NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"

# Spaces other than the six ASCII ones that count as blank in source text.
_WIDE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def plain_spaces(text: Column) -> Column:
    """Turn wide Unicode spaces into plain ones; apply when loading text."""
    return F.translate(text, _WIDE_SPACES, " " * len(_WIDE_SPACES))


#: What ``\s`` stands for.
_BLANKS = " \t\n\x0b\f\r"


def trim_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def title_norm(title: Column) -> Column:
    """Lower, trim, delete punctuation; null for a missing or empty title."""
    return F.regexp_replace(trim_blank(F.lower(non_empty(title))), r"[^\w\s]", "")


#: Stands before texts without any ASCII letter or digit; occurs in no normalised text.
NO_WORD = "\u0000"


def match_key(title: Column) -> Column:
    """The text that titles are matched by.

    It is the normalised title. A title that normalises to nothing, as one in another
    script does, is known by its lowered, trimmed original instead. Null for a title
    that is missing or blank.
    """
    plain = trim_blank(F.lower(non_empty(title)))
    return F.when(title_norm(title).rlike(r"\S"), title_norm(title)).when(
        plain != "", F.concat(F.lit(NO_WORD), plain)
    )


def split_words(text: Column) -> Column:
    return F.split(text, r"\s+")


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on lowered text without punctuation."""

    def clean(x: Column) -> Column:
        return trim_blank(F.regexp_replace(F.lower(non_empty(x)), r"[^\w\s]", ""))

    def score(p: Column) -> Column:
        longer = F.greatest(F.length(p.x), F.length(p.y))
        return (
            F.when(p.x.isNull() | p.y.isNull(), F.lit(0.0))
            .when(p.x == p.y, F.lit(1.0))
            .otherwise(1 - F.levenshtein(p.x, p.y) / longer)
        )

    return bind(F.struct(clean(a).alias("x"), clean(b).alias("y")), score)


# Both counts of word matches travel in one number: prefix matches above this unit.
_PART = 1 << 31


def _count_matches(words: Column, others: Column) -> Column:
    """Equal pairs plus ``_PART`` times prefix-related pairs, over all pairs of words."""
    zero = F.lit(0).cast("bigint")

    def weight(x: Column, y: Column) -> Column:
        related = F.startswith(x, y) | F.startswith(y, x)
        return (
            F.when(x == y, 1)
            .when((F.length(x) >= 2) & (F.length(y) >= 2) & related, _PART)
            .otherwise(zero)
        )

    return F.aggregate(
        words, zero, lambda n, x: n + F.aggregate(others, zero, lambda m, y: m + weight(x, y))
    )


def norm_similarity(n1: Column, n2: Column, w1: Column, w2: Column) -> Column:
    """Title similarity of two texts already normalised and split into words.

    Side 1 is the search side: the boost for prefix matches alone depends on it.
    """

    def from_counts(m: Column) -> Column:
        exact, part = m % _PART, F.floor(m / _PART)
        n_search = F.size(w1)
        base = (exact + 0.6 * part) / F.greatest(n_search, F.size(w2))
        return (
            F.when((exact > 0) & (part > 0), F.least(F.lit(1.0), base + 0.15))
            .when((part > 0) & (0.6 * part >= 0.5 * n_search), F.least(F.lit(1.0), base + 0.1))
            .otherwise(base)
        )

    shorter, longer = F.least(F.length(n1), F.length(n2)), F.greatest(F.length(n1), F.length(n2))
    return (
        F.when(n1.isNull() | n2.isNull(), F.lit(0.0))
        .when(n1 == n2, F.lit(1.0))
        .when(F.contains(n1, n2) | F.contains(n2, n1), 0.8 + 0.2 * (shorter / longer))
        .otherwise(bind(_count_matches(w1, w2), from_counts))
    )


def title_similarity(search: Column, title: Column) -> Column:
    """The main scorer: equality, containment, then counted word matches."""

    def with_words(t: Column) -> Column:
        sides = F.struct(
            t.a.alias("a"), t.b.alias("b"),
            split_words(t.a).alias("a_words"), split_words(t.b).alias("b_words"),
        )
        return bind(sides, lambda s: norm_similarity(s.a, s.b, s.a_words, s.b_words))

    texts = F.struct(title_norm(search).alias("a"), title_norm(title).alias("b"))
    return bind(texts, with_words)


def ranked_keywords(text: Column, limit: int = 8) -> Column:
    """Words used once first, then longer words, then text order; at most ``limit``.

    Sorting the (word, position) pairs puts repeats side by side, so uniqueness
    needs only the two neighbours and the whole thing is n log n inside one row.
    """
    cleaned = trim_blank(F.regexp_replace(F.lower(text), r"[^\w\s]", " "))
    words = F.filter(
        split_words(cleaned), lambda w: (F.length(w) >= 2) & ~w.isin(RANKED_STOP_WORDS)
    )
    placed = F.sort_array(
        F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    )

    def rank(s: Column) -> Column:
        def key(x: Column, i: Column) -> Column:
            repeated = F.coalesce(
                (i > 0) & (F.get(s, i - 1).word == x.word), F.lit(False)
            ) | F.coalesce(F.get(s, i + 1).word == x.word, F.lit(False))
            return F.struct(
                repeated.alias("repeated"),
                (-F.length(x.word)).alias("shortness"),
                x.pos.alias("pos"),
                x.word.alias("word"),
            )

        return F.transform(
            F.slice(F.sort_array(F.transform(s, key)), 1, limit), lambda k: k.word
        )

    return bind(placed, rank)


def plain_keywords(text: Column) -> Column:
    """Words longer than two characters outside the short stop list, in order."""
    cleaned = F.regexp_replace(trim_blank(F.lower(text)), r"[^\w\s]", " ")
    return F.filter(
        split_words(cleaned), lambda w: (F.length(w) > 2) & ~w.isin(PLAIN_STOP_WORDS)
    )


def _prefix_related(keyword: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.startswith(w, keyword) | F.startswith(keyword, w))


def _match_sides(title: Column, keywords: Column) -> Column:
    low = F.lower(title)
    return F.struct(low.alias("low"), split_words(low).alias("words"), keywords.alias("keys"))


def keyword_match(title: Column, keywords: Column) -> Column:
    """Struct of ``exact``, ``part`` (keyword arrays), ``score`` and ``matched``.

    ``score`` is null when there are no keywords.
    """

    def lists(t: Column) -> Column:
        return F.struct(
            F.filter(t["keys"], lambda k: F.contains(t.low, k)).alias("exact"),
            F.filter(t["keys"], lambda k: _prefix_related(k, t.words)).alias("part"),
            F.size(t["keys"]).alias("n"),
        )

    def result(m: Column) -> Column:
        total = F.size(m.exact) + 0.5 * F.size(m.part)
        return F.struct(
            m.exact.alias("exact"),
            m.part.alias("part"),
            F.when(m.n > 0, total / m.n).alias("score"),
            F.concat(
                m.exact, F.filter(m.part, lambda k: ~F.array_contains(m.exact, k))
            ).alias("matched"),
        )

    return bind(bind(_match_sides(title, keywords), lists), result)


def shared_keywords(low: Column, words: Column, keywords: Column) -> Column:
    """(exact + half the prefix matches) / keywords, of a lowered title and its words."""
    hits = F.aggregate(
        keywords,
        F.lit(0.0),
        lambda acc, k: acc
        + F.contains(low, k).cast("double")
        + 0.5 * _prefix_related(k, words).cast("double"),
    )
    return F.when(F.size(keywords) > 0, hits / F.size(keywords))


def keyword_score(title: Column, keywords: Column) -> Column:
    """(exact + half the prefix matches) / keywords, without the keyword lists."""
    return bind(
        _match_sides(title, keywords), lambda t: shared_keywords(t.low, t.words, t["keys"])
    )


def keyword_confidence(score: Column) -> Column:
    return 0.5 + 0.3 * score


def clean_title(text: Column) -> Column:
    """Drop punctuation, one-letter words and words that end in ``w``."""
    words = split_words(F.regexp_replace(trim_blank(F.lower(text)), r"[^\w\s]", " "))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.endswith(w, F.lit("w")))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def middle_words(text: Column) -> Column:
    """The cleaned title without its first and last word; null if too little is left."""

    def middle(w: Column) -> Column:
        inner = F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), " ")
        return F.when((F.size(w) >= 3) & (F.length(inner) >= 3), inner)

    return bind(F.filter(split_words(clean_title(text)), lambda w: w != ""), middle)


def low_title(title: Column) -> Column:
    """The lowered title that tiers are tested on; null for a missing or empty one."""
    return F.lower(non_empty(title))


def tier_of(search: Column, low: Column) -> Column:
    """Tier of a lowered, trimmed search text and a lowered title."""
    return (
        F.when(trim_blank(low) == search, 1)
        .when(F.contains(low, search), 2)
        .when(F.contains(search, low), 3)
    )


def match_tier(search: Column, title: Column) -> Column:
    """1 equal, 2 title contains search, 3 search contains title, else null."""
    texts = F.struct(
        trim_blank(low_title(search)).alias("search"), low_title(title).alias("title")
    )
    return bind(texts, lambda t: tier_of(t.search, t.title))


def text_context(text: Column, part: Column, reach: int = 30) -> Column:
    """Lowered text from ``reach`` characters before to after the first ``part``.

    A part that does not occur counts as standing one place before the text.
    """
    def cut(s: Column) -> Column:
        begin = F.greatest(F.lit(0), s - reach)
        end = s + F.length(part) + reach
        return F.lower(F.substr(text, begin + 1, F.greatest(end - begin, F.lit(0))))

    return bind(F.position(part, text) - 1, cut)
