"""Hand-worked cases of the expression layer."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cueglass.functions import screen, text, timefmt


def value(spark, column, **row):
    """Evaluate a Column over one row of named string/number values."""
    names = list(row)
    schema = ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}"
        for k, v in row.items()
    )
    return spark.createDataFrame([tuple(row[n] for n in names)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("Hidden Brain", "hidden brain!", 1.0),
        ("Hidden", "Hidden Brain", 0.9),
        ("Hidd Brain", "Hidden Brain", 0.95),
        ("Sci Talks", "Science Talking", 0.3),
        ("a b a", "a c a", 4 / 3),
        ("日本", "Hidden Brain", 0.8),
        ("abc", "xyz", 0.0),
        (None, "x", 0.0),
        ("", "x", 0.0),
    ],
)
def test_title_similarity(spark, a, b, expected):
    got = value(spark, text.title_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert got == pytest.approx(expected)


@pytest.mark.parametrize(
    "a,b,expected",
    [("Kitten", "sitting!", 1 - 3 / 7), ("A.B", "ab", 1.0), ("", "x", 0.0), ("!", "?", 1.0)],
)
def test_text_similarity(spark, a, b, expected):
    got = value(spark, text.text_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert got == pytest.approx(expected)


@pytest.mark.parametrize(
    "raw,cleaned,middle",
    [
        ("E Another Podcast", "another podcast", None),
        ("The Daily Show Live", "the daily live", "daily"),
        ("", "", None),
        ("one  (two) three four", "one two three four", "two three"),
    ],
)
def test_clean_and_middle(spark, raw, cleaned, middle):
    assert value(spark, text.clean_title(F.col("t")), t=raw) == cleaned
    assert value(spark, text.middle_words(F.col("t")), t=raw) == middle


def test_ranked_keywords(spark):
    raw = "Brain brain, the hidden persuaders of memory - and memory at x y to ab"
    got = value(spark, text.ranked_keywords(F.col("t")), t=raw)
    assert got == ["persuaders", "hidden", "ab", "memory", "memory", "brain", "brain"]
    many = [f"word{c}" for c in "abcdefghijkl"]
    assert value(spark, text.ranked_keywords(F.col("t")), t=" ".join(many)) == many[:8]
    assert value(spark, text.ranked_keywords(F.col("t")), t="the of") == []


def test_plain_keywords_keep_order_and_repeats(spark):
    got = value(spark, text.plain_keywords(F.col("t")), t="The war-time Diary, diary is on")
    assert got == ["war", "time", "diary", "diary"]


def test_keyword_match(spark):
    m = value(
        spark,
        text.keyword_match(F.col("t"), F.split(F.col("k"), ",")),
        t="Hidden Brains daily",
        k="hidden,brainstorm,dai,zebra",
    )
    assert (list(m.exact), list(m.part)) == (
        ["hidden", "dai"],
        ["hidden", "brainstorm", "dai"],
    )
    assert list(m.matched) == ["hidden", "dai", "brainstorm"]
    assert m.score == pytest.approx((2 + 1.5) / 4)
    score = value(
        spark,
        text.keyword_score(F.col("t"), F.split(F.col("k"), ",")),
        t="Hidden Brains daily",
        k="hidden,brainstorm,dai,zebra",
    )
    assert score == pytest.approx(0.875)


@pytest.mark.parametrize(
    "search,title,tier",
    [
        (" Pilot", "pilot ", 1),
        ("pilot", "The Pilot Show", 2),
        ("the pilot show", "Pilot", 3),
        ("x", "y", None),
        ("", "y", None),
    ],
)
def test_match_tier(spark, search, title, tier):
    assert value(spark, text.match_tier(F.col("s"), F.col("t")), s=search, t=title) == tier


def test_text_context(spark):
    body = "a" * 50 + "10:30" + "B" * 50
    got = value(spark, text.text_context(F.col("t"), F.lit("10:30")), t=body)
    assert got == "a" * 30 + "10:30" + "b" * 30
    assert value(spark, text.text_context(F.col("t"), F.lit("9:99")), t="Short text") == "short text"


@pytest.mark.parametrize(
    "line,valid",
    [
        ("You 2.0 : The Passion Pill", True),
        ("episode 12", False),
        ("11:03", False),
        ("battery 80% left", False),
        ("loading.....", False),
        ("Hidden Brain", True),
        ("Modo sueño activado", False),
        ("12/04/2024 release", False),
        ("3 de octubre proximamente", False),
        ("--------", False),
    ],
)
def test_candidate_valid(spark, line, valid):
    words = F.size(F.split(F.col("t"), " "))
    assert value(spark, screen.candidate_valid(F.col("t"), words, F.lit(3000.0)), t=line) is valid


def test_candidate_valid_needs_area(spark):
    column = screen.candidate_valid(F.col("t"), F.lit(2), F.lit(2400.0))
    assert value(spark, column, t="Hidden Brain") is False


@pytest.mark.parametrize(
    "line,cut",
    [
        ("The long title o", True),
        ("Short AB", False),
        ("lower start", True),
        ("The End is near", False),
        ("And then the", True),
        ("What… now we know", True),
        ("Hidden Brain", False),
    ],
)
def test_truncated(spark, line, cut):
    assert value(spark, screen.truncated(F.col("t")), t=line) is cut


@pytest.mark.parametrize(
    "line,area,words,score",
    [
        ("Hidden Brain", 3000.0, 2, 3 + 1 + 1 + 1.5),
        ("BIG PICTURE SCIENCE", 9000.0, 3, 5 + 2 + 2 + 1),
        ("Why do we sleep?", 1000.0, 4, 1 + 2 + 2 + 1 + 1 + 1.5 + 1),
        ("recorded 5 min ago", 100.0, 4, max(0.0, (0.1 + 2 + 2) * 0.7 - 4)),
    ],
)
def test_candidate_score(spark, line, area, words, score):
    column = screen.candidate_score(F.col("t"), F.col("w"), F.col("a"))
    assert value(spark, column, t=line, w=words, a=area) == pytest.approx(score)


@pytest.mark.parametrize(
    "raw,seconds", [("10:30", 630), ("1:25:30", 5130), ("15", 0), (None, 0), ("x:1", 0)]
)
def test_parse_timestamp(spark, raw, seconds):
    assert value(spark, timefmt.parse_timestamp(F.col("t")), t=raw) == seconds


@pytest.mark.parametrize("seconds,shown", [(65, "1:05"), (4500, "75:00"), (0, "0:00")])
def test_format_timestamp(spark, seconds, shown):
    assert value(spark, timefmt.format_timestamp(F.col("s")), s=seconds) == shown


def test_clip_window(spark):
    got = value(spark, timefmt.clip_window(F.col("t"), F.lit(30), F.lit(15)), t="0:10")
    assert (got.start_ms, got.end_ms, got.duration_ms) == (0, 25000, 25000)


@pytest.mark.parametrize("raw,snapped", [(37, 30), (75, 60), (-100, -90), (0, 0), (500, 120)])
def test_snap(spark, raw, snapped):
    assert value(spark, timefmt.snap_increment(F.col("s")), s=raw) == snapped


def test_timeframe(spark):
    column = timefmt.timeframe(F.col("t"), F.col("a"), F.col("b"), F.lit("stored"))
    assert value(spark, column, t="0:10", a=-30, b=15) == "0:00-0:25"
    assert value(spark, column, t="", a=-30, b=15) == "stored"


@pytest.mark.parametrize(
    "podcast,episode,start,link",
    [
        (7, 9, 61500, "id7?i=9&t=61"),
        (7, 9, None, "id7?i=9"),
        (7, None, 5, "id7"),
        (None, 9, 5, ""),
    ],
)
def test_deep_link(spark, podcast, episode, start, link):
    df = spark.createDataFrame([(podcast, episode, start)], "p bigint, e bigint, s bigint")
    got = df.select(timefmt.deep_link(F.col("p"), F.col("e"), F.col("s"))).first()[0]
    assert got == (link and "https://podcasts.apple.com/podcast/" + link)


def test_scores_of_lines_need_few_scans(spark):
    """Listed words are found in one scan; ends are tested at the end. Results are the plain ones."""
    rng = random.Random(3)
    parts = ["the", "The", "thee", "ep", "episode", "a_the", "ago", "AGO", "é", "of", "I", "x1", "abc", "\u00a0", "?", ".", "_"]
    lines = ["".join(rng.choice(parts) + rng.choice([" ", "", "  ", "\t", "\n", "-"]) for _ in range(rng.randrange(9))) for _ in range(400)]
    lines += ["", " ", "\x0b the \x0c", "word ab", "some word ab", "some words abc", "a" * 30, "long enough é ab", "12", None]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    score = screen.candidate_score(F.col("t"), F.lit(1), F.lit(0.0))
    assert "split(" not in df.select(score)._jdf.queryExecution().executedPlan().toString()
    got = df.select("t", text.trim_blank(F.col("t")).alias("trimmed"), screen.truncated(F.col("t")).alias("cut"), score.alias("score"))
    for r in got.collect():
        if r.t is None:
            assert (r.trimmed, r.cut) == (None, None)
            continue
        assert r.trimmed == re.sub(r"^\s+|\s+\Z", "", r.t, flags=re.ASCII)
        assert r.cut == bool("..." in r.t or "a" <= r.t[:1] <= "z" or (len(r.t) > 10 and re.search(r"(?<!\w)\w{1,2}\Z", r.t, re.ASCII))
                             or re.search(r"\w\s+[a-z]{1,3}\Z", r.t, re.ASCII))
        words, shown, n = set(re.split(r"\W+", r.t.lower(), flags=re.ASCII)), r.trimmed, len(r.t.lower())
        want = (2.0 if 15 <= n <= 50 else 1.0 if 10 <= n <= 60 else 0.0) + sum(bool(words & set(x)) for x in screen.TITLE_WORDS)
        want += bool(re.search(r"\?\s*\Z", r.t, re.ASCII)) + ("?" in shown)
        want += 1.5 * bool("A" <= shown[:1] <= "Z" and re.search("[A-Z][a-z]", shown))
        cut = bool("..." in shown or "a" <= shown[:1] <= "z" or (len(shown) > 10 and re.search(r"(?<!\w)\w{1,2}\Z", shown, re.ASCII))
                                      or re.search(r"\w\s+[a-z]{1,3}\Z", shown, re.ASCII))
        want = want * (0.7 if cut else 1.0) - 2.0 * bool(words & set(screen.PAST_WORDS)) - 2.0 * bool(re.search(r"^\d+\Z", r.t.lower(), re.ASCII))
        assert r.score == pytest.approx(max(0.0, want)), r.t
