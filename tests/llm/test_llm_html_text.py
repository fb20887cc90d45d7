"""Main text of pages with known articles."""

import random
import time

import pytest

from cueglass.llm.html_text import extract_text, main_text

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; Example &middot; all rights reserved, and some more words to read</footer>"
LONG = "A long paragraph of the article that has many words and hardly any tags at all."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text & more", "just text & more"),
        (MENU + FOOT, ""),
        (f"<body>{MENU}<article><h1>T</h1><p>a  b\n c</p><p>d</p></article>{FOOT}</body>", "T a b c d"),
        ("<article><p><b>one<br>two<p>t<i>h</i>ree</article>", "one two three"),
        ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;d &quot;</p></article>", 'a & b <c> é d "'),
        ("<article>x<script>var a='</p>';</script><style>p{}</style>y</article>", "xy"),
        ("<article><p>x</p><aside>s</aside><form><p>f</p></form><!-- c --><p>y</p></article>", "x y"),
        ('<article><p>x</p><div class="comments"><p>nice</p></div><div id="cookie-notice">c</div></article>', "x"),
        ('<main><div class="post-body"><p>x</p></div><div class="adBanner">a</div></main>', "x"),
        (f'<article class="with-sidebar"><p>{LONG}</p></article><article><p>teaser</p></article>', LONG),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</p><p cla", "cut off"),
        ("<article><p>cut off</p><!-- never closed <p>x", "cut off"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article><header><p>by</p></header><p>x</p></article>", "x"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article><p hidden>h</p><p>x</p></article></article></p>", "x"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_region_without_article_element():
    page = f'<body><div id="top">{MENU}</div><div><div class="text"><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><a>x</a> <a>y</a></div></div>{FOOT}</body>'
    assert main_text(page) == f"{LONG} Short. {LONG}"


def test_very_long_page():
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")) == 20_000 * (len(LONG) + 1) - 1
    assert main_text("<article>" + "<b>" * 20_000 + "x") == "x"


def test_table(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "<article>é</article>"), (1, "u", "<article>é</article>"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], schema + ", n_chars int")
    assert sorted(map(tuple, extract_text(docs).collect()), key=str) == sorted(
        [(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)], key=str
    )
    assert extract_text(spark.createDataFrame([], schema)).collect() == []


LEAD = "A lead of some words that opens the article and stands in a block of its own."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (
            f"<body><div class=post><h1>T</h1><div class=lead><p>{LEAD}</p></div>"
            f"<div class=text>{f'<p>{LONG}</p>' * 4}</div></div>{FOOT}</body>",
            " ".join(["T", LEAD, *[LONG] * 4]),
        ),
        (f"<div><h1>T</h1><blockquote><p>{LONG}</p><p>{LONG}</p></blockquote><p>End.</p></div>", f"T {LONG} {LONG} End."),
        (f"<div><p>Lead.</p><div>{LONG}</div><p>End.</p></div>", f"Lead. {LONG} End."),
        (f"<div><p>Lead.</p><ul><li>{LONG}</li><li>{LONG}</li></ul></div>", f"Lead. {LONG} {LONG}"),
        (f"<div><p>Lead.</p><table><tr><td>{LONG}</td></tr></table><pre>End.</pre></div>", f"Lead. {LONG} End."),
        (f"<article><p>{LONG}</p></article><article><p>{LEAD}</p></article>{FOOT}", f"{LONG} {LEAD}"),
    ],
)
def test_articles_split_over_blocks(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "wrapper",
    [
        'div class="has-sidebar"', 'div class="no-sidebar"', 'div class="with-navigation"',
        'div class="elementor-widget-container"', 'form id="aspnetForm"', 'div class="sidebar-container"',
    ],
)
@pytest.mark.parametrize("inner", ["article", "div"])
def test_marked_wrappers(wrapper, inner):
    end = wrapper.split()[0]
    body = f'<{inner}><h1>T</h1><p>{LONG}</p><p>d</p></{inner}><div class="comments"><p>{LEAD}</p></div>'
    page = f"<body>{MENU}<{wrapper}>{body}</{end}>{FOOT}</body>"
    assert main_text(page) == f"T {LONG} d"
    page = f"<article><{wrapper}><h1>T</h1><p>{LONG}</p><p>d</p></{end}></article>{FOOT}"
    assert main_text(page) == f"T {LONG} d"


def test_asides_stay_out():
    aside = f'<div class="sidebar"><p>{LEAD}</p></div>'
    assert main_text(f"<article><p>{LONG}</p></article>{aside}") == LONG
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div>{aside}") == f"{LONG} {LONG}"
    assert main_text(f'<div><p>{LONG}</p></div><div class="comments"><article>{LEAD}</article></div>') == LONG


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>x</p><![ x</article>", "x"),
        ("<article>a<![]>b<![ endif]>c<![1]>d<![foo[x]]>e<!doctype>f</article>", "abcdef"),
        ("<article>a<![foo", "a"),
        ("<article>a<?php echo 1 ?>b</ >c</>d", "abcd"),
        ("<script><!-- var x=1;</script><article>yes</article>", "yes"),
        ("<article>x<script>no <p>end", "x"),
        ("<article><p>x<!-->y<!--->z<!-- --!> q --> w</p>", "xyz w"),
        ('<article><p>so <span class="warning">very</span> <em class="notice">much</em></p></article>', "so very much"),
        ('<article><p><a class="related-link">a</a> <label>b</label> <math>c</math></p></article>', "a b c"),
        ('<article><div class="ad">a</div><p title="1>0" x=\'"\'>b</p><a<b>c</a<b></article>', "b c"),
    ],
)
def test_malformed_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "html",
    ["<a " * 40_000, '<a x="' * 40_000, "<!--" * 100_000, "<" * 200_000, "</" * 100_000, "<script>" * 50_000,
     "<b>" * 20_000 + "</i>" * 20_000, "<p class='" + "a " * 100_000 + "'>x", '<div class="ad">' * 10_000, "<svg>" * 9_000 + "<p>x" * 9_000],
    ids=range(10),
)
def test_no_page_takes_long(html):
    began = time.monotonic()
    main_text(html)
    assert time.monotonic() - began < 5


@pytest.mark.parametrize("seed", range(4))
def test_any_soup_is_read(seed):
    rng = random.Random(seed)
    parts = ["<", ">", "</", "<!", "<!--", "-->", "<![", '"', "'", "=", "p", "div", " ", "a", "article", "script", "/", "&", "&amp;", "]"]
    main_text("".join(rng.choice(parts) for _ in range(200_000)))
    main_text("".join(chr(rng.randrange(1, 256)) for _ in range(1_000_000)))
