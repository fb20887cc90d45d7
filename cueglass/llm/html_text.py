"""Main text of web pages from the text-to-tag ratio of their lines.

The standard-library parser streams its events into *lines*, runs of text between block
boundaries, and a tree of elements. A line's ratio is its characters over the tags
inside it. The ratios are smoothed with a Gaussian along the page and split into two
clusters by a threshold; lines in the upper cluster vote, with their length, for the
content region. The region is every article (or main) element with votes, or else the
innermost container that holds all of them, lines of links only aside, and the page's
h1. It gives all of its lines,
short ones too, except those in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, known by element, role, class or id. A form or marked element
around the article itself is no such part: the page is read again without that mark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Standard deviation, in lines, of the Gaussian, and its weights.
SIGMA = 1.5
_KERNEL = np.exp(-0.5 * (np.arange(-4, 5) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
#: Part of the upper cluster's text that a marked element must hold to be no aside.
MOST = 0.7

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre search section select summary table tbody td template "
    "tfoot th thead title tr ul".split()
)
#: Elements that never hold article text.
_DROPPED = frozenset(
    "head title nav header footer aside menu form button select option textarea input "
    "script style noscript template iframe object canvas svg dialog search".split()
)
#: The same, unless they stand in a sentence.
_DROPPED_ALONE = frozenset(["label", "math"])
#: Blocks whose inline elements are parts of sentences: no mark makes an aside of those.
_SENTENCES = frozenset(
    "p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary address".split()
)
#: Words in class, id or role that mark what surrounds an article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar "
    "footer sidebar aside complementary contentinfo widget related recommended recommendations share "
    "sharing social comment comments commentlist discussion disqus reply replies respond responses "
    "cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe "
    "subscription signup login search form pagination pager toolbar skip".split()
)
#: Marks of what others wrote: such an element is no article as long as there is other text.
_OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "promoted related recommended recommendations comment comments commentlist discussion disqus reply "
    "replies respond responses cookie cookies consent gdpr notice notices popup modal newsletter".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that say which parts surround an element or that it has none.
_LAYOUT = re.compile(r"(?:has|no|not|with|without)[-_]", re.IGNORECASE)
#: Elements that may be the region of a page without article or main element.
_CONTAINERS = frozenset(["", "html", "body", "div", "center", "form"])
#: Elements whose end tag may be missing, with those that keep an open one open.
_CLOSED_BY_NEXT = {
    "p": (frozenset(["p"]), _BLOCK - {"p"} - {"br", "hr"}),
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset("table tr".split())),
    "th": (frozenset(["td", "th"]), frozenset("table tr".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


def _marks(attrs: list[tuple[str, str | None]]) -> set[str]:
    """The marking words of an element's class, id and role."""
    words = set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for part in value.split():
                if not _LAYOUT.match(part):
                    own = {w.lower() for w in _WORD.findall(part)}
                    words |= own - {"widget"} if "elementor" in own else own  # its name for any block
    return words & _MARKS


def _is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


class _Lines(HTMLParser):
    """Collects lines and the elements they stand in.

    Marked elements and forms are numbered; those in ``spared`` are not dropped.
    """

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared = spared
        self.asides: list[tuple[int, bool, bool]] = []  # the aside around it, words of others, in an article
        self.holders: set[int] = set()  # asides with an article or main element
        self.aside, self.lost = -1, False  # innermost aside; in what never holds article text
        self.link, self.plain = False, False  # in a link; the line has text outside of links
        self.block = ""  # the innermost open block
        self.names_open: Counter[str] = Counter()  # how often each element is open
        # name, element, dropped, aside, lost, link, block
        self.open: list[tuple[str, int, bool, int, bool, bool, str]] = []
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.element, self.dropped = 0, False
        self.words: list[str] = []
        self.dropped_words: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, element, dropped
        self.prose: list[bool] = []  # lines with text outside of links
        self.within: list[int] = []  # aside of each line, -1 for none, -2 in what is always dropped

    def _end_line(self) -> None:
        for dropped, words in ((False, self.words), (True, self.dropped_words)):
            if words:
                if text := " ".join("".join(words).split()):
                    self.lines.append((text, self.tags, self.element, dropped))
                    self.prose.append(self.plain)
                    self.within.append((-2 if self.lost else self.aside) if dropped else -1)
                words.clear()
        self.tags, self.plain = 0, False

    def _pop_to(self, depth: int) -> None:
        self.names_open.subtract(x[0] for x in self.open[depth:])
        del self.open[depth:]
        last = self.open[-1] if self.open else ("", 0, False, -1, False, False, "")
        _, self.element, self.dropped, self.aside, self.lost, self.link, self.block = last

    def _in_sentence(self) -> bool:
        """Whether the line has words already, or the innermost open block holds sentences."""
        if any(not w.isspace() for w in self.words):
            return True
        return self.block in _SENTENCES

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if tag in _VOID:
            return
        if tag in _CLOSED_BY_NEXT:
            ends, stops = _CLOSED_BY_NEXT[tag]
            any_open = any(self.names_open[x] for x in ends)
            for depth in range(len(self.open) - 1, -1, -1) if any_open else ():
                if self.open[depth][0] in stops:
                    break
                if self.open[depth][0] in ends:
                    self._pop_to(depth)
                    break
        if tag in ("article", "main") and self.dropped and not self.lost:
            self.holders.add(self.aside)
        named = attrs and tag not in ("html", "body", "article", "main")
        in_sentence = tag not in _BLOCK and self._in_sentence()
        never = (tag in _DROPPED and tag != "form") or (tag in _DROPPED_ALONE and not in_sentence)
        self.lost = self.lost or never or bool(named and _is_hidden(attrs))
        dropped = self.dropped or self.lost
        if not self.lost and (marks := _marks(attrs) if named and not in_sentence else set()) | ({tag} & {"form"}):
            held = bool(self.names_open["article"] or self.names_open["main"])
            self.asides.append((self.aside, bool(marks & _OTHERS), held))
            number = len(self.asides) - 1
            if number not in self.spared:
                self.aside, dropped = number, True
        if tag in _BLOCK and not dropped:
            self.parents.append(self.element)
            self.names.append(tag)
            self.element = len(self.parents) - 1
        self.dropped = dropped
        self.link = self.link or tag == "a"
        self.block = tag if tag in _BLOCK else self.block
        self.names_open[tag] += 1
        self.open.append((tag, self.element, dropped, self.aside, self.lost, self.link, self.block))

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        for depth in range(len(self.open) - 1, -1, -1) if self.names_open[tag] else ():
            if self.open[depth][0] == tag:
                self._pop_to(depth)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # Outside of void elements HTML knows no self-closing tags.
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem is None:  # neither script nor style
            (self.dropped_words if self.dropped else self.words).append(data)
            self.plain = self.plain or not (self.link or self.dropped or data.isspace())


def _threshold(values: np.ndarray) -> float:
    """Midpoint between the means of two clusters of values, by iteration."""
    bound = float(values.mean())
    for _ in range(32):
        upper = values >= bound
        if upper.all() or not upper.any():
            break
        middle = float(values[upper].mean() + values[~upper].mean()) / 2
        if middle == bound:
            break
        bound = middle
    return bound


#: One tag that a ``>`` ends outside of quoted values; possessive, so it never goes back.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>"""
)
_ATTRIBUTE = re.compile(
    r"""([^\s/>="']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']*+)))?"""
)
_PLAIN_NAME = re.compile(r"[a-z][a-z0-9:_-]*")
#: Attributes that say what an element is for.
_READ = ("class", "id", "role", "hidden", "aria-hidden")
#: Elements whose content is no markup.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style")}


def _plain_tag(end: str, name: str, attributes: str) -> str:
    name = name.lower()
    if not _PLAIN_NAME.fullmatch(name):
        name = "x-unknown"
    if end:
        return f"</{name}>"
    kept: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        if (key := m[1].lower()) in _READ and key not in kept:
            kept[key] = next((v for v in m.groups()[1:] if v is not None), "")
    return f"<{name}{''.join(f' {k}="{escape(unescaped)}"' for k, unescaped in kept.items())}>"


def _plain_markup(html: str) -> str:
    """The page in markup that has one reading: comments, declarations and scripts are gone,
    tags have only the attributes in ``_READ``, and other ``<`` are written ``&lt;``.

    A tag, comment or script that the page's end cuts off goes with all that follows its
    beginning. One way through the page: what has been looked at is not looked at again.
    """
    out, done = [], 0
    while (at := html.find("<", done)) >= 0:
        out.append(html[done:at])
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            # ``<!-->`` and ``<!--->`` are whole comments.
            end = at + 4 if html.startswith(">", at + 4) else at + 5 if html.startswith("->", at + 4) else -1
            if end < 0:
                end = html.find("-->", at + 4)
                end = end + 2 if end >= 0 else -1
        elif after in ("!", "?") or (after == "/" and not html[at + 2 : at + 3].isalpha() and html[at + 2 : at + 3]):
            end = html.find(">", at)
        elif after == "" or (after == "/" and at + 2 == len(html)):
            end = -1
        elif not (m := _TAG.match(html, at)):
            if after.isascii() and after.isalpha() or after == "/":
                end = -1
            else:
                out.append("&lt;")
                end = at
        else:
            end = m.end() - 1
            out.append(_plain_tag(*m.groups()))
            name = m[2].lower()
            if not m[1] and name in _RAW_END:
                close = _RAW_END[name].search(html, m.end())
                if not close:
                    return "".join(out)
                end = close.start() - 1
        if end < 0:
            return "".join(out)
        done = end + 1
    return "".join(out) + html[done:]


def _read(html: str, spared: frozenset[int] = frozenset()) -> tuple[_Lines, np.ndarray]:
    """The lines of a page and which of them are in the upper cluster."""
    page = _Lines(spared)
    page.feed(html)
    page.close()
    page._end_line()
    if not page.lines:
        return page, np.empty(0, bool)
    ratio = np.array([len(text) / max(1, tags) for text, tags, _, _ in page.lines])
    half = len(_KERNEL) // 2
    padded = np.pad(ratio, half, mode="edge")
    smooth = np.convolve(padded, _KERNEL, mode="valid")
    return page, smooth >= _threshold(smooth)


def _no_asides(page: _Lines, upper: np.ndarray) -> frozenset[int]:
    """Marked elements and forms that hold the article, from the outermost on."""
    held, own = np.zeros(len(page.asides)), np.zeros(len(page.asides))
    free = outside = 0
    for (text, *_), high, aside in zip(page.lines, upper, page.within, strict=True):
        if aside == -1:
            free += len(text) * high
            outside += len(text)
        elif aside >= 0:
            held[aside] += len(text) * high
            own[aside] += len(text)
    holders, whole = set(page.holders), own.copy()
    for aside in range(len(held) - 1, -1, -1):  # inner ones come after outer ones
        if (around := page.asides[aside][0]) >= 0:
            held[around] += held[aside]
            whole[around] += whole[aside]
            if aside in holders:
                holders.add(around)
    total = free + sum(held[a] for a, (around, *_) in enumerate(page.asides) if around < 0)
    named = any(name in ("article", "main") for name in page.names)
    spared = set()
    for aside, (around, others, within) in enumerate(page.asides):
        if (around >= 0 and around not in spared) or not whole[aside] or (others and outside):
            continue
        most = 0 < MOST * total <= held[aside]
        if named and not within:
            fits = aside in holders and most
        else:
            fits = most or aside in holders or not outside
        if fits:
            spared.add(aside)
            outside += own[aside]
    return frozenset(spared)


def main_text(html: str | None) -> str:
    """Blocks of the content region in page order, joined by one space."""
    html = _plain_markup(html or "")
    page, upper = _read(html)
    spared = _no_asides(page, upper) if page.asides and page.lines else None
    if spared:
        page, upper = _read(html, spared)
    if not page.lines:
        return ""
    votes = np.zeros(len(page.parents))
    live = np.zeros(len(page.parents))
    for (text, _, element, dropped), high in zip(page.lines, upper, strict=True):
        if not dropped:
            live[element] += len(text)
            votes[element] += len(text) if high else 0
    if not live.any():
        return ""
    if not votes.any():
        votes = live
    for element in range(len(votes) - 1, 0, -1):  # children come after their parents
        votes[page.parents[element]] += votes[element]
        live[page.parents[element]] += live[element]
    inside = np.zeros(len(votes), bool)
    region = 0
    for kind in ("article", "main"):
        if named := [e for e, name in enumerate(page.names) if name == kind and live[e]]:
            with_votes = [e for e in named if votes[e]]
            if spared and max(votes[e] for e in named) < MOST * votes[0] and len(with_votes) < 2:
                continue  # a teaser in what was spared, beside an article without a name
            inside[with_votes or max(named, key=lambda e: (live[e], -e))] = True
            break
    else:
        marks = np.zeros(len(votes))  # lines that the region must hold
        for (_, _, element, dropped), high, prose in zip(page.lines, upper, page.prose, strict=True):
            marks[element] += not dropped and ((high and prose) or page.names[element] == "h1")
        if not marks.any():
            marks[0] = 1
        for element in range(len(votes) - 1, 0, -1):
            marks[page.parents[element]] += marks[element]
        own = {element for text, _, element, dropped in page.lines if not dropped}
        for element in range(1, len(votes)):
            if page.parents[element] == region and marks[element] == marks[0]:
                region = element
        # A paragraph, list or the like is a part of an article, not its container.
        while region and (region in own or page.names[region] not in _CONTAINERS):
            region = page.parents[region]
        inside[region] = True
    for element in range(1, len(votes)):
        inside[element] |= inside[page.parents[element]]
    return " ".join(text for text, _, element, dropped in page.lines if inside[element] and not dropped)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the article's text and its code points.

    The whole page is read, whatever its length; null and empty pages give an empty
    text, as do pages without article text. Repeated rows stay repeated; other columns
    are ignored; an empty table gives an empty one. No rows are moved.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
