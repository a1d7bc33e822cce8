"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block-level run of text. Lines inside menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are page furniture and left out before anything is
measured, but for a form or a marked element that turns out to hold the page; the others weigh their length.

Lengths are summed over sliding windows of WINDOW lines. The text surges at the first window that reaches SURGE
characters, or a SHARE of the fullest window if that is less, and dives after the last; it is all that lies between, with the
rest of the columns that it is in and a heading right before. Where an article or main element holds most of what lies
between, the columns are such elements, and what stands outside them is left out.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window, characters of a window at which the text surges, and the same as a share of the fullest window.
WINDOW, SURGE, SHARE = 5, 80, 0.25
#: Elements whose text never shows as page text.
HIDDEN = frozenset("script style noscript template head title textarea select option button svg iframe object canvas datalist audio video".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements that end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class, id and role names that mark furniture: as whole names, or before or after the words below.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside widget related share sharing social cookie cookies consent notice popup modal newsletter subscribe signup login comment comments disqus respond replies pagination pager toolbar masthead contentinfo complementary search".split()
)
#: After a mark and a hyphen, words that tell how a page is laid out or what state it is in: no furniture.
STATES = frozenset("open opened closed enabled disabled on off active inactive free left right layout page content main article result results".split())
#: Words that a mark may follow: site-footer, post-comments.
PLACES = frozenset("site page main global top bottom primary secondary post article entry blog".split())
#: Marks of reader comments: they mark an article element, too, and never turn out to hold the page.
COMMENTS = frozenset("comment comments disqus respond replies".split())
#: Words that may follow a mark besides other marks: parts and lists of things. With another word the name is that of a thing of its own.
PARTS = frozenset("area bar block body bottom box button card cell close col column container details entry feed footer frame group head header heading holder icon image img inline inner item items label large leaderboard link links list modal news outer panel placeholder post posts row section slot small space stories story text thread tile title top toggle unit units wrap wrapper zone".split())
#: Elements and marks that may turn out to hold the page: where they have so many characters, and so many times those outside.
HOLDS, TIMES = 400, 4
#: Elements that hold lines of one column.
BOXES = frozenset("div section td body main article form fieldset center li dd blockquote".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: Lines between a heading and the surge that may belong to it: by-lines, dates.
BELOW = 6
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe")}
_SPACE = re.compile(r"\s+")


@functools.lru_cache(4096)
def _marked(name: str) -> bool:
    """Whether a class, id or role name says what furniture it is; has-sidebar or no-ads does not."""
    first, *rest = [x for x in re.split("[_-]+", name) if x] or [""]
    if first in MARKS:
        return STATES.isdisjoint(rest) and all(x in PARTS or x in MARKS or x in PLACES or x.isdigit() for x in rest)
    return first in PLACES and len(rest) == 1 and rest[0] in MARKS


def _furniture(name: str, attributes: str, in_article: bool) -> str:
    """``sure`` for page furniture, ``likely`` for what is furniture unless it holds the page, else empty."""
    if name == "header" and not in_article or name in FURNITURE and name not in ("form", "fieldset"):
        return "sure"
    words = [w for m in _MARK.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split() if _marked(w)] if "=" in attributes and name not in ("body", "html") else []
    if any(not COMMENTS.isdisjoint(re.split("[_-]+", w)) for w in words):
        return "sure"
    return "likely" if name in ("form", "fieldset") or words and name not in ("main", "article") else ""


class Line(NamedTuple):
    text: str
    furniture: bool
    #: Elements around it that are furniture unless they hold the page, outermost first.
    likely: tuple[int, ...]
    #: The outermost article or main element, or 0.
    article: int
    #: The nearest element of BOXES.
    box: int
    heading: bool


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order, empty ones left out."""
    out: list[Line] = []
    parts: list[str] = []
    start_state = (False, False, (), 0, 0, False)  # hidden, then as in a line; each with what it inherits
    stack: list[tuple[str, tuple]] = []
    state = start_state
    elements = at = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Line(text, *state[1:]))

    while at < len(page):
        start = page.find("<", at)
        m = _TOKEN.match(page, start) if start >= 0 else None
        if start < 0:
            start = len(page)
        if start > at and not state[0]:
            parts.append(page[at:start])
        if m is None:
            if start < len(page) and not state[0]:
                parts.append("<")
            at = start + 1
            continue
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS or name in HIDDEN:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    state = stack[-1][1] if stack else start_state
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("body", "html", "article", "main"):
                    break  # a stray end tag closes nothing outside its section
            continue
        if name in VOID or attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            state = stack[-1][1] if stack else start_state
        if name == "body":
            stack.clear()
            state = start_state
        hidden, furniture, likely, article, box, heading = state
        elements += 1
        kind = _furniture(name, attributes, article > 0)
        if not article and name in ("article", "main"):
            article = elements
        state = (hidden or name in HIDDEN, furniture or kind == "sure", (*likely, elements) if kind == "likely" else likely, article, elements if name in BOXES else box, heading or name in _HEADINGS)
        stack.append((name, state))
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def surge_and_dive(lengths: list[int]) -> tuple[int, int]:
    """The lines between surge and dive: the first of the first full window, and one past the last of the last."""
    upto = list(itertools.accumulate(lengths, initial=0))
    last = max(1, len(lengths) - WINDOW + 1)
    sums = [upto[min(i + WINDOW, len(lengths))] - upto[i] for i in range(last)]
    least = min(SURGE, SHARE * max(sums))
    full = [i for i, n in enumerate(sums) if n >= least]
    return full[0], min(full[-1] + WINDOW, len(lengths))


def shown(lines: list[Line]) -> list[Line]:
    """Lines that are no furniture. A form or a mark around the text of the page is none: one with most of all text, or with an article in it that has."""
    lines = [x for x in lines if not x.furniture]
    while any(x.likely for x in lines):
        free = sum(len(x.text) for x in lines if not x.likely)
        inside: dict[int, list[int]] = {}
        for x in lines:
            if x.likely:
                n = inside.setdefault(x.likely[0], [0, 0])
                n[0] += len(x.text)
                n[1] += len(x.text) if x.article else 0
        heaviest = max(inside, key=lambda e: inside[e][0])
        n, of_article = inside[heaviest]
        if n < TIMES * free or n < HOLDS and 2 * of_article < n:
            return [x for x in lines if not x.likely]
        lines = [x._replace(likely=x.likely[1:]) if x.likely and x.likely[0] == heaviest else x for x in lines]
    return lines


def main_text(page: str | None) -> str:
    """The main text: lines joined by one newline; empty for null, empty or textless pages."""
    lines = shown(lines_of(page or ""))
    if not lines:
        return ""
    surge, dive = surge_and_dive([len(x.text) for x in lines])
    # short first and last lines of the columns that hold the text are text: of its articles, or of the heaviest other one
    weight: dict[tuple[int, int], int] = {}
    for x in lines[surge:dive]:
        column = (x.article, 0 if x.article else x.box)
        weight[column] = weight.get(column, 0) + len(x.text)
    heaviest = max(weight, key=lambda c: weight[c])
    if heaviest[0]:
        articles = {c[0] for c in weight}
        return "\n".join(x.text for x in lines if x.article and x.article in articles)
    of_column = [i for i, x in enumerate(lines) if not x.article and x.box == heaviest[1]]
    surge, dive = min(surge, of_column[0]), max(dive, of_column[-1] + 1)
    heads = [i for i in range(max(0, surge - BELOW - 1), surge) if lines[i].heading]
    return "\n".join(x.text for x in lines[heads[0] if heads else surge : dive])


def extracted(page: Column) -> Column:
    """The main text of an HTML column."""

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return text_of(page)


def extract_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Null or empty html gives an empty text; other columns are left out; rows keep their nulls and repeats."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
