"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events.  They fill lines: a block element begins and ends one, and closes
what HTML lets stay open before it (paragraphs, items, cells), so each line knows its text, its tags, the container
it stands in, and whether an element or a name around it says that it isn't the article (menus, adverts, comments
and so on).  Names don't count where without their containers no article would be left.  A line's text-to-tag ratio is its characters for each
tag; ratios are smoothed by a Gaussian along the page, and lines over the threshold (a share of the standard
deviation) form clusters.  The clusters choose between the outermost containers that can hold an article and the
page itself, by the clustered text inside and outside of these containers.  From what is chosen every line stays,
however short, but for lines in containers that are named as something else, and for what is mostly links and
that no cluster reaches: whole containers, or lines of the page.

No shuffle: pages are mapped where they are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset(
    "head title script style template noscript iframe object svg canvas math nav footer aside form button select "
    "textarea menu dialog search datalist audio video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("head title meta link style script base noscript template".split())
#: Words of class, id and role that name what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs foot footer copyright masthead comment comments reply replies disqus respond cookie cookies "
    "consent notice notices gdpr popup modal newsletter subscribe subscription signup share sharing social related "
    "recommended toolbar pagination pager widget complementary contentinfo alert dialog search skip".split()
)
#: What the last part of a name may be if its first part is such a word.
HOLDERS = frozenset(
    "area bar block box button buttons container content form group item items link links list message panel section "
    "slot text unit widget widgets wrap wrapper".split()
)
#: Elements that the start of another closes, up to the element that holds them.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr"), ("table",)), "option": (("option",), ("select", "datalist")),
}
ARTICLE = re.compile(r"\b(article|main|content|post|entry|story|articlebody)\b")
#: Words of names that hold not an article but pointers to others.
SEVERAL = re.compile(r"\b(lists?|teasers?|cards?|previews?|feed|archive|more|latest)\b")


def named(said: str) -> bool:
    """Whether a class, id or role names what isn't the article: `ad`, `site-footer`, `comment-list`, not `with-sidebar`."""
    for name in said.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not parts or len(parts) > 1 and parts[0] in ("with", "has", "no", "without", "is"):
            continue
        if parts[-1] in NAMES or parts[0] in NAMES and parts[-1] in HOLDERS:
            return True
    return False


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    outside: bool = False  # by an element
    named: bool = False  # by a name
    region: int = 0
    linked: int = 0  # characters inside links

    text = ""


class Open(NamedTuple):
    tag: str = ""
    outside: bool = False
    named: bool = False
    region: int = 0  # the outermost region it stands in; 0: the page
    linked: bool = False
    muted: bool = False  # it stands in an element within a line that isn't part of it: a drawing, a list of choices


class Lines(HTMLParser):
    """Collects the lines of a page from the parser's events, in time linear in the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where in `open` each element stands
        self.regions = 1
        self.line = Line()

    def around(self) -> Open:
        return self.open[-1] if self.open else Open()

    def last(self, *tags: str) -> int:
        """The place of the innermost of these elements; -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def begin_line(self) -> None:
        if self.line.parts:
            self.line.text = " ".join("".join(self.line.parts).split())
            self.line.parts = []
            if self.line.text:
                self.lines.append(self.line)
                self.line = Line()
        around = self.around()
        self.line.outside, self.line.named, self.line.region = around.outside, around.named, around.region

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in HEAD and (at := self.last("head")) >= 0:
            self.close_from(at)
        block = tag in BLOCK
        if block and not self.around().muted and (at := self.last("p")) > self.last("td", "th", "button", "object"):
            self.close_from(at)
        if tag in CLOSED_BY:
            closed, within = CLOSED_BY[tag]
            bound = self.last(*within)
            if places := [self.places[t][-1] for t in closed if self.places[t] and self.places[t][-1] > bound]:
                self.close_from(min(places))
        around = self.around()
        if tag in VOID:
            if block and not around.muted:
                self.begin_line()
            self.line.tags += 1
            if tag == "br":
                self.line.parts.append(" ")
            return
        outside, name, region = around.outside or tag in OUTSIDE, around.named, around.region
        holds = tag in ("article", "main")
        if attrs and tag not in ("html", "body"):
            said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop")).lower()
            hidden = any(k == "hidden" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
            outside = outside or hidden
            name = name or named(said)
            holds = holds or block and tag not in HEADINGS and not named(said) and bool(ARTICLE.search(said)) and not SEVERAL.search(said)
        if tag == "header" and not region:
            outside = True  # that of the page; an article's own header holds its title
        if holds and not outside and not region:
            region = self.regions
            self.regions += 1
        self.places[tag].append(len(self.open))
        muted = around.muted or not block and outside and not around.outside and any(p.strip() for p in self.line.parts)
        self.open.append(Open(tag, outside, name, region, around.linked or tag == "a", muted))
        if block and not muted:
            self.begin_line()
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = self.last(tag)
        if at < 0:
            if tag == "p":
                self.begin_line()
            return
        muted = self.open[at].muted
        self.close_from(at)
        now = self.around()
        # an element within a line leaves it as it is, unless the line began in it
        if tag in BLOCK and not muted or self.line.outside and not now.outside or self.line.named and not now.named:
            self.begin_line()

    def handle_data(self, data: str) -> None:
        around = self.around()
        if around.outside and not self.line.outside or around.named and not self.line.named:
            return  # within a line that goes on after it
        self.line.parts.append(data)
        if around.linked:
            self.line.linked += len("".join(data.split()))

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Comments without an end go on to the end of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def main_text(html: str | None, share: float = 0.5) -> str:
    """The article's lines joined by \\n; empty where there are none.

    `share` of the standard deviation of the smoothed ratios is the threshold of the clustering.
    """
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.begin_line()
    every = [x for x in page.lines if not x.outside]
    lines = [x for x in every if not x.named]
    if not any(x.region for x in lines) and any(x.region for x in every):
        lines = every  # an article stands in containers with such names only
    if not lines:
        return ""
    ratios = smooth(np.array([len(x.text) / max(1, x.tags) for x in lines], float))
    clustered = ratios >= share * ratios.std()
    reached = np.zeros(page.regions)
    for x, chosen in zip(lines, clustered):
        reached[x.region] += len(x.text) if chosen else 0
    whole = reached[0] > reached[1:].sum() or not reached[1:].any()
    # what is judged at once: lines of the page, or all of a container
    units: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if whole or x.region:
            units.setdefault(i if whole else x.region, []).append(i)
    stay = []
    for unit in units.values():
        linked = sum(lines[i].linked for i in unit)
        if clustered[unit].any() or 2 * linked <= sum(len("".join(lines[i].text.split())) for i in unit):
            stay += unit
    return "\n".join(lines[i].text for i in sorted(stay))


def extract(pages: DataFrame, html: str = "html", id_column: str = "page_id", url: str = "url") -> DataFrame:
    """A row for each page: its id, url, main text (empty where there is none), n_chars (code points).

    Null and empty pages have an empty text; repeated rows and null ids or urls give a row each; other columns
    are not read.
    """

    def make():
        def row(page_id, url, html):
            text = main_text(html)
            return page_id, url, text, len(text)

        return row

    return per_row(
        pages.select(F.col(id_column).cast("long"), F.col(url).cast("string"), F.col(html)), make,
        "page_id long, url string, text string, n_chars long",
    )


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
