"""Operator 8: a page's main text by its line-block distribution.

Markup is stripped to lines, one for each block of the page in order. A line's weight is the length
of its text less what links hold, and 0 in what HTML itself calls no part of an article: navigation, page headers,
footers, asides and forms, by element or role. A form is none if it holds an article or more text than lies outside of forms, as
where it wraps the whole page. Where a class name or id is one of menus, notices, adverts, comments and the like, a line's weight is a
thirty-second (0 within an article and in comments), unless the element holds half of the page's text and a paragraph at least: then its name says nothing.

The distribution is the sum of the weights in a window that slides over
the lines, from one that only its last line has entered to one that only its first hasn't left. The edge of an element so named, and
of an article with an element beside it, is as many empty lines as the window has, so that what stands beside an article is a peak of its own (where the
heaviest peak is no article, articles have no such edges). The threshold is a share of the page's own mean over windows with any weight. Where the sum
passes it is a surge, where it falls below a dive; the lines of the windows between the two are a region.
The heaviest region is the main text. With it go the regions at least a quarter as heavy, and what
lies in the least container of all its lines (or in siblings of that of the same class) even where the
distribution is low: a text's own short ends and lists. Headings and paragraphs of links next to a kept
region belong to it. Furniture within an article stays out, and nothing else.

Defined cases: null or empty html gives an empty text; a page in which everything is
furniture is taken once more with navigation and footers as the only furniture; a page without lines gives an empty text; an empty table gives no rows; unclosed elements end with their
parents; cut character references stay as they are; rows that repeat are extracted each; very long
pages are taken whole; other columns are ignored."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuseline.llm.common import pieces

WINDOW = 3
#: The threshold of a window's sum, as a share of the page's mean; and a region's weight, as one of the heaviest's.
THRESHOLD, SIDE = 1 / 8, 1 / 4
#: What an element named like furniture divides its lines' weights by; and the share of the page's text, and the characters, with which it is none.
NAMED_BY, HALF, ENOUGH = 32, 1 / 2, 150
#: Fixed values of HTML: elements that start a new block, that have no end tag, whose text isn't shown, and that aren't the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
FURNITURE = frozenset("aside dialog menu search".split())
ROLES = frozenset("banner complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Those that are furniture in any case.
FIXED = frozenset("nav footer".split())
FIXED_ROLES = frozenset("navigation contentinfo".split())
#: Why a line may be furniture.
NAMED, MARKED, ALWAYS = 1, 2, 4
#: Elements that hold a text's parts, and those that are lines of a text even if all of them is a link.
CONTAINERS = frozenset("article aside body center details dialog div fieldset form html main search section td th".split())
PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that end where one of the given elements starts.
ENDS = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
#: Words at the start or end of class names and ids of furniture.
NAMES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond replies disqus widget toolbar pagination pager alert paywall".split())
#: Words before "header" in class names of an article's own heading.
OWN_HEADER = frozenset("article entry post content story".split())
#: Names of readers' comments, which may be longer than the text that they are about.
COMMENTS = frozenset("comment comments respond replies disqus".split())
_PART = re.compile(r"[A-Za-z]+")


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id value names furniture; inside: within an article."""
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or {"has", "with", "no"} & set(parts):
            continue
        if parts[0] in NAMES or parts[-1] in NAMES or (parts[-1] in ("header", "topbar") and not inside and parts[0] not in OWN_HEADER):
            return True
    return False


class Lines(HTMLParser):
    """feed() fills lines with [text, weight if it isn't furniture, why it may be furniture, number of
    its form or 0, number of its article or 0, number of its block, number of the outermost element named like furniture or 0],
    with_article with the forms that hold an article, and marks with (whether it is within an article, whether it names comments) of the elements so named. Blocks are numbered in the page's order; a block's descendants are those up
    to its entry in ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.linked = [], [], 0
        self.stack: list[tuple[str, bool, int, int, int, int, int]] = []  # element, unseen, why, form, article, block, mark
        self.parents, self.kinds, self.ends = [0], [("", "")], [0]  # kinds: element, class
        self.open: Counter[str] = Counter()
        self.links = self.articles = self.forms = 0
        self.with_article: set[int] = set()
        self.marks: list[tuple[bool, bool]] = [(False, False)]
        self.state = (False, 0, 0, 0, 0, 0)

    def _cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, max(0, len(text) - self.linked), *self.state[1:]))
            self.text, self.linked = [], 0

    def _pop_to(self, k: int) -> None:
        for tag, *_, block, _ in self.stack[k:]:
            self.links -= tag == "a"
            self.open[tag] -= 1
            self.ends[block] = len(self.ends) - 1
        del self.stack[k:]
        self.state = self.stack[-1][1:] if self.stack else (False, 0, 0, 0, 0, 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._cut()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 12), -1):
            open_ = self.stack[k][0]
            if tag in ENDS.get(open_, ()):
                self._pop_to(k)
                break
            if open_ in ("table", "ul", "ol", "dl", "div", "section", "article", "main", "body"):
                break
        if tag in VOID:
            return
        unseen, why, form, article, block, mark = self.state
        have = dict(attrs)
        if tag in ("article", "main") and not article:
            self.articles += 1
            article = self.articles
        unseen = unseen or tag in UNSEEN or "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in (have.get("style") or "").replace(" ", "")
        if not why & ALWAYS and tag not in ("html", "body", "main"):
            role = (have.get("role") or "").lower()
            if tag in FIXED or role in FIXED_ROLES:
                why |= ALWAYS
            elif tag in FURNITURE or (tag == "header" and not article) or role in ROLES:
                why |= MARKED
            elif not form and (tag == "form" or role == "form"):
                self.forms += 1
                form = self.forms
            if not why & NAMED and attrs and (_named(have.get("class") or "", article > 0) or _named(have.get("id") or "", article > 0)):
                if tag != "article" or (have.get("class") or "").lower().startswith("comment"):
                    why |= NAMED
                    words = {w.lower() for c in ("class", "id") for w in _PART.findall(have.get(c) or "")}
                    self.marks.append((article > 0, bool(words & COMMENTS)))
                    mark = len(self.marks) - 1
        if form and not why and tag in ("article", "main"):
            self.with_article.add(form)
        if tag in BLOCKS or tag in ("td", "th"):
            self.parents.append(block)
            self.kinds.append((tag, have.get("class") or ""))
            self.ends.append(0)
            block = len(self.ends) - 1
        self.links += tag == "a"
        self.stack.append((tag, unseen, why, form, article, block, mark))
        self.open[tag] += 1
        self.state = (unseen, why, form, article, block, mark)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._cut()
        for k in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[k][0] == tag:
                self._pop_to(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.state[0]:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._cut()
        self._pop_to(0)
        self.ends[0] = len(self.ends) - 1

    def is_page(self, block: int) -> bool:
        return self.kinds[block][0] in ("", "html", "body")

    def holder(self, block: int) -> int:
        """The container that a block is or lies in."""
        while block and self.kinds[block][0] not in CONTAINERS:
            block = self.parents[block]
        return block

    def container(self, blocks: list[int]) -> list[tuple[int, int]]:
        """(first, last) block of the least container of all the blocks, and of its siblings that are
        sections like it or of the same class."""
        at, last = self.parents[min(blocks)], max(blocks)
        while at and (self.ends[at] < last or self.kinds[at][0] not in CONTAINERS):
            at = self.parents[at]
        element, name = self.kinds[at]
        if element != "section" and not name:
            return [(at, self.ends[at])]
        return [(k, self.ends[k]) for k, (p, kind) in enumerate(zip(self.parents, self.kinds, strict=True)) if p == self.parents[at] and (kind == (element, name) or kind[0] == element == "section")]


def regions(weights: list[int], window: int = WINDOW, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines from each surge to the next dive of the window's sum, less those
    without weight at either end."""
    run = [0, *accumulate(weights)]
    sums = [run[min(len(weights), i + 1)] - run[max(0, i + 1 - window)] for i in range(len(weights) + window - 1)]
    some = [s for s in sums if s]
    least = threshold * sum(some) / len(some) if some else 0
    out, surge = [], None
    for i, s in enumerate([*sums, 0]):
        if s and s >= least and surge is None:
            surge = i
        elif not (s and s >= least) and surge is not None:
            lines = [k for k in range(max(0, surge - window + 1), min(i, len(weights))) if weights[k]]
            if out and lines[0] < out[-1][1]:  # the windows of two surges share lines
                lines[0] = out.pop()[0]
            out.append((lines[0], lines[-1] + 1))
            surge = None
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those within others left out."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _believed(parser: Lines) -> tuple[set[int], bool]:
    """The elements whose names are believed, those with less than half of the page's text and comments on other text; whether there are others."""
    mass: Counter[int] = Counter()
    other = 0
    for _, weight, why, form, _, _, mark in parser.lines:
        if not why & (MARKED | ALWAYS):
            mass[mark] += weight
            other += 0 if mark or form else weight
    total = sum(mass.values())
    out = {m for m in mass if m and (mass[m] < max(HALF * total, ENOUGH) or (parser.marks[m][1] and other > 0))}
    return out, len(out) < sum(m > 0 for m in mass)


def _candidates(parser: Lines) -> Iterator[tuple[list[bool], list[int]]]:
    """(which lines are furniture, each line's element that is named like it or 0), by ever fewer marks."""
    believed, others = _believed(parser)
    named = [mark if mark in believed else 0 for *_, mark in parser.lines]
    mass: Counter[int] = Counter()
    for (_, weight, why, form, *_), mark in zip(parser.lines, named, strict=True):
        mass[form] += 0 if mark or why & (MARKED | ALWAYS) else weight
    least = mass[0] / 4 if others else mass[0] + 1 if mass[0] else 4 * sum(line[1] for line, mark in zip(parser.lines, named, strict=True) if mark and not line[3])
    text = parser.with_article | {f for f in mass if mass[f] >= least}
    inner = [mark > 0 and any(parser.marks[mark]) for mark in named]  # within an article, or comments
    for read in (named, [0] * len(named)):
        yield [bool(why & (MARKED | ALWAYS)) or (form > 0 and form not in text) or (x and m > 0) for (_, _, why, form, *_), x, m in zip(parser.lines, inner, read, strict=True)], read
    yield [bool(why & ALWAYS) for _, _, why, *_ in parser.lines], [0] * len(named)


def _found(parser: Lines, weights: list[int], named: list[int], window: int) -> list[tuple[int, int]]:
    """regions() of the lines with the empty ones at the edges of named elements and of articles."""
    for articles in (True, False):
        wide, line_of = [], []
        for i, (line, weight) in enumerate(zip(parser.lines, weights, strict=True)):
            if i and ((articles and _edge(parser, parser.lines[i - 1], line)) or (named[i] != named[i - 1] and not line[4])):
                wide += [0] * WINDOW
                line_of += [i] * WINDOW
            wide.append(weight)
            line_of.append(i)
        found = [(line_of[a], line_of[b - 1] + 1) for a, b in regions(wide, window)]
        if not found or any(parser.lines[i][4] for i in range(*max(found, key=lambda r: sum(weights[r[0] : r[1]])))):
            break
    return found


def _edge(parser: Lines, a: tuple, b: tuple) -> bool:
    """Whether an article and an element beside it meet between two lines; a's or b's own text in what holds the article is none."""
    if (a[4] > 0) == (b[4] > 0):
        return False
    out, within = (b[5], a[5]) if a[4] else (a[5], b[5])
    holder = parser.holder(out)
    return not holder <= within <= parser.ends[holder]


def main_text(html: str | None, window: int = WINDOW) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    for furniture, named in _candidates(parser):
        weights = [0 if f else -(-line[1] // NAMED_BY) if m else line[1] for line, f, m in zip(parser.lines, furniture, named, strict=True)]
        found = _found(parser, weights, named, window)
        if found:
            break
    else:
        return ""
    texts, _, whys, _, _, blocks, _ = zip(*parser.lines, strict=True)
    mass = [sum(weights[a:b]) for a, b in found]
    top = range(*found[max(range(len(found)), key=mass.__getitem__)])
    spans = parser.container([blocks[i] for i in top if weights[i]])
    page = parser.is_page(spans[0][0])
    own = {parser.holder(blocks[i]) for i in top if weights[i]}
    spans = merged([*(() if page else spans), *((k, parser.ends[k]) for k in own if not parser.is_page(k))])
    firsts = [first for first, _ in spans]

    def inside(i: int) -> bool:
        k = bisect_right(firsts, blocks[i]) - 1
        return k >= 0 and blocks[i] <= spans[k][1]

    text = [(a, b) for (a, b), m in zip(found, mass, strict=True) if m >= SIDE * max(mass) or any(weights[i] and not named[i] and inside(i) for i in range(a, b))]
    kept = {i for a, b in text for i in range(a, b)}
    kept |= {i for i in range(len(texts)) if weights[i] and not named[i] and inside(i)}
    kept |= {i for i in range(min(kept), max(kept)) if not named[i] and (page or inside(i))}
    for a, b in text:
        for i, step in ((a - 1, -1), (b, 1)):
            between = 0
            while 0 <= i < len(texts) and between < window and i not in kept and not whys[i] & ALWAYS and (furniture[i] or named[i] or (not weights[i] and parser.kinds[blocks[i]][0] in PARAGRAPHS)):
                if furniture[i] or named[i]:
                    between += 1
                else:
                    kept.add(i)
                    between = 0
                i += step
    return "\n\n".join(texts[i] for i in sorted(kept) if not furniture[i])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h) for _, part in pieces(html) for h in part], pa.string())

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
