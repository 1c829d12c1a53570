"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's HTML parser streams tags and text. Block tags end a line; a line
has its text, the tags seen in it, how much of it is links and the innermost section or
marked element that it is in. The logarithm of text per tag is smoothed over neighbouring
lines with a Gaussian, and the threshold that best parts a page's scores into two clusters
(the largest variance between them) makes lines dense or sparse. Clusters whose ratios
differ by less than e^APART are one, so a page of even paragraphs is dense throughout.

The dense text elects a container: an article or main part with half of it, else the
innermost section with nearly all of it. What lies in the elected container is content:
tables, lists and one-word paragraphs are sparse but belong to it. Outside of an article
nothing is content; outside of another container lines that are dense by themselves, too,
so that a list of links or a line of advertising beside it goes without being marked. In a
container that is no article the links before the first dense line go, and on a page
without any container also those after the last.

Marks. Navigation, footers and the like, and elements of which a whole role, class or id
says that they are a menu, header, footer, sidebar, notice, advert or reader comments,
count little when the container is elected, and go, unless the elected container is in
them: an article in an element marked as a sidebar stays. Of elements that weaker words
(related, share, tags) mark, dense lines of text stay. A word counts only if all words of
its token do, so "social-study" and "search-history" say nothing.

Nothing is shuffled; each page is one row's work, in time linear in its length (and a sort
of its lines), and batches are taken 64 pages at a time.

Nulls: null or empty html has empty text; null ids and urls are carried through. Of nested
parts with the same claim the innermost is elected. Rows that repeat each get a row; an
empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 2.0
#: Clusters nearer than this, in logarithms, are one; shares of the dense text that elect an article and another container; from what share on a line is links.
APART, ARTICLE_SHARE, SHARE, LINKS = 1.0, 0.5, 0.95, 0.5
#: What a mark leaves of the text's say in the election: weak words, strong ones, elements that aren't shown, tags that never hold an article; an article in any of them.
SAY = {"": 1.0, "weak": 0.3, "strong": 0.1, "header": 0.1, "hidden": 0.01, "hard": 0.0}
ARTICLE_SAY = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template svg head title iframe object canvas math datalist audio video".split())
HARD_TAGS = frozenset("nav footer button select textarea dialog menu".split())
STRONG_TAGS = frozenset("aside form fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SECTIONS = frozenset("article main section div td body".split())
#: Words of a role, class or id that name a part which isn't the article, words that hint at it, and words that go with either.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars masthead topbar footer comment comments commentlist replies respond disqus"
    " newsletter subscribe signup login popup modal overlay pagination pager complementary contentinfo alertdialog hidden header".split()
)
HINTS = frozenset("related recommended recommendations share sharing social tags widget widgets toolbar search copyright disclaimer legal rail".split())
FILLER = frozenset(
    "site page main top bottom left right global primary secondary sub area box block list item items section container wrapper wrap inner outer content bar body"
    " slot unit group links link text thread form user reader readers post posts the and js id col column mobile desktop".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def token_mark(token: str) -> str:
    """What a class, id or role says of its element."""
    words = [w.lower() for w in _WORD.findall(token)]
    if not words or not all(w in STRONG or w in HINTS or w in FILLER for w in words):
        return ""
    return "strong" if any(w in STRONG for w in words) else "weak" if any(w in HINTS for w in words) else ""


def element_mark(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """The mark of an element by its own tag and attributes."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _NOT_SHOWN.search(value):
            return "hidden"
    if tag in HARD_TAGS:
        return "hard"
    if tag in STRONG_TAGS:
        return "strong"
    if tag in ("html", "body", "main"):
        return ""
    said = {token_mark(t) for name, value in attrs if name in ("class", "id", "role") and value for t in value.split()}
    return "strong" if "strong" in said else "header" if tag == "header" else "weak" if "weak" in said else ""


class Part(NamedTuple):
    """A section or a marked element; its parent is an earlier one."""

    parent: int
    tag: str
    mark: str


class Line(NamedTuple):
    text: str
    tags: int
    links: int
    part: int


class Lines(HTMLParser):
    """Collects the lines of a page and the parts they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts = [Part(0, "", "")]
        self.stack: list[tuple[str, int, bool]] = []  # tag, part, skipped
        self.buffer, self.tags, self.links = [], 0, 0
        self.where: dict[str, list[int]] = defaultdict(list)  # places of each tag on the stack
        self.sections: list[int] = []  # places of sections on the stack

    def _end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.lines.append(Line(text, self.tags, min(self.links, len(text)), self.stack[-1][1] if self.stack else 0))
            self.tags = 0
        self.links = 0
        self.buffer.clear()

    def _pop(self) -> None:
        tag = self.stack.pop()[0]
        self.where[tag].pop()
        if tag in SECTIONS:
            self.sections.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in SKIP:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "option") and self.stack and self.stack[-1][0] == tag:
            self._pop()
        _, part, skip = self.stack[-1] if self.stack else ("", 0, False)
        mark = element_mark(tag, attrs)
        if mark or tag in SECTIONS:
            self.parts.append(Part(part, tag, mark))
            part = len(self.parts) - 1
        if tag in SECTIONS:
            self.sections.append(len(self.stack))
        self.where[tag].append(len(self.stack))
        self.stack.append((tag, part, skip or tag in SKIP))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in SKIP:
            self._end_line()
        self.tags += 1
        if not self.where.get(tag):
            return
        k = self.where[tag][-1]
        if tag not in BLOCKS and self.sections and self.sections[-1] > k:
            return
        while len(self.stack) > k:
            self._pop()

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.buffer.append(data)
            if self.where.get("a"):
                self.links += len(_SPACE.sub(" ", data).strip())

    def close(self):
        super().close()
        self._end_line()


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over lines; weights at the ends are renormalised."""
    if sigma <= 0:
        return ratio
    reach = int(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = lambda x: np.convolve(np.pad(x, reach), w, "valid")
    return pad(ratio) / pad(np.ones(len(ratio)))


def threshold(scores: np.ndarray) -> float:
    """The least score of the upper of two clusters; minus infinity where there is only one."""
    x = np.sort(scores)
    n, sums = np.arange(1, len(x)), np.cumsum(x)
    if not len(n):
        return -np.inf
    below, above = sums[:-1] / n, (sums[-1] - sums[:-1]) / (len(x) - n)
    k = int(np.argmax(n * (len(x) - n) * (above - below) ** 2))
    return float(x[k + 1]) if above[k] - below[k] >= APART else -np.inf


def elect(parts: list[Part], say: np.ndarray) -> int:
    """The part whose text is the content; ``say`` is what the dense lines of each part, with those inside it, have to say. -1 if nothing has."""
    total = say[0]
    if total <= 0:
        return -1
    articles = [k for k, p in enumerate(parts) if p.tag in ("article", "main") and say[k] >= ARTICLE_SHARE * total]
    if articles:
        return articles[-1]  # they are nested, and the inner is later
    return max(k for k, p in enumerate(parts) if say[k] >= SHARE * total and (k == 0 or p.tag in SECTIONS))


def region(lines: list[Line], parts: list[Part], sigma: float = SIGMA) -> list[bool]:
    """Which lines belong to the content."""
    raw = np.log1p([len(x.text) / max(1, x.tags) for x in lines])
    score = smooth(raw, sigma)
    bound = threshold(score)
    weight, say = np.ones(len(parts)), np.zeros(len(parts))
    for k, p in enumerate(parts[1:], 1):
        weight[k] = weight[p.parent] * SAY[p.mark]
        if p.tag in ("article", "main") and not p.mark and weight[k] < ARTICLE_SAY:
            weight[k] = ARTICLE_SAY
    for x, dense in zip(lines, score >= bound, strict=True):
        say[x.part] += weight[x.part] * len(x.text) * dense
    for k in range(len(parts) - 1, 0, -1):
        say[parts[k].parent] += say[k]
    chosen = elect(parts, say)
    if chosen < 0:
        return [False] * len(lines)
    around, up = {0, chosen}, chosen
    while up:
        up = parts[up].parent
        around.add(up)
    is_article, is_page = parts[chosen].tag in ("article", "main"), parts[chosen].tag in ("", "html", "body")
    inside, gone, weak = ([False] * len(parts) for _ in range(3))
    inside[0] = chosen == 0
    for k, p in enumerate(parts[1:], 1):
        inside[k] = k == chosen or inside[p.parent]
        if k not in around:
            soft = p.mark == "header" and inside[k] and not is_page  # a heading of the article itself
            gone[k] = gone[p.parent] or p.mark in ("hard", "strong", "hidden") or p.mark == "header" and not soft
            weak[k] = weak[p.parent] or p.mark == "weak"
    links = [x.links >= LINKS * len(x.text) for x in lines]
    solid = [bool(r >= bound and s >= bound) and not a for r, s, a in zip(raw, score, links, strict=True)]
    keep = [not gone[x.part] and (solid[k] if weak[x.part] or not inside[x.part] else True) and (inside[x.part] or not is_article) for k, x in enumerate(lines)]
    if not is_article and bound > -np.inf:
        ends = [range(len(lines))] + [range(len(lines) - 1, -1, -1)] * is_page
        for end in ends:  # links before the first solid line
            for k in end:
                if keep[k] and solid[k]:
                    break
                keep[k] = keep[k] and not links[k]
    return keep


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """Main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return ""
    keep = region(parser.lines, parser.parts, sigma)
    return " ".join(x.text for x, k in zip(parser.lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.select(page_id).schema[0].dataType.simpleString()
    return pages.select(page_id, url, html).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
