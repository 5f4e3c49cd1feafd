"""Main text of web pages from streamed parser events.

The standard library's parser is fed in pieces; its events build lines (one for each block element) that hold text, the
number of tags seen while the line was open, and the chain of containers around it. A line's text-to-tag ratio is
smoothed by a Gaussian over its neighbours; lines above the threshold (a share of the ratios' standard deviation) are
clustered, and the content region is the article or main element that holds most of the clustered text, or else the innermost
container with all of it. Every line of the region is kept, short ones and headings too, but for what is something
else (menus, headers and footers, sidebars, notices, adverts, forms, comments), and for lines of nothing but links under the
threshold and outside any article, main element or heading.

A container's class or id alone never takes a page away: names only mark it, and what it holds decides once the page
is read. One that holds the page's article stays, and so does one with nearly all of the text that nothing marks; inside an
article only names of what an article doesn't have mark at all. Comments are marked whatever else their names say.

Defined results: null and empty pages give an empty text; broken markup is read as far as the parser goes; repeated rows
give repeated rows; null ids are kept; other columns are ignored, whatever their names; an empty table gives an empty
table. Memory grows with the longest page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
#: Width of the Gaussian in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 0.5
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CONTAINERS = frozenset("article aside blockquote body center details div dl fieldset figure footer form header main menu nav ol section table td ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split()
)


def _named(words: str) -> re.Pattern:
    return re.compile(r"(?:^|[\s_-])(?:" + "|".join(words.split()) + r")(?:$|[\s_-])")


#: Names of reader comments, of what isn't part of an article, and of what is so only outside one.
COMMENTS = _named("comment comments commentlist disqus replies respond")
FOREIGN = _named(
    "ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs cc-window consent cookie cookies gdpr masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices pager pagination popup popups promo promoted promotion rail sidebar signup skip-link sponsor sponsored subscribe "
    "subscription toolbar topbar"
)
BESIDE = _named("byline copyright disclaimer footer header related share sharing social tagcloud teaser widget widgets")
#: With one of these names a container isn't marked by those of BESIDE.
CONTENT = _named("article content main post story entry")
#: How many times the unmarked text a marked container must hold to stay, and the share of the clustered text of an article
#: that is the region by itself.
HOLDS, ARTICLE_SHARE = 3, 2 / 3
ROLES = frozenset("banner complementary contentinfo dialog alert form menu menubar navigation search".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Start tags that end an open paragraph, what keeps an end from being implied through it, and tags that don't end a head.
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li option tbody td tfoot th thead tr".split())
SCOPES = frozenset("button caption dialog dl object ol select table template ul".split())
HEADING = re.compile("h[1-6]$")
IN_HEAD = frozenset("base basefont link meta noscript script style template title".split())


class Line(NamedTuple):
    """A block's text, the tags seen in it, and the containers around it, numbered (articles and main elements negative)."""

    text: str
    tags: int
    chain: tuple[int, ...]
    links_only: bool


class Lines(HTMLParser):
    """Collects a line for each block of text that isn't skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.linked, self.free = False, False  # inside a link; whether the line has text outside links, or is a heading
        self.open: list[tuple[str, int]] = []
        self.chain: tuple[int, ...] = ()
        self.text: list[str] = []
        self.tags = 0
        self.serial = 0
        self.inner: list[str] = []  # the skipped element and what is open in it
        self.forms: dict[int, bool] = {}  # whether a form holds an article or main element
        self.marks: dict[int, str] = {}  # containers whose names say that they are something else

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.chain, not self.free))
        self.text, self.tags, self.free = [], 0, False

    def _within(self, *tags: str) -> bool:
        return any(t in tags for t, _ in self.open)

    def _skips(self, tag: str, attrs: dict[str, str | None]) -> bool:
        """Whether an element is left out as soon as it begins."""
        if tag in ("html", "body", "article", "main"):
            return False
        if tag in SKIPPED and tag != "form":
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return True
        if tag == "header":
            return not self._within("article", "main")
        if tag in CONTAINERS or (tag not in BLOCKS and tag not in ("span", "ins")):
            return False
        return self._mark(tag, attrs) is not None

    def _mark(self, tag: str, attrs: dict[str, str | None]) -> str | None:
        """What an element's names say it is, if that isn't part of the article."""
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        role = (attrs.get("role") or "").lower()
        if COMMENTS.search(names):
            return "comment"
        if tag in ("html", "body", "article", "main"):
            return None
        if FOREIGN.search(names) or (role in ROLES and (tag, role) != ("form", "form")):
            return "foreign"
        if not BESIDE.search(names) or CONTENT.search(names):
            return None
        if tag not in CONTAINERS:
            return None if self._within("article", "main") else "beside"
        return "links" if self._within("article") else "aside" if self._within("main") else "beside"

    def _ends_skip(self, tag: str) -> bool:
        """Whether a start tag ends the skipped element; closes what it implies within."""
        if tag == "body" or (self.inner == ["head"] and tag not in IN_HEAD):
            return True
        names = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for i in range(len(self.inner) - 1, -1, -1):
            if self.inner[i] in names:
                del self.inner[i:]
                return not self.inner
            if self.inner[i] in SCOPES or (self.inner[i] in BLOCKS and self.inner[i] not in ("p", "div", "address")):
                return False
        # A paragraph in an open item or cell ends with it; a division doesn't.
        return self.inner[0] not in CONTAINERS and any(n == self.open[-1][0] for n in names - {"p"} if self.open)

    def handle_starttag(self, tag, attrs):
        if self.inner:
            if not self._ends_skip(tag):
                if tag not in VOID:
                    self.inner.append(tag)
                return
            self.inner = []
        if tag in BLOCKS:
            self.end_line()
            for name in CLOSES.get(tag, ()):
                if self.open and self.open[-1][0] == name:
                    self._close(name)
        self.tags += 1
        self.linked |= tag == "a"
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        of = dict(attrs)
        if self._skips(tag, of):
            self.text.append(" ")
            self.inner = [tag]
            return
        if tag in BLOCKS:
            self.serial += tag in CONTAINERS
            if tag == "form":
                self.forms[self.serial] = False
            elif tag in ("article", "main"):
                self.forms.update((c, True) for c in self.chain if c in self.forms)
            self.open.append((tag, len(self.chain)))
            if tag in CONTAINERS:
                self.chain += (-self.serial if tag in ("article", "main") else self.serial,)
                mark = self._mark(tag, of)
                if mark and tag != "body":
                    self.marks[self.chain[-1]] = mark

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in BLOCKS:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.inner:
            at = next((i for i in range(len(self.inner) - 1, -1, -1) if self.inner[i] == tag), -1)
            if at >= 0:
                del self.inner[at:]
                return
            if tag == "p" or not any(t == tag for t, _ in self.open):
                return
            self.inner = []  # the end of a container around the skipped element
        self.tags += 1
        self.linked &= tag != "a"
        if tag in BLOCKS:
            self.end_line()
            self._close(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.chain = self.chain[: self.open[i][1]]
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.inner:
            self.text.append(data)
            self.free |= (not self.linked and not data.isspace()) or bool(self.open and HEADING.match(self.open[-1][0]))


def read_lines(html: str) -> list[Line]:
    parser = Lines()
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    parser.close()
    parser.end_line()
    return without_marked(without_forms(parser.lines, parser.forms), parser.marks)


def without_forms(lines: list[Line], forms: dict[int, bool]) -> list[Line]:
    """Lines outside forms, and of forms that hold an article or main element, or most of the page's text."""
    total = sum(len(line.text) for line in lines)
    held: dict[int, int] = {}
    for line in lines:
        for c in line.chain:
            if c in forms:
                held[c] = held.get(c, 0) + len(line.text)
    gone = {c for c, n in held.items() if not forms[c] and 2 * n <= total}
    return [line for line in lines if not gone.intersection(line.chain)]


def _texts(lines: list[Line]) -> dict[int, int]:
    """Characters in each container."""
    held: dict[int, int] = {}
    for line in lines:
        for c in line.chain:
            held[c] = held.get(c, 0) + len(line.text)
    return held


def main_article(lines: list[Line], marks: dict[int, str]) -> int | None:
    """The article or main element with most text that isn't a comment, nor among comments if there is another."""
    inside: dict[int, bool] = {}
    for line in lines:
        commented = False
        for c in line.chain:
            commented |= marks.get(c) == "comment"
            if c < 0 and marks.get(c) != "comment":
                inside[c] = commented
    held = _texts(lines)
    return max(inside, key=lambda c: (not inside[c], held[c], c), default=None)


def without_marked(lines: list[Line], marks: dict[int, str]) -> list[Line]:
    """Lines outside marked containers, but for those that hold the page's article or, by far, its text. If all would go, all
    stay."""
    held = _texts(lines)
    # An article with most of the page's text is the article, whatever it is called.
    left = {c: k for c, k in marks.items() if c in held and not (c < 0 and 2 * held[c] > sum(len(line.text) for line in lines))}
    article = main_article(lines, left)
    around = next((line.chain[: line.chain.index(article)] for line in lines if article in line.chain), ())
    for c in around:
        left.pop(c, None)
    free = {c for line in lines if not line.links_only for c in line.chain}
    parted = any(c < 0 and c != article for c in held) and article is not None
    for c, kind in list(left.items()):
        # A list of links in an article is a menu; a container with text is not. Beside an article in the main element it is.
        if (kind == "links" and c in free) or (kind == "aside" and c in free and not parted):
            del left[c]
    outer = lambda line: next((c for c in line.chain if c in left), None)
    while True:
        sums: dict[int | None, int] = {}
        for line in lines:
            c = outer(line)
            inner = next((k for k in reversed(line.chain) if k in left), None)
            if c is None or (c == inner and (article is None or article in line.chain[: line.chain.index(c)])):
                sums[c] = sums.get(c, 0) + len(line.text) * (c is not None or not line.links_only)
        large = [c for c, n in sums.items() if c is not None and left[c] != "comment" and n > HOLDS * sums.get(None, 0)]
        if not large:
            break
        del left[max(large, key=lambda c: sums[c])]
    kept = [line for line in lines if outer(line) is None]
    return kept or lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    x = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def content_lines(lines: list[Line]) -> list[str]:
    if not lines:
        return []
    ratios = np.array([len(line.text) / max(1, line.tags) for line in lines])
    smooth = smoothed(ratios)
    chosen = smooth >= THRESHOLD * smooth.std()
    # A page of links (an anchor that is never closed makes one) is judged by its clusters alone.
    linked = sum(len(line.text) for line in lines if line.links_only)
    listed = 2 * linked < sum(len(line.text) for line in lines)
    chains = [line.chain for line, good in zip(lines, chosen) if good and not (listed and line.links_only)]
    region = chains[0] if chains else ()
    for chain in chains:
        same = next((k for k, (a, b) in enumerate(zip(region, chain)) if a != b), min(len(region), len(chain)))
        region = region[:same]
    region = next((region[: k + 1] for k, c in enumerate(region) if c < 0), region)
    clustered = [line for line, good in zip(lines, chosen) if good]
    article = main_article(clustered, {})
    if article is not None and _texts(clustered)[article] >= ARTICLE_SHARE * sum(len(line.text) for line in clustered):
        chain = next(line.chain for line in clustered if article in line.chain)
        region = next(chain[: k + 1] for k, c in enumerate(chain) if c < 0)
    inside = lambda line: line.chain[: len(region)] == region
    # Smoothing lifts what stands next to long text, so a line of links is held to the threshold by its own ratio.
    only = lambda line, ratio: listed and line.links_only and ratio < THRESHOLD * smooth.std() and min(line.chain, default=0) >= 0
    return [line.text for line, ratio in zip(lines, ratios) if inside(line) and not only(line, ratio)]


def main_text(html: str | None) -> str:
    return "\n\n".join(content_lines(read_lines(html or "")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of each page."""
    chosen = df.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html")
    )
    kind = chosen.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])

    out = chosen.mapInArrow(run, f"_id {kind}, _url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
