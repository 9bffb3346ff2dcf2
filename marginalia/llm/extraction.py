"""Main text of web pages from standard-library parser events.

The parser is fed in stretches and its events build a small element tree with
text lines (what stands between block-level tags).  Each line has a ratio of
text to tags; ratios are smoothed over neighbouring lines with a Gaussian and
split by a threshold into content and other lines (one-dimensional two-means
of the logarithms).  The clusters select the text:

 1. Suspects.  Tags, roles and whole words of class and id only make an
    element suspect (menu, header outside the article, footer, sidebar,
    notice, advert, form, comments).  Suspects are judged by the weight of
    their content lines, heaviest first: one goes unless what is not suspect
    weighs next to nothing beside it.  So a wrapper around the whole page
    stays whatever it is called.
 2. Region.  From the root down, the element that holds most of the content
    weight is followed to the smallest that still does.  Articles of like
    weight side by side are taken together.
 3. Lines.  An article or main element is taken whole.  Elsewhere the region
    runs from the headings before its first content line to its end, and runs
    of three or more lines that are mostly links are left out.

Lines: character references are decoded, runs of white space become one
space, ends are trimmed, empty lines are dropped, lines are joined by \n.

Time is linear in the page: weights go up the tree once, stray or missing end
tags are found through the nearest element that they may concern, and tags
that are never closed are closed before the parser sees them.

Defined results: null html is empty; a page without a line gives an empty
text; unclosed and stray tags are tolerated; of elements of equal weight the
first one in the page is followed; very long pages are parsed whole; repeated
rows are extracted alike; an empty table gives an empty table; extra columns
are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

#: Elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text.
DROPPED = frozenset("head title script style noscript template button select textarea iframe object svg canvas audio video datalist label input".split())
SUSPECT_TAGS = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of classes and identifiers that make an element suspect.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar rail widget notice notices cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay alert share sharing social related recommended comment comments disqus replies respond pagination pager toc skip".split())
#: A class that begins with one of these says something of the page, not of the element.
NEGATIONS = frozenset("has no not with without is js can hide show".split())
CONTAINERS = frozenset("html body main article section div td th center table tbody tr ul ol dl li".split()) | SUSPECT_TAGS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open one of these ends when the next such element starts.
CLOSES = {"li": {"li"}, "p": BLOCKS - {"html", "body"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SIGMA, DESCEND, STRETCH = 1.0, 0.7, 1 << 16
#: A suspect stays if what is not suspect weighs less than this share of it; tags and comments are surer than words.
WEAK, SURE = 0.25, 0.02
_SURE_WORDS = frozenset("comment comments disqus replies respond".split())
LINK_RUN = 3
#: A tag as far as its own syntax goes: quotes count after an equals sign only.
_TAG = re.compile(r"""</?([A-Za-z][^\s/<>"'=]*)(?>[^<>=]+|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])))*+(>?)""")
_NEXT, _OPEN = re.compile("[<>]"), re.compile("<(?=[/!?A-Za-z])")
_RAW = {tag: re.compile(f"</(?={tag}[\\s/>])", re.IGNORECASE) for tag in ("script", "style")}
_PARTS = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")


class _Element:
    __slots__ = ("tag", "parent", "stop", "dropped", "suspect", "weight", "clean")

    def __init__(self, tag: str, parent: _Element | None, dropped: bool, suspect: float = 0.0) -> None:
        self.tag, self.parent, self.dropped, self.suspect = tag, parent, dropped, suspect
        # the nearest element, itself included, that ends the search for what a start tag closes
        self.stop = self if parent is None or tag in CONTAINERS or tag in CLOSES or tag in DROPPED else parent.stop
        self.weight = self.clean = 0.0


def suspicion(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> float:
    """0, or the share below which what is not suspect has to weigh for the element to stay."""
    if tag in ("html", "body", "main"):
        return 0.0
    if tag == "article":
        names = [w.lower() for name, value in attrs if name in ("class", "id") and value for w in value.split()]
        return SURE if any(_PARTS.findall(w)[:1] in (["comment"], ["comments"]) for w in names) else 0.0
    if tag in SUSPECT_TAGS:
        return WEAK if tag == "form" else SURE
    found = WEAK if tag == "header" and not inside_article else 0.0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value and value.lower() in ROLES:
            found = found or WEAK
        elif name in ("class", "id") and value:
            for token in value.split():
                parts = [w.lower() for w in _PARTS.findall(token)]
                if not parts or len(parts) > 1 and parts[0] in NEGATIONS:
                    continue
                # a word says what the element is where it starts or ends the name
                ends = {parts[0], parts[-1]}
                if ends & _SURE_WORDS:
                    found = SURE
                elif ends & WORDS or not inside_article and "header" in ends:
                    found = found or WEAK
    return found


class _Line:
    __slots__ = ("element", "text", "tags", "links")

    def __init__(self, element: _Element, text: str, tags: int, links: int) -> None:
        self.element, self.text, self.tags, self.links = element, text, tags, links


def settled(html: str) -> str:
    """The page with every tag, comment and declaration closed, so no event waits for an end that may not come.

    A tag that isn't closed by its own syntax ends at the next < or >, without
    its attributes; what is still open at the page's end is no text.
    """
    out, copied, at = [], 0, 0
    while found := _OPEN.search(html, at):
        at = found.start()
        if html.startswith(("<!", "<?"), at):
            mark = "-->" if html.startswith("<!--", at) else ">"
            end = html.find(mark, at + (4 if mark == "-->" else 2))
            if end < 0:
                return "".join(out) + html[copied:at]
            at = end + len(mark)
            continue
        tag = _TAG.match(html, at)
        if tag is None:  # a slash and no name: the parser reads up to the next > as a comment
            end = html.find(">", at)
            if end < 0:
                return "".join(out) + html[copied:at]
            at = end + 1
            continue
        if not tag[2]:
            border = _NEXT.search(html, at + 1)
            if border is None:
                return "".join(out) + html[copied:at]
            out += [html[copied:at], "</" if html[at + 1] == "/" else "<", tag[1], ">"]
            copied = at = border.start() + (border[0] == ">")
        else:
            at = tag.end()
        raw = _RAW.get(tag[1].lower()) if html[tag.start() + 1] != "/" else None
        if raw:
            end = raw.search(html, at)
            if end is None:
                break
            at = end.start()
    return "".join(out) + html[copied:]


class PageEvents(HTMLParser):
    """Collects the elements in page order and the lines of everything that may be text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.current = _Element("html", None, False)
        self.elements = [self.root]
        self.open: Counter = Counter()
        self.lines: list[_Line] = []
        self.pieces: list[str] = []
        self.tags = self.linked = 0

    def _line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append(_Line(self.current, text, self.tags, self.linked))
            self.pieces = []
        self.tags = self.linked = 0

    def _leave(self, element: _Element) -> None:
        while self.current is not element.parent:
            self.open[self.current.tag] -= 1
            self.current = self.current.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in BLOCKS:
            self._line()
            node = self.current.stop
            while True:
                if tag in CLOSES.get(node.tag, ()):
                    self._leave(node)
                    break
                if node.parent is None or node.tag in CONTAINERS or node.tag in DROPPED:
                    break
                node = node.parent.stop
        self.tags += 1
        if tag in VOID or tag in ("html", "body"):
            return
        inside = self.open["article"] > 0 or self.open["main"] > 0
        self.current = _Element(tag, self.current, self.current.dropped or tag in DROPPED, suspicion(tag, attrs, inside))
        self.elements.append(self.current)
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        if self.open[tag] > 0:
            node = self.current
            while node.tag != tag:
                node = node.parent
            self._leave(node)

    def handle_data(self, data: str) -> None:
        if not self.current.dropped:
            self.pieces.append(data)
            if self.open["a"] > 0:
                self.linked += len(data)

    def finished(self) -> list[_Line]:
        self.close()
        self._line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights at the ends are normalised."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        own = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(own, values[lo:hi])) / sum(own))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of the logarithms, by two-means from the extremes."""
    logs = [math.log1p(v) for v in values]
    low, high = min(logs), max(logs)
    if high - low < 1e-9:
        return 0.0
    for _ in range(50):
        border = (low + high) / 2
        below, above = [x for x in logs if x < border], [x for x in logs if x >= border]
        new = (sum(below) / len(below), sum(above) / len(above))
        if new == (low, high):
            break
        low, high = new
    return math.expm1((low + high) / 2)


def unsuspected(elements: list[_Element]) -> set[_Element]:
    """The elements neither dropped nor in a suspect."""
    out: set[_Element] = set()
    for e in elements:
        if not e.dropped and not e.suspect and (e.parent is None or e.parent in out):
            out.add(e)
    return out


def drop_suspects(elements: list[_Element]) -> None:
    """Mark as dropped the suspects that hold no main part of the content, and all that is in dropped elements."""
    below: dict[_Element, list[_Element]] = {}
    owner: dict[_Element, _Element] = {}  # each element's nearest suspect, or the root
    holds: set[_Element] = set()  # suspects, or the root, that own an article or main element
    for e in elements:
        owner[e] = e if e.suspect or e.parent is None else owner[e.parent]
        if e.suspect and not e.dropped:
            below.setdefault(owner[e.parent], []).append(e)
        elif e.tag in ("article", "main") and not e.dropped:
            holds.add(owner[e])
    around = set()  # suspects with one of those further down
    for e in reversed(elements):
        if e.parent is not None and e.suspect and (e in holds or e in around):
            around.add(e)
            around.add(owner[e.parent])
    waiting = [(-0.0, 0, elements[0])]
    outside, landmark, number, kept = 0.0, False, 0, set()
    while waiting:
        _, _, context = heapq.heappop(waiting)
        if context.suspect and (outside > context.suspect * context.weight or landmark and context not in around):
            continue
        kept.add(context)
        outside += context.clean
        landmark |= context in holds
        for e in below.get(context, ()):
            number += 1
            heapq.heappush(waiting, (-e.weight, number, e))
    for e in elements:
        e.dropped = e.dropped or owner[e] not in kept


def weigh(elements: list[_Element], lines: list[_Line], content: list[bool]) -> None:
    """Content weight of every element with all below it, and without what is in suspects; parents precede children."""
    for e in elements:
        e.weight = e.clean = 0.0
    for line, good in zip(lines, content):
        # a page without content lines is still followed by its other lines
        line.element.weight += len(line.text) if good and not line.element.dropped else 0.0
        line.element.clean = line.element.weight
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.weight += e.weight
            if not e.suspect:
                e.parent.clean += e.clean


def region(elements: list[_Element]) -> _Element:
    """The smallest element on the way down that holds most of the content."""
    best: dict[_Element, list[_Element]] = {}  # the two heaviest inner elements
    for e in elements:
        if e.parent is not None and e.tag in CONTAINERS and e.weight:
            # inline and other elements between are passed over by way of their parent
            two = best.setdefault(e.parent.stop if e.parent.tag not in CONTAINERS else e.parent, [])
            two.append(e)
            if len(two) > 2:
                two.sort(key=lambda x: -x.weight)
                two.pop()
    node = elements[0]
    while node.tag != "article":
        two = sorted(best.get(node, ()), key=lambda x: -x.weight)
        if not two:
            break
        landmark = two[0].tag in ("article", "main")
        if two[0].weight < (0.3 if landmark else DESCEND) * node.weight:
            break
        if two[0].tag == "article" and len(two) > 1 and two[1].tag == "article" and two[1].weight >= two[0].weight / 2:
            break
        node = two[0]
    return node


def main_text(html: str) -> str:
    events, html = PageEvents(), settled(html)
    for at in range(0, len(html), STRETCH):
        events.feed(html[at : at + STRETCH])
    lines, elements = events.finished(), events.elements
    if not lines:
        return ""
    ratios = smoothed([len(line.text) / max(1, line.tags) for line in lines])
    plain = unsuspected(elements)
    # what is not suspect is clustered by itself as well, so long comments don't outdo a plainer article
    border = min(threshold(x) for x in (ratios, [r for r, line in zip(ratios, lines) if line.element in plain]) if x)
    content = [r >= border for r in ratios]
    weigh(elements, lines, content)
    drop_suspects(elements)
    weigh(elements, lines, content)
    chosen = region(elements)
    whole = chosen
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    top = whole or chosen
    inside: dict[_Element, bool] = {}
    in_heading: dict[_Element, bool] = {}
    for e in elements:
        inside[e] = e is top or e.parent is not None and inside[e.parent]
        in_heading[e] = e.tag in HEADINGS or e.parent is not None and in_heading[e.parent]
    kept = [k for k, line in enumerate(lines) if inside[line.element] and not line.element.dropped]
    if whole is None:
        kept = _region_lines(lines, content, in_heading, kept)
    return "\n".join(lines[k].text for k in kept)


def _region_lines(lines: list[_Line], content: list[bool], in_heading: dict[_Element, bool], kept: list[int]) -> list[int]:
    """Of the region's lines, those from the headings before the first content line on, without runs of link lines."""
    first = next((i for i, k in enumerate(kept) if content[k]), None)
    if first is None:
        return []
    start = next((i for i, k in enumerate(kept[:first]) if in_heading[lines[k].element]), first)
    out: list[int] = []
    run: list[int] = []
    for k in [*kept[start:], None]:
        if k is not None and not in_heading[lines[k].element] and 2 * lines[k].links > len(lines[k].text):
            run.append(k)
            continue
        if len(run) < LINK_RUN:
            out += run
        run = []
        if k is not None:
            out.append(k)
    return out


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every page."""
    prepare(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=_TEXTS)

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string")
