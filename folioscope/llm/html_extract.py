"""HTML extraction by minimum-cut labelling.

A page is cut into blocks: runs of text between tags that break a line.  A linear classifier gives each block a bounded
log-odds of being content from graded evidence: its length, share of text in links, sentence marks, innermost element,
and what the elements around it say (tag, class, id, role).  The positive part is the block's capacity from the source,
the negative part that to the sink.  Smoothness edges join neighbours in page order, stronger the closer they are in the
document tree, and neighbours of one kind under one parent.  Costs and edges are of like size: a short heading or line
among paragraphs has odds against it and is kept by its neighbours, and a stray sentence in a menu goes with the menu.  A
maximum flow separates content from boilerplate at least cost.  Blocks whose cost outweighs all their edges are labelled
first (no minimum cut can do otherwise); the flow runs on each connected run of the others.

Defined results: null html is empty; a page without text gives the empty text; unclosed tags, comments and scripts end
with the page; white space inside a block becomes one space and blocks are joined by one space; repeated rows give
repeated rows; an empty table gives an empty result.  Other columns pass through.  Parsing is linear in the page however
deep its elements nest.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import pieces, table

# Element names of HTML and the words that sites use for parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video head select option datalist noframes noembed xmp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
LISTS = ("ul", "ol", "dl", "table")
#: Evidence of the elements around a block.
ASIDE_TAGS = {"nav": 4.0, "footer": 4.0, "aside": 4.0, "form": 4.0, "menu": 4.0, "dialog": 4.0, "button": 4.0, "fieldset": 4.0, "header": 3.5}
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
CLEAR_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer copyright comment comments commentlist disqus reply replies respond sharing newsletter subscribe subscription popup modal overlay login signin signup pagination pager toolbar disclaimer masthead topbar bottombar outbrain taboola aside".split())
VAGUE_NAMES = {"discussion": 2.5, "share": 2.5, "social": 2.5, "related": 2.5, "recommended": 2.5, "recommendations": 2.5, "register": 2.0, "search": 2.5, "widget": 2.5, "hidden": 2.5, "skip": 2.5, "teaser": 2.0, "header": 2.0, "head": 0.8, "meta": 1.0, "byline": 1.0, "tags": 1.5, "side": 2.0, "foot": 2.5, "form": 3.0}
CONTENT_NAMES = frozenset("article content post entry story main text articlebody body prose hentry".split())
CLEAR, MOST_ASIDE, CONTENT = 4.0, 8.0, 2.0
#: Stands for an element that is not shown; no sum of other evidence is near it.
UNSEEN = 1e6
#: Share of vague names that counts inside an article, where long prose outweighs it.
INSIDE = 0.5
#: Evidence of a block itself.
BLOCK_ODDS = {"p": 1.0, "blockquote": 0.6, "pre": 0.6, "li": -0.3, "td": -0.3, "th": -0.3}
HEADING_ODDS = -1.2  # titles of sites, side parts and articles read alike; what follows a heading tells
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BASE, LENGTH, LINKS, SENTENCE, NOTICE, MOST = -1.8, 0.5, -3.0, 0.5, -2.0, 2.5
#: Lengths count in units of this share of a page's running text, of one character to `LONGEST_UNIT`.
UNIT, LONGEST_UNIT = 0.05, 40.0
#: Smoothness: of neighbours in page order at tree distance d, NEAR / (1 + d), a share of it for each way in which the
#: surroundings differ; of one kind under one parent; of a heading and what follows it under its parent.
NEAR, OTHER_TAG, OTHER_PART, ALIKE, HEADED = 3.0, 0.5, 0.25, 1.0, 1.2
#: Elements whose class and id say nothing of what is in them, and first words of names that tell what else a page has.
UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
OTHERS = frozenset("no not has have with without hide hides".split())

_TOKEN = re.compile(r"""<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDS = re.compile(r"[.!?…。](?:[\"'»”)\]]|\s|$)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NOTICE = re.compile(r"^(?:©|copyright\b|\(c\) )|\ball rights reserved\b", re.I)


def _name_evidence(value: str, inside: bool) -> tuple[float, float]:
    """Evidence against and for content of class or id names.  `no-sidebar` and the like do not count against, nor do
    vague words beside one for content, as in `article-header`."""
    against: dict[str, float] = {}
    good = 0.0
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if len(words) > 1 and words[0] in OTHERS:
            continue
        named = not CONTENT_NAMES.isdisjoint(words)
        good = CONTENT if named else good
        for w in words:
            if w in CLEAR_NAMES:
                against[w] = CLEAR
            elif not named:
                against[w] = VAGUE_NAMES.get(w, 0.0) * (INSIDE if inside else 1.0)
    return sum(against.values()), good


def _element_evidence(tag: str, attrs: str, inside: bool) -> tuple[float, float]:
    """Evidence against and for content of all text in an element.  inside: an article or main part is open; the header
    of an article belongs to it."""
    against = 0.0 if tag == "header" and inside else ASIDE_TAGS.get(tag, 0.0)
    good = CONTENT if tag in ("article", "main") else 0.0
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "itemprop", "data-role"):
                if tag not in UNNAMED or name not in ("class", "id"):
                    a, g = _name_evidence(value, inside)
                    against, good = against + a, max(good, g)
            elif name == "role":
                role = value.strip().lower()
                against += CLEAR if role in ASIDE_ROLES else 0.0
                good = CONTENT if role in ("main", "article") else good
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
                against += UNSEEN
    return against, good


class Block:
    """A run of text: how much of it is in links, evidence against and for content around it, its innermost element's
    tag, the number of the element above that, and the steps in the document tree from the block before."""

    __slots__ = ("text", "links", "against", "good", "tag", "above", "steps")

    def __init__(self, text, links, against, good, tag, above, steps):
        self.text, self.links, self.against, self.good = text, links, against, good
        self.tag, self.above, self.steps = tag, above, steps

    def cost(self, unit: float) -> float:
        """Log-odds of being content, at most MOST either way; what is not shown is never content."""
        if self.against >= UNSEEN:
            return -100.0
        n = len(self.text)
        own = BASE + (HEADING_ODDS if self.tag in HEADINGS else BLOCK_ODDS.get(self.tag, 0.0))
        own += LENGTH * math.log1p(n / unit) + LINKS * self.links / n
        own += SENTENCE if _ENDS.search(self.text) else 0.0
        if not self.good and _NOTICE.search(self.text):
            own += NOTICE
        return max(-MOST, min(MOST, own + self.good - min(self.against, MOST_ASIDE)))


def costs(found: list[Block]) -> list[float]:
    running = sum(len(b.text) - b.links for b in found if not b.against)
    unit = min(1.0 + UNIT * running, LONGEST_UNIT)
    return [b.cost(unit) for b in found]


class _Open:
    """The open elements, with what is needed of them at hand, so that no step walks the whole stack."""

    def __init__(self):
        self.tags, self.against, self.good, self.numbers = [""], [0.0], [0.0], [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # of each tag, where it is open
        self.lines = [0]  # where elements that break lines are open
        self.low = 0  # fewest lines open since the last block

    def push(self, tag: str, against: float, good: float, number: int) -> None:
        self.at[tag].append(len(self.tags))
        if tag not in INLINE:
            self.lines.append(len(self.tags))
        self.tags.append(tag)
        self.against.append(self.against[-1] + against)
        self.good.append(max(self.good[-1], good))
        self.numbers.append(number)

    def pop_to(self, k: int) -> None:
        for i in range(len(self.tags) - 1, k - 1, -1):
            self.at[self.tags[i]].pop()
            if self.lines[-1] == i:
                self.lines.pop()
        del self.tags[k:], self.against[k:], self.good[k:], self.numbers[k:]
        self.low = min(self.low, len(self.lines))

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack = _Open()
    held: list[tuple[str, bool]] = []
    number, at, end, depth = 0, 0, len(html), 0

    def flush() -> None:
        nonlocal depth
        text = " ".join(unescape("".join(t for t, _ in held)).split())
        if text:
            links = min(sum(len(t.strip()) for t, linked in held if linked), len(text))
            inner, now = stack.lines[-1], len(stack.lines)
            above = stack.numbers[stack.lines[-2]] if now > 1 else 0
            out.append(Block(text, links, stack.against[-1], stack.good[-1], stack.tags[inner], above, depth + now - 2 * min(stack.low, now)))
            depth = stack.low = now
        held.clear()

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            held.append((html[at:stop], bool(stack.at["a"])))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m["close"]:
            k = stack.last(tag)
            if k and (not inline or k > stack.lines[-1]):
                stack.pop_to(k)
            continue
        if tag in RAW and not m["attrs"].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in CLOSES_P:
            if stack.tags[stack.lines[-1]] == "p":
                stack.pop_to(stack.lines[-1])
        elif tag in SIBLINGS:
            k = stack.last(*SIBLINGS[tag])
            if k > stack.last(*LISTS):
                stack.pop_to(k)
        number += 1
        inside = tag in ("article", "main") or bool(stack.at["article"] or stack.at["main"])
        stack.push(tag, *_element_evidence(tag, m["attrs"], inside), number)
    flush()
    return out


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight) between blocks."""
    edges = []
    last: dict[tuple[int, str, float], int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            w = NEAR / (1 + b.steps)
            if a.against != b.against:
                w *= OTHER_PART
            if a.tag in HEADINGS and a.above == b.above:
                w += HEADED
            elif a.tag != b.tag:
                w *= OTHER_TAG
            edges.append((i - 1, i, w))
        kind = (b.above, b.tag, b.against)
        if kind in last:
            edges.append((last[kind], i, ALIKE))
        last[kind] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it is on the source side of a minimum cut: the labelling of least cost, where a node on
    the wrong side of its odds costs their size and an edge between labels its weight."""
    n = len(odds)
    side: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    unary = list(odds)
    sure = [i for i in range(n) if abs(odds[i]) > sum(w for _, w in near[i])]
    for i in sure:
        side[i] = odds[i] > 0
    for i in sure:
        for j, w in near[i]:
            unary[j] += w if side[i] else -w
    # the rest falls apart into runs that no edge joins; each is a flow of its own
    for first in range(n):
        if side[first] is not None:
            continue
        run, index = [first], {first: 0}
        for i in run:
            for j, _ in near[i]:
                if side[j] is None and j not in index:
                    index[j] = len(run)
                    run.append(j)
        inner = [(index[i], index[j], w) for i in run for j, w in near[i] if i < j and j in index]
        for i, source in zip(run, _flow([unary[i] for i in run], inner), strict=True):
            side[i] = source
    return side


def _flow(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Maximum flow by blocking flows in layers; nodes that the source still reaches."""
    n = len(unary)
    s, t = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, u in enumerate(unary):
        if u > 0:
            arc(s, i, u, 0.0)
        elif u < 0:
            arc(i, t, -u, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        layer = [-1] * (n + 2)
        layer[s] = 0
        queue = [s]
        for x in queue:
            for e in out[x]:
                if room[e] > 1e-9 and layer[to[e]] < 0:
                    layer[to[e]] = layer[x] + 1
                    queue.append(to[e])
        if layer[t] < 0:
            return [layer[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                x = to[path[cut] ^ 1]
                del path[cut:]
            elif tried[x] < len(out[x]):
                e = out[x][tried[x]]
                if room[e] > 1e-9 and layer[to[e]] == layer[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    tried[x] += 1
            elif path:
                x = to[path.pop() ^ 1]
                tried[x] += 1
            else:
                break


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    keep = minimum_cut(costs(found), smoothness(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with the main text of each html and its length in code points; columns of these names are replaced."""
    pages = pages.drop(*[c for c in (text, n_chars) if c in pages.columns and c != column])
    at = pages.columns.index(column)

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch, at)):
            texts = [main_text(h) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*b.schema.names, text, n_chars])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(text, StringType()), StructField(n_chars, LongType())]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
