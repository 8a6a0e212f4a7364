"""Main text of web pages by minimum-cut labelling.

A page becomes a tree of elements and blocks of text in page order. A classifier gives each block log-odds of being content:
a logistic model of the text (length, links, punctuation, kind of element) plus bounded evidence of the elements around it
(their tags, roles and names). Positive odds are the capacity of the block's edge to the source, negative ones to the sink.
Neighbouring blocks and blocks under one parent are joined by smoothness edges, stronger the closer they are in the DOM and
weaker across the border of an element with evidence of its own. The minimum cut, from a maximum flow, labels the blocks.

The weights of the text model are fitted on blocks of a bounded sample of the pages (SAMPLE pages): those in article and main
elements against those in nav, aside, footer, form and site header elements, drawn towards fixed weights, which hold alone
where pages have no such elements. An element around the page's article or main heading is never boilerplate, whatever its name.

Defined results: null, empty or text-only html is handled (text outside of any tag is a block); unclosed comments, scripts
and tags end with the page; elements nested deeper than DEPTH belong to the one at that depth; repeated rows repeat their
result; null page_id or url stay null; an empty table gives an empty result; extra columns are ignored, whatever their names.
Every page is worked on whole, in time and memory that grow with its length alone; rows are independent, so nothing is shuffled
but the sample.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K
from barwright.llm.sampling import smallest

# Element names by their role in HTML.
RAW = {"script", "style", "noscript", "title", "textarea", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "dt", "dd", "td", "th", "option", "label", "legend", "summary"}
# Evidence of an element for (above zero) or against (below) content.
TAG_EVIDENCE = {
    "article": 3.0, "main": 2.0, "nav": -4.5, "footer": -4.5, "aside": -4.5, "form": -4.5, "header": -4.0, "button": -4.5, "menu": -4.5, "dialog": -4.5, "select": -4.5, "template": -6.0, "svg": -4.5,
    "object": -4.0, "canvas": -4.0, "audio": -4.0, "video": -4.0,
}
ROLE_EVIDENCE = {"main": 2.0, "article": 3.0, "navigation": -4.5, "banner": -4.0, "complementary": -4.5, "contentinfo": -4.5, "search": -4.5, "dialog": -4.5, "alertdialog": -4.5, "alert": -4.5, "menu": -4.5, "menubar": -4.5, "toolbar": -4.5}
NAME_EVIDENCE, GOOD_EVIDENCE, HIDDEN_EVIDENCE = -4.5, 1.5, -6.0
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "warning", "widget",
}
GOOD_NAMES = {"article", "content", "entry", "post", "story", "main", "body"}
UNSAID = {"has", "with", "no", "not", "without"}  # what follows in a name is not the element itself
# The text model: what it sees of a block, and the weights that hold without any sample.
FEATURES = ("bias", "length", "links", "ends", "heading", "item", "capitals", "short")
WEIGHTS = (0.2, 0.3, -4.0, 0.4, 0.5, -0.4, -0.3, 0.3)
LINK_WORDS = 8  # links of more words count less, as menus have short ones
MOST = 2.5  # bound of the text model's odds
RIDGE = 50.0  # how strongly weights are drawn towards WEIGHTS
SAMPLE = 2000  # pages, at most, on which the text model is fitted
DEPTH = 512
NEAR, KIN, DECAY, BORDER = 1.0, 0.5, 0.35, 0.3  # smoothness: neighbours with one parent, blocks under one parent, its decay by distance, share left across borders

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")
_ENDS = tuple(".!?…:;。！？\"”»)")


class Page:
    """Elements of a page (parent, tag, evidence) and its blocks (text, element, share of link text). Element 0 is the page."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.own, self.depth = [0], [""], [0.0], [0]
        self.text: list[str] = []
        self.at: list[int] = []
        self.links: list[float] = []
        _Reader(self, page)
        self._judge()

    def _judge(self) -> None:
        """Evidence of the elements, those around the page's main part left out, and of each block's surroundings."""
        n = len(self.parent)
        anchors = [e for e in range(n) if self.tag[e] in ("article", "main") and self.own[e] > 0]
        anchors = anchors or [e for e in range(n) if self.tag[e] == "h1"]
        around = bytearray(n)
        for e in anchors:
            e = self.parent[e]
            while e and not around[e]:
                around[e] = 1
                e = self.parent[e]
        self.against, self.speaks = [0.0] * n, [0.0] * n
        in_article = bytearray(n)
        for e in range(1, n):
            p, own = self.parent[e], self.own[e]
            if own < 0 and (around[e] or self.tag[e] == "header" and in_article[p]):
                own = self.own[e] = 0.0  # it holds the main part, or is the head of an article
            in_article[e] = in_article[p] or self.tag[e] in ("article", "main")
            self.against[e], self.speaks[e] = min(self.against[p], own), max(self.speaks[p], own)

    def evidence(self, e: int) -> float:
        """Evidence against content counts whole, evidence for it half where there is some against it."""
        return self.against[e] + self.speaks[e] / 2 if self.against[e] < 0 else self.speaks[e]

    def features(self) -> np.ndarray:
        out = np.zeros((len(self.text), len(FEATURES)))
        for i, (text, e, links) in enumerate(zip(self.text, self.at, self.links, strict=True)):
            words = text.split(" ")
            n, tag = len(words), self.tag[e]
            out[i] = (1.0, min(7.0, math.log2(1 + n)), links * min(1.0, LINK_WORDS / n), text.endswith(_ENDS), tag in HEADINGS, tag in ITEMS, sum(w[:1].isupper() for w in words) / n, sum(len(w) < 4 and w.islower() for w in words) / n)
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness edges: neighbours, and each block with the last earlier one under the same parent."""
        out, last = [], {}
        for i, e in enumerate(self.at):
            if i:
                weight = self._closeness(self.at[i - 1], e)
                if weight > 0:
                    out.append((i - 1, i, NEAR * weight))
            parent = self.parent[e]
            if last.get(parent, i - 1) != i - 1:
                out.append((last[parent], i, KIN))
            last[parent] = i
        return out

    def _closeness(self, a: int, b: int) -> float:
        steps, border = 0, False
        while a != b:
            if steps > 12:
                return 0.0
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            border |= self.own[a] != 0
            a = self.parent[a]
            steps += 1
        return DECAY ** max(0, steps - 2) * (BORDER if border else 1.0)


def _evidence(tag: str, attrs: str) -> float:
    own = TAG_EVIDENCE.get(tag, 0.0)
    if not attrs or attrs.isspace() or tag in ("body", "html"):
        return own
    if _HIDDEN.search(attrs):
        return HIDDEN_EVIDENCE
    for m in _NAME.finditer(attrs):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            own = ROLE_EVIDENCE.get(value.strip(), own)
            continue
        for name in value.split():
            words = _WORDS.findall(name)
            cut = next((i for i, w in enumerate(words) if w in UNSAID), len(words))
            found = set(words[:cut])
            if found & NAMES and tag != "main":
                own = min(own, NAME_EVIDENCE)
            elif found & GOOD_NAMES and tag in ("div", "section", "td") and own >= 0:
                own = max(own, GOOD_EVIDENCE)
    return own


class _Reader:
    """One pass over a page's markup. Scans of open elements are bounded by DEPTH."""

    def __init__(self, out: Page, page: str) -> None:
        self.out, self.stack = out, []  # of (tag, element, is a link); inline elements have their parent's element
        self.open: Counter[str] = Counter()
        self.deep: Counter[str] = Counter()  # open elements below DEPTH
        self.parts: list[str] = []
        self.said = self.linked = self.inside = 0
        pos, n = 0, len(page)
        while pos < n:
            m = _TAG.search(page, pos)
            if not m:
                self.say(page[pos:])
                break
            if m.start() > pos:
                self.say(page[pos : m.start()])
            pos = m.end()
            tag, attrs, ends = (m[2], m[3], m[1]) if m[2] else (m[5], m[6], m[4])
            if tag:
                pos = self.read(page, pos, tag.lower(), attrs or "", bool(ends))
        self.flush()

    def read(self, page: str, pos: int, tag: str, attrs: str, ends: bool) -> int:
        if ends:
            if self.deep[tag]:
                self.deep[tag] -= 1
            elif self.open[tag]:
                self.close(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))
            elif tag not in INLINE:
                self.flush()
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            return end.end() if end else len(page)
        elif tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
        else:
            self.start(tag, attrs)
        return pos

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:  # an open p ends here, unless another scope lies between
            self.end_open("p", SCOPES)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.end_open(tag, SCOPES | {"ul", "ol", "dl"} if tag != "tr" else SCOPES - {"td", "th"})
        inline = tag in INLINE
        if not inline:
            self.flush()
        if attrs.endswith("/"):
            return
        if len(self.stack) >= DEPTH:
            self.deep[tag] += 1
            return
        here = self.stack[-1][1] if self.stack else 0
        if not inline or _HIDDEN.search(attrs):
            out = self.out
            out.parent.append(here)
            out.tag.append(tag)
            out.own.append(_evidence(tag, attrs))
            out.depth.append(out.depth[here] + 1)
            here = len(out.parent) - 1
        link = tag == "a" and bool(_HREF.search(attrs))
        self.stack.append((tag, here, link))
        self.open[tag] += 1
        self.inside += link

    def end_open(self, tag: str, scopes: set[str]) -> None:
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self.close(i)
                    return
                if self.stack[i][0] in scopes:
                    return

    def close(self, at: int) -> None:
        gone = self.stack[at:]
        if any(t not in INLINE for t, _, _ in gone):
            self.flush()
        for t, _, link in gone:
            self.open[t] -= 1
            self.inside -= link
        del self.stack[at:]

    def say(self, text: str) -> None:
        text = html_module.unescape(text) if "&" in text else text
        self.parts.append(text)
        if not text.isspace():
            self.said += len(text)
            self.linked += len(text) if self.inside else 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.text.append(text)
                self.out.at.append(self.stack[-1][1] if self.stack else 0)
                self.out.links.append(self.linked / max(self.said, 1))
            self.parts.clear()
        self.said = self.linked = 0


def minimum_cut(odds: Sequence[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side (content) of a minimum cut; odds > 0: capacity from the source, else to the sink.

    Maximum flow by blocking flows on shortest paths. Edges are weak beside the odds, so flow goes a few steps only, and the
    number of rounds, each linear in the nodes, doesn't grow with the page.
    """
    n, eps = len(odds), 1e-9
    source, sink = [max(float(o), 0.0) for o in odds], [max(-float(o), 0.0) for o in odds]
    to: list[list[int]] = [[] for _ in range(n)]  # edge ids; edge i and i ^ 1 are one edge's directions
    head, room = [], []
    for a, b, w in joined:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += (b, a)
        room += (w, w)
    while True:
        level = [-1] * n
        reached = [i for i in range(n) if source[i] > eps]
        for i in reached:
            level[i] = 0
        ends = False
        for i in reached:  # grows as it is read
            for k in to[i]:
                j = head[k]
                if room[k] > eps and level[j] < 0:
                    level[j] = level[i] + 1
                    ends |= sink[j] > eps
                    reached.append(j)
        if not ends:
            return [x >= 0 for x in level]
        nth = [0] * n
        for first in range(n):
            while source[first] > eps and level[first] == 0:
                path, i = [], first
                while sink[i] <= eps or not path:
                    while nth[i] < len(to[i]) and not (room[to[i][nth[i]]] > eps and level[head[to[i][nth[i]]]] == level[i] + 1):
                        nth[i] += 1
                    if nth[i] < len(to[i]):
                        path.append(to[i][nth[i]])
                        i = head[path[-1]]
                        continue
                    if not path:
                        break
                    back = path.pop()
                    i = head[back ^ 1]
                    nth[i] += 1
                if not path:
                    break
                flow = min(source[first], sink[i], *(room[k] for k in path))
                source[first] -= flow
                sink[i] -= flow
                for k in path:
                    room[k] -= flow
                    room[k ^ 1] += flow


def block_odds(page: Page, weights: Sequence[float] = WEIGHTS) -> np.ndarray:
    text = np.clip(page.features() @ np.asarray(weights), -MOST, MOST)
    return text + np.array([page.evidence(e) for e in page.at], float) if len(text) else text


def labels(page: Page, weights: Sequence[float] = WEIGHTS) -> list[bool]:
    return minimum_cut(block_odds(page, weights).tolist(), page.edges())


def main_text(page: str | None, weights: Sequence[float] = WEIGHTS) -> str:
    found = Page(page or "")
    return "\n".join(t for t, k in zip(found.text, labels(found, weights), strict=True) if k)


# -- the text model -----------------------------------------------------------------------------------------------------


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted feature vectors of the blocks whose elements speak clearly for or against content."""
    for batch in K.slices(batches, "html"):
        seen: Counter[tuple] = Counter()
        for html in batch.column(0).to_pylist():
            page = Page(html or "")
            for e, row in zip(page.at, page.features().round(1).tolist(), strict=True):
                tags = _semantic(page, e)
                if tags:
                    seen[(*row, tags > 0)] += 1
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(r[:-1]) for r in rows], pa.list_(pa.float64())), pa.array([int(r[-1]) for r in rows], pa.int64()), pa.array([seen[r] for r in rows], pa.int64())], ["x", "y", "n"])


def _semantic(page: Page, e: int) -> int:
    """1 in an article or main element and nothing against it, -1 in one of the elements for boilerplate, 0 otherwise."""
    if page.against[e] == 0:
        while e:
            if page.tag[e] in ("article", "main"):
                return 1
            e = page.parent[e]
        return 0
    while e:
        if page.tag[e] in ("nav", "aside", "footer", "form", "header") and page.own[e] < 0:
            return -1
        e = page.parent[e]
    return 0


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Logistic regression, the two classes weighted alike, with a ridge towards WEIGHTS; WEIGHTS where one class is missing."""
    prior = np.array(WEIGHTS)
    if not len(y) or y.min() == y.max():
        return WEIGHTS
    n = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / n[y == 0].sum()) * min(n.sum(), 1000)
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + RIDGE * np.eye(len(beta)), x.T @ (n * (y - p)) - RIDGE * (beta - prior))
        beta = beta + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(pages: DataFrame, sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights of the text model from at most `sample` pages, the smallest by hash. Values are rounded to a tenth and counted, so
    what comes to the driver is bounded by the sample."""
    rows = pages.select(F.col("html").cast("string").alias("html"))
    key = F.xxhash64("html", F.lit(5))
    chosen = smallest(rows.select(key.alias("h")).distinct(), F.col("h"), sample)  # hashes only: pages can be long
    once = rows.withColumn("h", key).join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("html").alias("html"))
    got = once.select("html").mapInArrow(K.tidy(_lessons), "x array<double>, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("x", "y").collect()
    return fit_weights(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), np.array([r["n"] for r in got], float))


def _extract(weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "html"):
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page. weights: those of the text model; fitted on a sample unless given."""
    weights = learn(pages) if weights is None else weights
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(K.tidy(_extract(weights)), "page_id long, url string, text string, n_chars long")
