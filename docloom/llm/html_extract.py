"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks. A linear classifier on a block's text, links, element and the names around it gives
log-odds of being content; elements that say what they hold (article, nav and the like) add stated ones. The log-odds
are the costs of dropping or of keeping a block: capacities from the source and to the sink. Neighbouring blocks are
tied by smoothness edges, the more the closer they are in the document tree, and so are the blocks of one parent. The
source side of a minimum cut is the content. Inside an article all blocks are content (tables, lists of links, short
lines) but those of elements, roles and classes that are chrome by themselves; names that may as well be topics, and ids
of sections, which are targets of links, don't count there. A page is read in time linear in its length.

The classifier's weights are fitted on the blocks of at most ``SAMPLE_PAGES`` pages (those with the lowest hashes of
their ids), whose labels come from elements that say what they hold; these elements are no features, so the weights are
those of text, links and form alone. They are drawn towards stated weights, which stand for names of classes and ids
that the sample has no label for. With no labelled block the stated weights are used.

A null or empty page gives an empty text; broken markup is read as far as it goes; repeated rows are independent;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkernel as K
from docloom.llm.tables import table

# Kinds of elements, and words in names of classes and ids.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg canvas iframe object audio video math title select textarea button map datalist".split())
CHROME = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
PROSE = frozenset("p blockquote pre figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("li td th dd dt option".split())
BAD = frozenset("""nav navbar navigation topnav menu menus submenu sidebar sidebars footer footers header headers masthead banner banners cookie cookies consent notice notices notification notifications
alert alerts gdpr ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion comment comments commentlist commenting discussion disqus
reply replies respond responses reaction reactions share sharing shares social related recommended recommendation recommendations trending popular breadcrumb breadcrumbs crumbs pagination pager paging
subscribe subscription newsletter signup signin login popup modal overlay widget widgets toolbar tags copyright legal search skip hidden form forms feedback""".split())
GOOD = frozenset("article post entry story main content body text prose markdown".split())
CARRIER = frozenset("list lists container wrapper wrap inner outer box boxes area block blocks section item items link links bar slot unit content body text title row col column panel group holder zone btn button buttons main left right top bottom primary secondary sticky mobile desktop global site page".split())
TEASER = frozenset("related recommended recommendation recommendations sponsored sponsor popular trending promoted".split())
#: What such a teaser is made of, and the names that mark chrome inside an article, too.
TEASED = frozenset("post posts article articles story stories news read reading reads product products page pages topic topics video videos".split())
STRONG = frozenset("""nav navbar navigation topnav menu menus submenu sidebar sidebars footer footers banner banners cookie cookies consent gdpr notice notices notification notifications
ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion comment comments commentlist commenting disqus
share sharing shares related recommended recommendation recommendations breadcrumb breadcrumbs pagination pager paging subscribe subscription newsletter signup signin login popup modal overlay""".split())
# Stated log-odds of elements, and how far the fitted part may go. Neighbours can't outweigh what an article says.
IN_ARTICLE, IN_CHROME, FITTED_UP_TO = 8.0, -8.0, 3.0
NEAR, CLOSE, SIBLING = 0.4, 1.2, 0.4
SAMPLE_PAGES, SAMPLE_BLOCKS, BATCH_BYTES = 400, 200, 4 << 20
FEATURES = ("bias", "length", "linked", "stops", "sentence", "prose", "heading", "cell", "few_words", "rights", "bad_name", "good_name")
STATED = np.array([-0.5, 1.2, -3.0, 0.5, 0.8, 0.8, 0.4, -0.3, -0.5, -3.0, -6.0, 1.0])
DRAWN = np.array([0.02, 0.02, 0.02, 0.02, 0.02, 0.02, 0.05, 0.05, 0.02, 0.05, 1.0, 0.05])


def _heads(name: str) -> tuple[list[str], list[str]]:
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
    return parts, [p for p in parts if p not in CARRIER]


def name_kind(name: str) -> int:
    """-1 for a class or id that names what surrounds an article, 1 for one that names the article, else 0.

    The last word that isn't a mere carrier decides (``comment-list``, ``site-header``, but not ``search-algorithms``),
    or a first one that marks a teaser (``related-posts``, but not ``popular-science``); the header of a post is a part of it.
    """
    parts, heads = _heads(name)
    if not heads:
        return int(any(p in GOOD for p in parts))
    if heads[0] in TEASER and all(p in TEASED or p in TEASER for p in heads[1:]):
        return -1
    if heads[-1] in BAD:
        return 0 if heads[-1] in ("header", "headers") and any(p in GOOD or p in ("page", "section", "title") for p in parts) else -1
    return int(heads[-1] in GOOD)


def chrome_anywhere(name: str) -> bool:
    """Whether a name of kind -1 marks chrome inside an article as well."""
    _, heads = _heads(name)
    return bool(heads) and (heads[-1] in STRONG or heads[0] in STRONG & TEASER) and name_kind(name) < 0


class Open(NamedTuple):
    """An open element with what holds inside it; ``block``, ``parent``, ``kind`` and ``depth`` are of the nearest block element."""

    tag: str
    unseen: bool
    article: int
    chrome: int
    bad: int
    strong: int
    good: int
    kind: str
    block: int
    parent: int
    depth: int


#: End tags of other elements don't reach beyond one of these; some close whatever stands in between.
FLOORS = ("article", "main", "body", "table", "nav", "footer", "aside")
CLOSES_ALL = frozenset("article main body html nav footer aside div section".split())
ROOT = Open("", False, 0, 0, 0, 0, 0, "", 0, 0, 0)
Block = tuple[str, list[float], float, int | None, tuple[int, int, int]]


class Reader(HTMLParser):
    """Collects blocks: (text, features, stated log-odds, label or None, place in the tree).

    A place is the depth, the depth shared with the block before, and the parent's number. For each tag the places of
    its open elements are known, so that an end tag without a start costs nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.unseen, self.number, self.links, self.lowest = 0, 0, 0, 0
        self.endless, self.scanned, self.last_end = False, "", -1
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def top(self) -> Open:
        return self.stack[-1] if self.stack else ROOT

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            e = self.top()
            bad = e.strong if e.article else e.bad
            words = text.count(" ") + 1
            stops = sum(map(text.count, ".,;:!?")) / words
            rights = len(text) < 160 and ("©" in text or text.lower().startswith(("copyright", "all rights")))
            found = [1.0, min(2.0, math.log1p(len(text)) / 3), min(1.0, self.linked / len(text)), min(1.0, 4 * stops), text[-1] in ".!?…:\"'”»)", e.kind in PROSE, e.kind in HEADINGS, e.kind in CELLS, words < 5, rights, bad > 0, e.good > 0 and not bad]
            label = 0 if e.chrome else 1 if e.article and not bad else None
            stated = IN_CHROME if e.chrome or e.article and bad else IN_ARTICLE if e.article else 0.0
            self.blocks.append((text, [float(x) for x in found], stated, label, (e.depth, min(self.lowest, e.depth), e.parent)))
            self.lowest = e.depth
        self.parts, self.linked = [], 0

    def enter(self, e: Open) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)
        self.unseen += e.unseen
        self.links += e.tag == "a"

    def leave(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.places[e.tag].pop()
            self.unseen -= e.unseen
            self.links -= e.tag == "a"
        self.lowest = min(self.lowest, self.top().depth)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in UNSEEN:
                return
            self.parts.append(" ") if tag == "br" else None
            if tag == "hr":
                self.flush()
            return
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "aria-hidden")} if attrs else {}
        gone = tag in UNSEEN or named and ( "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", ""))
        if not gone and tag not in INLINE and not self.unseen:
            self.flush()
            if self.places.get("p") and self.places["p"][-1] >= len(self.stack) - 6:
                self.leave(self.places["p"][-1])
            if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and self.top().tag == tag:
                self.leave(len(self.stack) - 1)
        up = self.top()
        role = named.get("role", "")
        article, chrome = up.article, up.chrome
        if tag in ("article", "main") or role in ("main", "article"):
            article += 1
        elif tag in CHROME or tag == "header" and not article or role in ROLES:
            chrome += 1
        bad, strong, good = up.bad, up.strong, up.good
        classes = named.get("class", "").split()
        ids = [] if tag in PROSE or tag in HEADINGS else named.get("id", "").split()
        if (classes or ids) and tag not in ("html", "body"):
            kinds = [name_kind(x) for x in classes + ids]
            bad, good = bad + (min(kinds) < 0), good + (max(kinds) > 0)
            strong += bad > up.bad and any(map(chrome_anywhere, classes + (ids if tag != "section" or not up.article else [])))
        self.number += 1
        own = (up.kind, up.block, up.parent, up.depth) if tag in INLINE else (tag, self.number, up.block, up.depth + 1)
        self.enter(Open(tag, bool(gone), article, chrome, bad, strong, good, *own))

    def parse_comment(self, i, report=1):
        """As the parser does, but a search for an end that isn't there is made once."""
        if self.endless:
            return -1
        k = HTMLParser.parse_comment(self, i, report)
        self.endless = k < 0
        return k

    def check_for_whole_start_tag(self, i):
        """As the parser does, but nothing is scanned behind the last end of a tag."""
        if self.scanned is not self.rawdata:
            self.scanned, self.last_end = self.rawdata, self.rawdata.rfind(">")
        return HTMLParser.check_for_whole_start_tag(self, i) if i < self.last_end else -1

    def finish(self):
        HTMLParser.close(self)
        self.flush()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE and not self.unseen:
            self.flush()
        if self.places.get(tag):
            own = self.places[tag][-1]
            if tag in CLOSES_ALL or own >= max((self.places[t][-1] for t in FLOORS if self.places.get(t)), default=-1):
                self.leave(own)

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def read(html: str | None) -> list[Block]:
    reader = Reader()
    reader.feed(html or "")
    reader.finish()
    return reader.blocks


def min_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source side: each pays |score| on the wrong side, each cut edge its capacity.

    Nodes whose own score outweighs all their edges are settled first. Flow goes from each source along shortest paths
    to the nearest free sink; what a source reaches when it finds none is on its side for good and is not entered again.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    kept: list[bool | None] = [None] * n
    pull = list(scores)
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if kept[i] is None and abs(pull[i]) >= sum(near[i].values()):
            kept[i] = pull[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                pull[j] += c if kept[i] else -c
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if kept[i] is None]
    spare = {i: max(0.0, -pull[i]) for i in left}
    for source in left:
        supply = max(0.0, pull[source])
        while supply > 1e-12 and kept[source] is None:
            before, queue, end = {source: -1}, deque([source]), -1
            while queue and end < 0:
                i = queue.popleft()
                if spare[i] > 1e-12:
                    end = i
                    break
                for j, c in near[i].items():
                    if c > 1e-12 and j not in before and kept[j] is None:
                        before[j] = i
                        queue.append(j)
            if end < 0:
                for i in before:
                    kept[i] = True
                break
            path = [end]
            while before[path[-1]] != -1:
                path.append(before[path[-1]])
            flow = min(spare[end], supply, *(near[b][a] for a, b in zip(path, path[1:], strict=False)))
            spare[end] -= flow
            supply -= flow
            for a, b in zip(path, path[1:], strict=False):
                near[b][a] -= flow
                near[a][b] += flow
    return [bool(k) for k in kept]


def ties(places: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """Smoothness edges of blocks by their places in the document tree."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, (depth, common, parent) in enumerate(places):
        if k:
            edges[k - 1, k] = NEAR + CLOSE / (1 + max(0, depth + places[k - 1][0] - 2 * common - 2))
        if parent in last:
            edges[last[parent], k] = edges.get((last[parent], k), 0.0) + SIBLING
        last[parent] = k
    return edges


def costs(blocks: list, weights: np.ndarray) -> list[float]:
    """Log-odds of content of each block; names of classes and ids count beside what is fitted to the text."""
    if not blocks:
        return []
    x = np.array([b[1] for b in blocks])
    named = [FEATURES.index("bad_name"), FEATURES.index("good_name")]
    own = np.delete(x, named, 1) @ np.delete(weights, named)
    return (np.clip(own, -FITTED_UP_TO, FITTED_UP_TO) + x[:, named] @ weights[named] + np.array([b[2] for b in blocks])).tolist()


def extract(html: str | None, weights: np.ndarray = STATED) -> str:
    blocks = read(html)
    kept = min_cut(costs(blocks, weights), ties([b[4] for b in blocks]))
    return " ".join(b[0] for b, keep in zip(blocks, kept, strict=True) if keep)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights, both labels of equal weight, drawn towards the stated ones (Newton steps)."""
    if len(set(y.tolist())) < 2:
        return STATED
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = STATED.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + DRAWN * (w - STATED)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(DRAWN)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights from the labelled blocks of the sample, at most ``SAMPLE_BLOCKS`` of a page, evenly spread over it."""
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    rows = pages.join(F.broadcast(chosen), "page_id", "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0):
                found = [(b[3], b[1]) for b in read(page.as_py()) if b[3] is not None]
                found = found[:: max(1, -(-len(found) // SAMPLE_BLOCKS))]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["y", "x"])

    got = sorted((r.y, r.x) for r in rows.mapInArrow(run, "y int, x array<double>").collect())
    return fit(np.array([x for _, x in got]).reshape(-1, len(FEATURES)), np.array([y for y, _ in got], np.int64))


def extract_pages(pages: DataFrame, weights: np.ndarray = STATED) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in K.text_slices(batch.column(2), BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = [extract(h.as_py(), weights) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract_pages(pages, train(pages))
