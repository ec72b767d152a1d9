"""Main text of web pages, by a minimum cut through their blocks.

A block is the text between two block-level tags. Its costs are a log odds: what the tags and the names of
the elements around it say, and a logistic model of its form (kind of tag, share of linked text, words, end of a
sentence). The model is fitted to counts over all pages, from the blocks that elements like article and nav
decide. Costs become capacities to the two terminals, neighbours in the page and in the same element are joined by
capacities that fall with their distance in the tree, and the minimum cut separates content from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a tag with quoted values, or another declaration.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+[a-z]*")

# What HTML's elements and the usual names of page parts mean.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea select button template noscript iframe object svg math canvas audio video noembed noframes xmp".split())
APART = frozenset("nav footer aside form menu dialog fieldset header search".split())
WITHIN = frozenset("article main".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
BOUNDS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
COMMENTS = frozenset("comment comments commentlist commenter reply replies respond disqus discussion".split())
BOILERPLATE = COMMENTS | frozenset(
    """ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion outbrain taboola
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap header masthead footer footnav sidebar aside rail widget
    cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe subscription signup login signin register paywall donate
    share sharing social related recommended recommendations teaser trending popular toolbar search form poll rating copyright legal disclaimer imprint skip
    contentinfo complementary""".split()
)
CONTENT = frozenset("article main content post entry story articlebody maintext".split())

KINDS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "dt": 2, "dd": 2, "td": 3, "th": 3, "blockquote": 4, "pre": 4}
OTHER = 5
#: Upper ends of bins: share of linked characters, words.
LINKED, WORDS = (0.01, 0.25, 0.6), (2, 6, 15, 40)
SIZES = (OTHER + 1, len(LINKED) + 1, len(WORDS) + 1, 2)
FORMS = int(np.prod(SIZES))
#: Log odds that elements around a block give, and the most that its form gives.
AROUND, FORM = {1: 4.0, 0: 0.0, -1: -8.0}, 3.0
#: Capacity between neighbours one step apart.
SMOOTH = 0.7
#: What a form is taken for before any page is seen: by kind, linked share, words, end of a sentence.
PRIOR = np.array([1.0, 0.5, -0.5, -0.5, 1.0, 0.0] + [0.5, 0.0, -1.5, -3.0] + [-0.5, 0.0, 0.5, 1.0, 1.5] + [0.0, 0.5])


@lru_cache(1 << 14)
def _named(tag: str, attributes: str) -> tuple[int, str]:
    """1 for an element of content, -1 for one of boilerplate, 0 for others; "firm" if it is one of comments or hidden, which nothing inside revokes, "head" if just a header."""
    names = set()
    for m in _NAMES.finditer(attributes):
        for part in _PARTS.findall(m[m.lastindex]):
            names.add(part.lower())
        names.update(re.findall(r"[a-z]+", m[m.lastindex].lower()))
    if tag in ("html", "body"):
        return 0, ""
    if _HIDDEN.search(attributes) or names & COMMENTS:
        return -1, "firm"
    if apart := (names & BOILERPLATE) | (APART & {tag}):
        return -1, "head" if apart == {"header"} else ""
    return int(tag in WITHIN or bool(names & CONTENT)), ""


class _Page:
    """Blocks of a page with their texts, forms, elements around them, and edges."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.forms: list[int] = []
        self.edges: list[tuple[int, int, float]] = []
        self._around: list[int] = []  # node of each block
        #: Of each node: its parent, its tag, what its name says and how, whether main text is in it.
        self._parent, self._tag, self._says, self._how, self._holds = [-1], [""], [0], [""], [False]
        self._open = [0]
        self._pieces: list[tuple[str, bool]] = []
        self._links = 0
        self._lowest, self._last_depth = 1, 1
        self._siblings: dict[int, int] = {}
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            self._text(html[at : m.start() if m else n])
            if m is None:
                break
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(tag)
            elif tag in SKIPPED:
                if tag not in INLINE and tag not in ("button", "noscript", "svg", "math"):
                    self._end_block()
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n if tag in ("script", "style", "title", "textarea") else at
            else:
                self._start(tag, m[3] if m[2] else m[6])
        self._end_block()

    def _text(self, raw: str) -> None:
        if raw:
            self._pieces.append((raw, self._links > 0))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._links = 1  # links do not nest
            elif tag == "br":
                self._pieces.append((" ", self._links > 0))
            return
        self._end_block()
        if tag in VOID:
            return
        if self._tag[self._open[-1]] == "p" or tag in CLOSES:
            closes, bounds = CLOSES.get(tag, frozenset()), BOUNDS.get(tag, frozenset())
            while len(self._open) > 1 and (self._tag[self._open[-1]] == "p" or any(self._tag[x] in closes for x in self._above(bounds))):
                self._pop()
        says, how = _named(tag, attributes)
        parent, node = self._open[-1], len(self._parent)
        self._parent.append(parent)
        self._tag.append(tag)
        self._says.append(says)
        self._how.append(how)
        self._holds.append(False)
        self._open.append(node)
        if says >= 0 and (tag in WITHIN or tag == "h1"):
            if any(self._how[x] == "firm" for x in self._open):
                return  # nothing there counts as main text
            for x in self._open[:-1]:
                if not (tag == "h1" and (self._how[x] == "head" or self._tag[x] in ("nav", "footer", "aside"))):
                    self._holds[x] = True

    def _above(self, bounds: frozenset[str]) -> Iterator[int]:
        """Open elements from the innermost up to one of ``bounds``."""
        for x in reversed(self._open[1:]):
            if self._tag[x] in bounds:
                return
            yield x

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._links = 0
            return
        self._end_block()
        if any(self._tag[x] == tag for x in self._open[1:]):
            while self._tag[self._open[-1]] != tag:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        self._open.pop()
        self._lowest = min(self._lowest, len(self._open))
        self._links = 0

    def _end_block(self) -> None:
        if not self._pieces:
            return
        pieces, self._pieces = self._pieces, []
        text = " ".join(unescape("".join(p for p, _ in pieces)).split())
        if not text:
            return
        linked = sum(len(p) for p, link in pieces if link) / max(1, sum(len(p) for p, _ in pieces))
        node, depth, i = self._open[-1], len(self._open), len(self.texts)
        form = (KINDS.get(self._tag[node], OTHER), sum(linked >= x for x in LINKED), sum(text.count(" ") + 1 > x for x in WORDS), int(text[-1] in ".!?…。！？:;\"'”»"))
        self.texts.append(text)
        self.forms.append(((form[0] * SIZES[1] + form[1]) * SIZES[2] + form[2]) * SIZES[3] + form[3])
        self._around.append(node)
        if i:
            self.edges.append((i - 1, i, SMOOTH / max(1, self._last_depth + depth - 2 * self._lowest)))
        holder = self._parent[node] if self._tag[node] in KINDS else node
        if self._siblings.get(holder, i - 1) != i - 1:
            self.edges.append((self._siblings[holder], i, SMOOTH / 2))
        self._siblings[holder] = i
        self._last_depth = self._lowest = depth

    def around(self) -> list[int]:
        """What the elements around each block say: -1 if any is of boilerplate, else 1 if any is of content, else 0."""
        said = [0] * len(self._parent)
        within = [False] * len(self._parent)  # whether an element of content is around
        for x in range(1, len(said)):
            up = self._parent[x]
            within[x] = within[up] or self._says[x] > 0
            own = self._says[x]
            if own < 0 and self._how[x] != "firm" and (self._holds[x] or (self._how[x] == "head" and within[up])):
                own = 0  # it wraps the main text, or is an article's own head
            said[x] = -1 if -1 in (own, said[up]) else max(own, said[up])
        return [said[x] for x in self._around]


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the side of positive odds in a minimum cut; ties go to that side.

    A cut pays ``abs(odds)`` for each node on the side against its sign, and its capacity for each edge between the sides.
    """
    n = len(odds)
    left = [round(x * 1_000_000) for x in odds]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0) + round(w * 1_000_000)
    # a node whose odds outweigh all its edges keeps its side in every minimum cut; its edges then count for its neighbours
    side: list[bool | None] = [None] * n
    ready = list(range(n))
    while ready:
        x = ready.pop()
        if side[x] is None and abs(left[x]) > sum(near[x].values()):
            side[x] = left[x] > 0
            for y, w in near[x].items():
                left[y] += w if side[x] else -w
                near[y].pop(x)
                if side[y] is None:
                    ready.append(y)
            near[x] = {}
    rest = [x for x in range(n) if side[x] is None]
    if rest:
        _flow(rest, left, near, side)
    return [bool(x) for x in side]


def _flow(rest: list[int], left: list[int], near: list[dict[int, int]], side: list[bool | None]) -> None:
    """Maximum flow by shortest augmenting levels; sides by what still reaches the sink."""
    number = {x: i + 2 for i, x in enumerate(rest)}
    head: list[list[int]] = [[] for _ in range(len(rest) + 2)]
    to, cap = [], []

    def link(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for x in rest:
        if left[x] > 0:
            link(0, number[x], left[x], 0)
        elif left[x] < 0:
            link(number[x], 1, -left[x], 0)
        for y, w in near[x].items():
            if x < y:
                link(number[x], number[y], w, w)
    while True:
        level = [-1] * len(head)
        level[0], queue = 0, [0]
        for a in queue:
            for e in head[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[1] < 0:
            break
        turn, path, a = [0] * len(head), [], 0
        while True:
            if a == 1:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                first = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[first] ^ 1]
                del path[first:]
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(head[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break
    reaches, queue = [False] * len(head), [1]
    reaches[1] = True
    for b in queue:
        for e in head[b]:
            if cap[e ^ 1] and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    for x in rest:
        side[x] = not reaches[number[x]]


def _one_hot() -> np.ndarray:
    """[form, column]: the four bins of each form, the kind of other tags without a column's weight."""
    out = np.zeros((FORMS, len(PRIOR)))
    for form in range(FORMS):
        base = 0
        for bin_, size in zip(np.unravel_index(form, SIZES), SIZES):
            if base or bin_ != OTHER:
                out[form, base + bin_] = 1
            base += size
    return out


def fit_forms(counts: np.ndarray, ridge: float = 10.0, steps: int = 30) -> np.ndarray:
    """Log odds of each form from its counts of (boilerplate, content) blocks: logistic, drawn to ``PRIOR``; Newton's steps."""
    x, prior = _one_hot(), np.append(PRIOR, 0.0)
    x = np.hstack([x, np.ones((FORMS, 1))])
    w, many = prior.copy(), counts.sum(axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (counts[:, 1] - many * p) - ridge * (w - prior)
        step = np.linalg.solve((x * (many * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return np.clip(np.round(x @ w, 9), -FORM, FORM)


def page_text(html: str | None, forms: np.ndarray) -> str:
    """The content blocks of a page, one a line."""
    page = _Page(html or "")
    odds = [AROUND[a] + float(forms[f]) for a, f in zip(page.around(), page.forms)]
    return "\n".join(t for t, keep in zip(page.texts, minimum_cut(odds, page.edges)) if keep)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((FORMS, 2), np.int64)
    for batch in batches:
        for html in batch.column(0).to_pylist():
            page = _Page(html or "")
            for around, form in zip(page.around(), page.forms):
                if around:
                    counts[form, (around + 1) // 2] += 1
    form, label = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(form, pa.int32()), pa.array(label, pa.int32()), pa.array(counts[form, label], pa.int64())], ["form", "label", "many"])


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text: the main text of each page, one line a block; empty if there is none.

    Boilerplate is what stands in elements of navigation, headers (but an article's own), footers, asides, forms and
    dialogs, in elements named like adverts, notices, menus, sidebars or reader comments, hidden elements, scripts,
    styles and form controls; what no element decides is left to its form and its neighbours. An element that
    holds the article itself is no boilerplate because of its name. Character references are decoded, white space in
    a block (also that of br and no-break spaces) becomes one space. Unclosed paragraphs, list items and cells end
    where HTML ends them; other unclosed tags at the end of what holds them.

    The model's counts cover all pages. Null or empty html gives an empty text; each row is judged by itself, so
    repeated rows and null ids give a row each. A very long page is held whole by its task. An empty table gives
    no rows; other columns are ignored.
    """
    counts = np.zeros((FORMS, 2))
    seen = pages.select(F.col(html).alias("body")).mapInArrow(_count, "form int, label int, many long")
    for r in seen.groupBy("form", "label").agg(F.sum("many").alias("many")).collect():  # at most one row a form and label
        counts[r.form, r.label] = r.many
    forms = fit_forms(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h, forms) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["own_id", "own_url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    slim = pages.select(F.col(page_id).alias("own_id"), F.col(url).alias("own_url"), F.col(html).alias("body"))
    out = slim.mapInArrow(run, f"own_id {kinds[page_id]}, own_url {kinds[url]}, text string")
    return out.withColumnsRenamed({"own_id": page_id, "own_url": url})
