"""Main text of web pages by wrapper induction.

Pages of a host with the same layout (the same set of structural tags) have a reference page. The DOM tree of every other page
is aligned with it by simple tree matching; nodes of the reference whose text is the same in nearly all pages are
template, counted over all different pages. Nodes that the reference lacks or that align with others are template if nearly all pages have their path and
text. The node of the reference below which most of the text lies that is not template is where content is.
Text of template nodes and all text outside that node is left out, varying slots below it are content. Names only break ties: an article around
the induced node stands for it, one below it only if it holds most of its text, and slots below it that are named as menus, adverts and the like go,
but never one that holds an article or main element.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, materialize, slices, strings

#: A node is template if at least LEAST_PAGES other pages were aligned and SHARE of them have its text. With fewer the votes leave it open,
#: and the node that holds the content is induced from all its text.
LEAST_PAGES, SHARE = 5, 0.9
#: A named node below the induced one replaces it if it holds this share of its text.
NAMED_SHARE = 0.5
#: Content lies below a child that has this share of its parent's varying text.
ROOT_SHARE = 0.5
#: References are broadcast up to this many bytes in all; beyond it the join by host and layout shuffles.
BROADCAST_BYTES = 32 << 20
#: Votes that a task holds before it passes them on.
HELD_VOTES = 200_000
#: Lists of children whose pairs are more than this are split in half first, so that memory stays linear; the alignment is the same.
WHOLE_PAIRS = 1 << 22

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# Fixed values of HTML: elements without content, with raw text, that close a paragraph, that make no block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl article section div main td th nav aside footer header form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = RAW | frozenset("head nav footer aside form button select menu dialog object canvas audio video".split())
# Words of class names that mark boilerplate, those that do so only outside content, and those that may stand beside them in one name.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter "
    "subscribe popup modal overlay sidebar widget widgets related recommend recommended recommendations share sharing social breadcrumb "
    "breadcrumbs menu nav navbar navigation footer comment comments commentlist respond reply replies login signup search pager pagination "
    "copyright skip toolbar complementary contentinfo dialog".split()
)
HEADER_WORDS = frozenset("header masthead".split())
BESIDE_WORDS = frozenset(
    "site page global main primary secondary top bottom left right user reader list box area block section container wrapper bar button buttons "
    "slot unit form link links item items post posts article articles stories thread panel group row inner outer media icons".split()
)
#: Tags that make a layout, with their attributes; runs of digits in them count as one.
_LAYOUT = r"(?i)<((?:div|section|main|article|aside|nav|header|footer|table|form)\b[^<>]*)>"


class Node:
    __slots__ = ("tag", "names", "children", "parts", "sig", "number", "parent", "shape", "own")

    def __init__(self, tag: str, names: str, number: int, parent: Node | None):
        self.tag, self.names, self.number, self.parent = tag, names, number, parent
        self.children: list[Node] = []
        #: direct texts and child nodes in page order
        self.parts: list = []
        self.sig = f"{tag}.{names}"


class Shapes:
    """Numbers of trees without their texts, shared by the trees of a task, and how well two of them match."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.sigs: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.memo: dict[tuple[int, int], int] = {}

    def of(self, sig: str, children: tuple[int, ...]) -> int:
        key = (sig, children)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.sigs)
            self.sigs.append(sig)
            self.children.append(children)
        return n

    def match(self, a: int, b: int) -> int:
        """Size of the largest top-down matching of two shapes that keeps the order of children; 0 if their roots differ."""
        memo = self.memo
        if (known := memo.get((a, b))) is not None:
            return known
        if self.sigs[a] != self.sigs[b]:
            return 0
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in memo:
                stack.pop()
                continue
            p, q = self.children[x], self.children[y]
            need = []
            if p and q:
                by: dict[str, list[int]] = {}
                for k in dict.fromkeys(q):
                    by.setdefault(self.sigs[k], []).append(k)
                need = [(i, k) for i in dict.fromkeys(p) for k in by.get(self.sigs[i], ()) if (i, k) not in memo]
            if need:
                stack += need
                continue
            stack.pop()
            memo[x, y] = 1 + (self._best(p, q) if p and q else 0)
        return memo[a, b]

    def _best(self, p: tuple[int, ...], q: tuple[int, ...]) -> int:
        memo = self.memo
        if len(p) * len(q) <= 256:
            up = [0] * (len(q) + 1)
            for i in p:
                row = [0]
                for k, j in enumerate(q):
                    row.append(max(up[k] + memo.get((i, j), 0), up[k + 1], row[k]))
                up = row
            return up[-1]
        return int(_last_row(lambda i: self.row(p[i], q), len(p), len(q))[-1])

    def row(self, i: int, q: tuple[int, ...]) -> np.ndarray:
        one = {k: self.match(i, k) for k in dict.fromkeys(q)}
        return np.array([one[k] for k in q], np.int64)


def _last_row(weight, n: int, m: int) -> np.ndarray:
    """The last row of the alignment table of ``n`` rows of weights."""
    up = np.zeros(m + 1, np.int64)
    for i in range(n):
        row = np.maximum(up[1:], up[:-1] + weight(i))
        up = np.concatenate([[0], np.maximum.accumulate(row)])
    return up


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of tags and comments (which have no name), in time linear in the page.

    Where quotes in a tag don't close, it and all later tags end at the next ``>`` whatever their quotes.
    """
    at, last_open, last_close, loose = 0, page.rfind("<"), page.rfind(">"), False
    while (at := page.find("<", at)) >= 0:
        end, closing, name, rest = -1, False, "", ""
        mark = page[at + 1 : at + 2]
        m = _NAME.match(page, at + 2 if mark == "/" else at + 1) if at < last_close or at == last_open else None
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end = stop + 3 if stop >= 0 else len(page)
        elif at > last_close:  # the page ends in a tag
            end = len(page) if at == last_open and (m or mark in ("/", "!")) else -1
        elif m:
            closing, name = mark == "/", m[0].lower()
            stop = None if loose else _REST.match(page, m.end())
            loose = loose or stop is None
            end = stop.end() if stop else page.find(">", m.end()) + 1
            rest = page[m.end() : end - 1]
        elif mark in ("!", "?", "/"):
            end = page.find(">", at) + 1
        if end < 0:
            at += 1
            continue
        jump = yield at, end, closing, name, rest
        at = jump or end


class _Open:
    """The stack of open elements, which also knows where the topmost of each tag and of SCOPE lies."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.wide: list[int] = []

    def push(self, node: Node) -> None:
        i = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(i)
        if node.tag in SCOPE:
            self.scopes.append(i)
            if node.tag not in ("td", "th"):
                self.wide.append(i)

    def cut(self, i: int) -> None:
        while len(self.stack) > i:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
                if node.tag not in ("td", "th"):
                    self.wide.pop()

    def top(self, tags: tuple[str, ...]) -> int:
        best = 0
        for t in tags:
            if (at := self.places.get(t)) and at[-1] > best:
                best = at[-1]
        return best


class Tree:
    """A page's root, and its nodes in page order."""

    def __init__(self, root: Node, nodes: list[Node]):
        self.root, self.nodes = root, nodes


def parse(page: str, shapes: Shapes | None = None) -> Tree:
    """A forgiving DOM tree; nodes are numbered in page order, the root is -1."""
    root = Node("#", "", -1, None)
    nodes: list[Node] = []
    open_, begin = _Open(root), 0
    tags = _tags(page)
    found = next(tags, None)
    while True:
        stop = found[0] if found else len(page)
        if stop > begin:
            open_.stack[-1].parts.append(entities.unescape(page[begin:stop]))
        if found is None:
            break
        _, begin, closing, tag, rest = found
        jump = None
        if closing:
            i = open_.top((tag,))
            if i and not (tag in INLINE and open_.scopes and open_.scopes[-1] > i):
                open_.cut(i)
        elif tag:
            i = open_.top(SIBLINGS.get(tag, ()) or (() if tag in INLINE else ("p",)))
            scopes = open_.wide if tag == "tr" else open_.scopes
            if i and not (scopes and scopes[-1] > i):
                open_.cut(i)
            names = " ".join(x[1].strip("\"'") for x in _NAMES.findall(rest)) if rest else ""
            parent = open_.stack[-1]
            node = Node(tag, names, len(nodes), parent)
            nodes.append(node)
            parent.children.append(node)
            parent.parts.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, begin)
                begin = jump = end.end() if end else len(page)
            elif tag not in VOID and not rest.endswith("/"):
                open_.push(node)
        found = _next(tags, jump)
    shapes = shapes or Shapes()
    for n in (*reversed(nodes), root):  # children come after their parents
        n.own = " ".join(" ".join([p for p in n.parts if p.__class__ is str]).split()) if n.parts else ""
        n.shape = shapes.of(n.sig, tuple([c.shape for c in n.children]) if n.children else ())
    return Tree(root, nodes)


def _next(tags: Iterator, jump: int | None):
    try:
        return tags.send(jump)
    except StopIteration:
        return None


def match(a: Tree, b: Tree, shapes: Shapes) -> list[tuple[Node, Node]]:
    """Simple tree matching of two trees: the aligned nodes. Both are parsed with ``shapes``.

    Children are aligned in order so that the matched nodes below them are most, each counting two; equal own texts count three more.
    """
    pairs, stack = [], [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.children and y.children:
            stack += _align(x.children, y.children, shapes)
    return pairs


def _traced(rows, p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
    """The aligned nodes of a table of best weights."""
    out, i, k = [], len(p), len(q)
    while i and k:
        if rows[i][k] == rows[i - 1][k]:
            i -= 1
        elif rows[i][k] == rows[i][k - 1]:
            k -= 1
        else:
            i, k = i - 1, k - 1
            out.append((p[i], q[k]))
    return out


def _align(p: list[Node], q: list[Node], shapes: Shapes) -> list[tuple[Node, Node]]:
    if len(p) == len(q) == 1:
        return [(p[0], q[0])] if p[0].sig == q[0].sig else []
    if len(p) * len(q) <= 400:  # the same table without arrays, which cost more than they save on short lists
        rows = [[0] * (len(q) + 1)]
        for x in p:
            up, row, left = rows[-1], [0], 0
            for k, y in enumerate(q):
                best = up[k + 1] if up[k + 1] > left else left
                if x.sig == y.sig:
                    w = up[k] + 2 * shapes.match(x.shape, y.shape) + (3 if x.own and x.own == y.own else 0)
                    best = w if w > best else best
                row.append(best)
                left = best
            rows.append(row)
        return _traced(rows, p, q)
    shape_q = tuple(n.shape for n in q)
    memo: dict[int, np.ndarray] = {}
    texts = {t: i for i, t in enumerate(dict.fromkeys(n.own for n in q if n.own), 1)}
    text_q = np.array([texts.get(n.own, 0) for n in q], np.int64)

    def weight(i: int, lo: int, hi: int) -> np.ndarray:
        n = p[i]
        if n.shape not in memo:
            memo[n.shape] = 2 * shapes.row(n.shape, shape_q)
        w = memo[n.shape][lo:hi]
        t = texts.get(n.own, 0) if n.own else 0
        return w + 3 * ((text_q[lo:hi] == t) & (w > 0)) if t else w

    out: list[tuple[Node, Node]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, lo, hi = todo.pop()
        if a >= b or lo >= hi:
            continue
        if (b - a) * (hi - lo) > WHOLE_PAIRS and b - a > 1:
            half = (a + b) // 2
            down = _last_row(lambda i: weight(a + i, lo, hi), half - a, hi - lo)
            up = _last_row(lambda i: weight(b - 1 - i, lo, hi)[::-1], b - half, hi - lo)[::-1]
            k = lo + int(np.argmax(down + up))
            todo += [(a, half, lo, k), (half, b, k, hi)]
            continue
        rows = np.zeros((b - a + 1, hi - lo + 1), np.int32)
        for i in range(a, b):
            best = np.maximum(rows[i - a, 1:], rows[i - a, :-1] + weight(i, lo, hi))
            rows[i - a + 1, 1:] = np.maximum.accumulate(best)
        out += _traced(rows, p[a:b], q[lo:hi])
    return out


@functools.lru_cache(maxsize=1 << 16)
def named_boilerplate(names: str, inside: bool) -> bool:
    """Whether one of the names is a boilerplate word, or made of such words and words that may stand beside them."""
    for name in re.sub(r"side-bar", "sidebar", names.lower()).split():
        words = [re.sub(r"\d+$", "", w) for w in re.split(r"[-_]+", name)]
        words = [w for w in words if w]
        marks = [w for w in words if w in BOILERPLATE_WORDS or not inside and w in HEADER_WORDS]
        if marks and all(w in marks or w in BESIDE_WORDS for w in words):
            return True
    return False


def _boilerplate_element(node: Node, inside: bool) -> bool:
    return node.tag in BOILERPLATE or node.tag == "header" and not inside


def _boilerplate_name(node: Node, inside: bool) -> bool:
    return bool(node.names) and node.tag not in ("html", "body", "main", "article", "h1", "h2") and named_boilerplate(node.names, inside)


class _Named:
    """Outermost article elements and main elements outside boilerplate elements; doubtful ones lie in nodes with boilerplate names."""

    def __init__(self, tree: Tree):
        self.articles: list[Node] = []
        self.mains: list[Node] = []
        self.doubtful: list[Node] = []
        stack = [(tree.root, False)]
        while stack:
            n, doubt = stack.pop()
            if n is not tree.root and _boilerplate_element(n, False):
                continue
            doubt = doubt or _boilerplate_name(n, False)
            article = n.tag == "article" or re.search(r"\barticleBody\b", n.names)
            if article:
                (self.doubtful if doubt else self.articles).append(n)
                continue
            if n.tag == "main" or n.names == "main":
                (self.doubtful if doubt else self.mains).append(n)
            stack.extend((c, doubt) for c in reversed(n.children))
        #: nodes that hold one of these, which names can't take out
        self.holders = set().union(*(_above(n) for n in (*self.articles, *self.mains, *self.doubtful)))


def _above(node: Node) -> set[Node]:
    out, n = set(), node
    while n is not None:
        out.add(n)
        n = n.parent
    return out


def _chars(nodes: list[Node]) -> int:
    """Text in nodes and below them, outside boilerplate elements."""
    n, stack = 0, list(nodes)
    while stack:
        x = stack.pop()
        n += len(x.own)
        stack.extend(c for c in x.children if not _boilerplate_element(c, True))
    return n


def _roots(tree: Tree, induced: Node | None, named: _Named) -> list[Node]:
    """The induced node, or a named one around it or with most of its text; without an induced node those of the page."""
    articles, mains = named.articles, named.mains[:1]
    if induced is None or induced.tag in ("#", "html", "body"):
        if articles and mains:
            below = [n for n in articles if mains[0] in _above(n)]
            return articles if not below or _chars(below) >= NAMED_SHARE * _chars(mains) else mains
        if articles or mains:
            return articles or mains
        doubtful = named.doubtful
        return doubtful if doubtful and _chars(doubtful) >= NAMED_SHARE * _chars([tree.root]) else [tree.root]
    around = _above(induced)
    for nodes in (articles, mains, named.doubtful):
        if hit := [n for n in nodes if n in around]:
            return hit[:1]
        below = [n for n in nodes if induced in _above(n)]
        if below and _chars(below) >= NAMED_SHARE * _chars([induced]):
            return below
    return [induced]


def main_text(tree: Tree, template: frozenset[int] | set[int] = frozenset(), induced: Node | None = None) -> str:
    """Blocks of content joined by line ends; ``template`` has the numbers of nodes whose own text is left out."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    named = _Named(tree)
    for root in _roots(tree, induced, named):
        inside = root is not tree.root
        flush()
        stack: list = [root]
        while stack:
            x = stack.pop()
            if x.__class__ is str:
                line.append(x)
            elif x is None:
                flush()
            elif x is root or not (_boilerplate_element(x, inside) or x not in named.holders and _boilerplate_name(x, inside)):
                block = x.tag not in INLINE
                if block:
                    flush()
                    stack.append(None)
                elif x.tag == "br":
                    line.append(" ")
                stack.extend(p for p in reversed(x.parts) if p.__class__ is not str or x.number not in template)
            elif x.tag not in INLINE:
                flush()
        flush()
    return "\n".join(blocks)


def induced_root(tree: Tree, chars: dict[int, int], varying: frozenset[int] | set[int] = frozenset()) -> int:
    """The node below which the content lies, from the characters of each node that are not template; -1 for the root.

    From the root on, the child that holds most of its parent's text is taken, as long as it holds blocks itself, the parent
    has no heading or paragraph with text, and no other child holds a first-level heading among the ``varying`` nodes.
    """
    mass = {n.number: 0 if n.tag in RAW or n.tag == "head" else chars.get(n.number, 0) for n in tree.nodes}
    titles: set[int] = set()
    for n in reversed(tree.nodes):
        if n.tag == "h1" and n.number in varying:
            titles.add(n.number)
        if n.parent.number >= 0:
            mass[n.parent.number] += mass[n.number]
            if n.number in titles:
                titles.add(n.parent.number)
    at, total = tree.root, sum(mass[n.number] for n in tree.root.children)
    while True:
        blocks = [c for c in at.children if c.tag not in INLINE and mass[c.number] and c.tag not in RAW]
        if not blocks or any(c.tag in HEADINGS or c.tag == "p" for c in blocks):
            return at.number
        best = max(blocks, key=lambda c: mass[c.number])
        deeper = any(c.tag not in INLINE and mass[c.number] for c in best.children)
        apart = any(c.number in titles for c in blocks if c is not best)
        if apart or not deeper or mass[best.number] < ROOT_SHARE * total:
            return at.number
        at, total = best, mass[best.number]


def path_hash(node: Node, memo: dict[int, str]) -> int:
    """Hash of the names on the way to a node, and of its text."""
    way = []
    n = node
    while n is not None and n.number not in memo:
        way.append(n)
        n = n.parent
    for n in reversed(way):
        above = memo[n.parent.number] if n.parent is not None else ""
        memo[n.number] = xxhash.xxh64_hexdigest(f"{above}>{n.sig}")
    return xxhash.xxh64_intdigest(f"{memo[node.number]}|{node.own}") - (1 << 63)


class _Trees(dict):
    """Parsed references of the layouts seen lately."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes = Shapes()

    def get_tree(self, key: tuple[str, str], page: str) -> Tree:
        if key not in self or self[key][0] != page:
            if len(self) > 200 or len(self.shapes.memo) > 2_000_000:
                self.clear()
                self.shapes = Shapes()
            self[key] = (page, parse(page, self.shapes))
        return self[key][1]


NODE, PATH, PAGES = 0, 1, 2


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, kind, key, n, same, chars, alike): for nodes of the reference, for paths with texts, and pages.

    ``chars`` counts the text that differs from the reference, ``alike`` the other. Copies of a page share one vote.
    """
    trees = _Trees()
    votes: dict[tuple[str, str, int, int], list[float]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        if votes:
            keys, values = list(zip(*votes, strict=True)), list(zip(*votes.values(), strict=True))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(keys, kinds, strict=True)] + [pa.array(c, pa.float64()) for c in values],
                ["host", "layout", "kind", "key", "n", "same", "chars", "alike"],
            )
            votes.clear()

    for batch in batches:
        for part in slices(batch, "html", "reference"):
            columns = [strings(part, c) for c in ("host", "layout", "html", "reference")]
            for host, layout, page, ref, copies in zip(*columns, part.column("copies").to_pylist(), strict=True):
                if page == ref:
                    continue
                tree = trees.get_tree((host, layout), ref)
                other = parse(page, trees.shapes)
                pairs = match(tree, other, trees.shapes)

                def vote(kind: int, key: int, *counts: int) -> None:
                    v = votes.setdefault((host, layout, kind, key), [0.0] * 4)  # noqa: B023
                    for i, c in enumerate(counts):
                        v[i] += c / copies  # noqa: B023

                vote(PAGES, 0, 1)
                place = {y.number: x.number for x, y in pairs}
                seen: set[int] = set()
                memo: dict[int, str] = {}
                once: set[int] = set()
                for x, y in pairs:
                    if x.own or y.own:
                        seen.add(x.number)
                        same = x.own == y.own
                        vote(NODE, x.number, 1, same, 0 if same else len(y.own), len(y.own) if same else 0)
                        if same:
                            once.add(path_hash(y, memo))
                for x in tree.nodes:
                    if x.own and x.number not in seen:
                        vote(NODE, x.number, 1)
                for y in other.nodes:
                    if y.number not in place:
                        place[y.number] = place[y.parent.number]
                        if y.own:
                            vote(NODE, place[y.number], 0, 0, len(y.own))
                            once.add(path_hash(y, memo))
                for h in once:
                    vote(PATH, h, 1)
                if len(votes) > HELD_VOTES:
                    yield from out()
    yield from out()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = _Trees()
    induced: dict[tuple[str, str], tuple[str, int]] = {}
    for batch in batches:
        for part in slices(batch, "html", "reference"):
            out = []
            columns = [strings(part, c) for c in ("host", "layout", "html", "reference")]
            lists = [part.column(c).to_pylist() for c in ("nodes", "paths", "chars")]
            for host, layout, page, ref, nodes, paths, chars in zip(*columns, *lists, strict=True):
                key = (host, layout)
                if chars is None:
                    out.append(main_text(parse(page)))
                    continue
                reference = trees.get_tree(key, ref)
                if key not in induced or induced[key][0] != ref:
                    if len(induced) > 1000:
                        induced.clear()
                    open_ = {c["key"]: c["chars"] for c in chars}
                    induced[key] = (ref, induced_root(reference, open_, {c["key"] for c in chars if c["varying"]}))
                tree = parse(page, trees.shapes)
                pairs = match(reference, tree, trees.shapes)
                fixed, known, memo = set(nodes or ()), set(paths or ()), {}
                template = {y.number for x, y in pairs if x.number in fixed and x.own == y.own}
                if known:
                    template |= {y.number for y in tree.nodes if y.own and y.number not in template and path_hash(y, memo) in known}
                root = next((y for x, y in pairs if x.number == induced[key][1]), None)
                out.append(main_text(tree, template, root))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def _join_layouts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    size = wrappers.agg(F.sum(F.octet_length("reference") + F.octet_length("own") + 64)).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, ["host", "own"], "left")


def _references(read: DataFrame) -> DataFrame:
    """(host, own, layout, reference): of each layout of a host, itself or, where it has too few pages, the host's commonest one."""
    size = F.octet_length("html")
    fitness = F.struct(F.when(size >= 1024, size).otherwise(F.lit(2**30) - size), F.xxhash64("html"))
    own = materialize(read.groupBy("host", "own").agg(F.min_by("html", fitness).alias("reference"), F.count(F.lit(1)).alias("n")), "references")
    common = own.groupBy("host").agg(F.max_by("own", F.struct("n", "own")).alias("common"))
    few = F.col("n") <= LEAST_PAGES
    chosen = own.drop("reference").join(common, "host").select("host", "own", F.when(few, F.col("common")).otherwise(F.col("own")).alias("layout"))
    return chosen.join(own.select("host", F.col("own").alias("layout"), "reference"), ["host", "layout"]).select("host", "own", "layout", "reference")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty html gives an empty text. Pages with a null url are one host. Layouts of at most
    LEAST_PAGES pages go with the host's commonest. Exact copies of the reference don't vote, copies of any other page share one vote;
    a host with one page alone has only the rules about names and elements. Repeated rows each get their row. An empty table gives an
    empty result; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    html = F.coalesce("html", F.lit(""))
    tags = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_LAYOUT), F.lit(1)), lambda t: F.regexp_replace(t, "[0-9]+", "#"))))
    read = pages.select("page_id", "url", html.alias("html"), host.alias("host"), F.md5(F.array_join(tags, "\n")).alias("own"), F.md5(html).alias("digest"))
    wrappers = materialize(_references(read), "layouts")
    same_page = read.groupBy("host", "own", "digest").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    same_page = materialize(same_page, "copies")
    if (same_page.agg(F.sum(F.octet_length("host") + 96)).first()[0] or 0) <= BROADCAST_BYTES:
        same_page = F.broadcast(same_page)
    voters = _join_layouts(read.join(same_page, ["host", "own", "digest"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))), wrappers)
    votes = map_arrow(
        voters.select("host", "layout", "html", "reference", "copies"), _votes,
        "host string, layout string, kind int, key long, n double, same double, chars double, alike double",
    )
    # votes of copies are fractions, so sums are rounded before they are compared
    counts = [F.round(F.sum(c), 6).alias(c) for c in ("n", "same", "chars", "alike")]
    votes = materialize(votes.groupBy("host", "layout", "kind", "key").agg(*counts), "votes")
    count = votes.where(F.col("kind") == PAGES).select("host", "layout", F.col("n").alias("pages"))
    template = (F.col("n") >= LEAST_PAGES) & (F.col("same") >= SHARE * F.col("n"))
    nodes = votes.where((F.col("kind") == NODE) & template)
    many = count.where(F.col("pages") >= LEAST_PAGES)
    # a host has a path for each of its different texts, so those of few pages go before the join, which shuffles only beyond a checked size
    if (many.agg(F.sum(F.octet_length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        many = F.broadcast(many)
    often = votes.where((F.col("kind") == PATH) & (F.col("n") >= SHARE * LEAST_PAGES))
    paths = often.join(many, ["host", "layout"]).where(F.col("n") >= SHARE * F.col("pages"))
    left = F.col("chars") + F.when(template, 0).otherwise(F.col("alike"))
    open_ = votes.where(F.col("kind") == NODE).select("host", "layout", "key", left.alias("chars"), (F.col("chars") > 0).alias("varying")).where("chars > 0")
    # lists of at most the nodes of one page
    found = (
        count.select("host", "layout")
        .join(nodes.groupBy("host", "layout").agg(F.collect_list("key").alias("nodes")), ["host", "layout"], "left")
        .join(paths.groupBy("host", "layout").agg(F.collect_list("key").alias("paths")), ["host", "layout"], "left")
        .join(open_.groupBy("host", "layout").agg(F.collect_list(F.struct("key", "chars", "varying")).alias("chars")), ["host", "layout"], "left")
        .withColumn("chars", F.coalesce("chars", F.array().cast("array<struct<key:bigint,chars:double,varying:boolean>>")))
    )
    wrappers = materialize(wrappers.join(found, ["host", "layout"], "left"), "wrappers")
    rows = _join_layouts(read, wrappers).select("page_id", "url", "html", "host", "layout", "reference", "nodes", "paths", "chars")
    return map_arrow(rows, _extract, f"page_id {kind}, url string, text string, n_chars long")
