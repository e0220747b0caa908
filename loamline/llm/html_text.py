"""Main text of HTML pages by wrapper induction.

The block trees of all pages of a host are aligned with those of a few of its pages (the references) by simple
tree matching.  A place of a reference at which most different pages of the host have the reference's own text
belongs to the template; all places that vary are content.  A page is then read with the wrapper of its host:
it is aligned again, texts at template places go, and so does what markup names as something other than the
article (menus, notices, adverts, forms, comments...), which may differ from page to page.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Reference pages of a host that its pages are aligned with, the least alike of some that a hash chooses; all pages are counted.
REFERENCES, CANDIDATES = 3, 8
#: A text belongs to the template if so many different pages hold it, and more than half of all.
LEAST_PAGES = 3
#: Wrappers are broadcast up to this size, else joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|title|svg|math|iframe|object)\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DROPPED = frozenset("nav footer aside form head button select dialog menu input".split())
#: Blocks of running text: names of what is inline within them say nothing about the page.
_RUNNING = frozenset("p li pre h1 h2 h3 h4 h5 h6 td th dd dt blockquote figcaption caption summary".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay "
    "nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets masthead footer foot copyright "
    "comment comments comentarios disqus reply replies respond share sharing social related recommended newsletter subscribe signup login search skip hidden".split()
)
#: What a name may go on with, and what turns it round (``with-sidebar``).
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column container content form group header heading holder icons inner item items left links link list main outer panel "
    "posts right row section site slot text title top unit wrap wrapper zone".split()
)
_TURNED = frozenset("has with no without not hide hides".split())
_PARTS = re.compile(r"[-_]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_SPACES = re.compile(r"\s+")


@lru_cache(maxsize=1 << 16)
def names_boilerplate(token: str) -> bool:
    """Whether a class or id, as a whole, names something other than the article: ``ad-slot``, not ``share-price``."""
    parts = _PARTS.split(token)
    while len(parts) > 1 and parts[-1] in _NEUTRAL:
        parts.pop()
    return parts[-1] in _NAMES and not _TURNED.intersection(parts)


class Node:
    __slots__ = ("tag", "mark", "role", "gone", "kids", "named")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.mark, self.role, self.gone, self.kids, self.named = tag, "", "", False, [], False
        if attrs and not attrs.isspace():
            for name, *values in _ATTR.findall(attrs):
                value, name = next((v for v in values if v), ""), name.lower()
                if name in ("class", "id"):
                    self.mark += " " + value
                elif name == "role":
                    self.role = value.lower()
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                    self.gone = True
            self.named = bool(self.mark) and any(map(names_boilerplate, self.mark.lower().split()))

    @property
    def sign(self) -> str:
        return self.tag + "." + self.mark.strip() if self.mark else self.tag


def parse(page: str) -> Node:
    """The tree of a page; broken markup closes as browsers roughly do.  Texts are kept undecoded."""
    root = Node("html")
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        attrs = m[4] or m[7] or ""
        if tag in _BLOCK:
            # a block ends an open paragraph, with what is open inside it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
            if tag in _CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


def clean(text: str) -> str:
    return _SPACES.sub(" ", entities.unescape(text)).strip()


def _boilerplate(n: Node, inside: bool, running: bool = False) -> bool:
    if n.gone or n.tag in _DROPPED or n.role in _ROLES:
        return True
    if n.tag == "header" and not inside:
        return True
    return n.named and n.tag not in ("article", "main", "body") and not (running and n.tag not in _BLOCK)


def _find_roots(root: Node) -> list[Node]:
    """The outermost article elements; else main ones.

    Names of wrappers say little (``with-sidebar``, a form around the page), so those within boilerplate are
    looked at as well: if the longest of all is among them, what wraps it is no boilerplate.
    """
    for test in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.role == "main"):
        # (root, the boilerplate around it, innermost first, as linked pairs)
        found: list[tuple[Node, tuple | None]] = []
        todo: list[tuple[Node, tuple | None]] = [(root, None)]
        while todo:
            x, around = todo.pop()
            if test(x):
                if not x.named:
                    found.append((x, around))
                continue
            if x is not root and _boilerplate(x, False):
                around = (x, around)
            todo.extend((k, around) for k in reversed(x.kids) if isinstance(k, Node))
        if any(around for _, around in found):
            sizes = [sum(map(len, blocks(x, True))) for x, _ in found]
            best = max((size, around is None, -k) for k, (size, (_, around)) in enumerate(zip(sizes, found)))
            opened, around = set(), found[-best[2]][1]
            while around:
                opened.add(id(around[0]))
                around = around[1]
            # of what is within boilerplate, only what the same wrappers hold
            found = [(x, around) for x, around in found if around is None or id(around[0]) in opened]
        if found:
            return [x for x, _ in found]
    return []


def _wrappers(root: Node, template: set[tuple[int, int]]) -> frozenset[int]:
    """Nodes that class, id or being a form would name as boilerplate, but that hold the text of the page.

    They hold a main heading and paragraphs, or more than nine tenths of what is left of the page.
    """
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        n, up = todo.pop()
        order.append((n, up))
        todo.extend((k, n) for k in n.kids if isinstance(k, Node))
    size, marks = {id(n): 0 for n, _ in order}, {id(n): 0 for n, _ in order}
    for n, up in reversed(order):
        size[id(n)] += sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        marks[id(n)] |= {"h1": 1, "p": 2}.get(n.tag, 0)
        if up is not None:
            size[id(up)] += size[id(n)]
            marks[id(up)] |= marks[id(n)]
    soft = [n for n, _ in order if n is not root and not n.gone and n.role not in _ROLES and (n.tag == "form" or (n.tag not in _DROPPED and n.tag != "header" and n.named))]
    opened = {id(n) for n in soft if marks[id(n)] == 3}
    while True:
        # the largest of the outermost that are still closed
        closed, todo = None, [(root, None)]
        while todo:
            n, _ = todo.pop()
            if n is not root and id(n) not in opened and _boilerplate(n, False):
                if (n.tag == "form" or (n.tag not in _DROPPED and n.tag != "header")) and not n.gone and n.role not in _ROLES and (closed is None or size[id(n)] > size[id(closed)]):
                    closed = n
                continue
            todo.extend((k, None) for k in n.kids if isinstance(k, Node))
        if closed is None or not size[id(closed)] or 9 * sum(map(len, blocks(root, False, template, frozenset(opened)))) >= size[id(closed)]:
            return frozenset(opened)
        # and what holds nearly all of it, so that nested wrappers are opened at once
        inner = [closed]
        while inner:
            n = inner.pop()
            opened.add(id(n))
            inner.extend(k for k in n.kids if isinstance(k, Node) and 10 * size[id(k)] >= 9 * size[id(closed)] and not (k.gone or k.role in _ROLES or (k.tag in _DROPPED and k.tag != "form")))


def blocks(root: Node, inside: bool, template: set[tuple[int, int]] = frozenset(), opened: frozenset[int] = frozenset()) -> list[str]:
    """The text blocks below a node in page order, without boilerplate and template texts.

    ``template`` holds the places (id of the node, number of the child) of raw texts that are left out.
    """
    held: list[str] = []
    out: list[str] = []

    def flush() -> None:
        if held:
            text = clean("".join(held))
            held.clear()
            if text:
                out.append(text)

    # an explicit stack: pages may nest deeply
    todo: list[tuple[Node, Iterator, bool, bool]] = []

    def enter(n: Node, running: bool) -> None:
        block = n.tag in _BLOCK or n is root
        if block:
            flush()
        todo.append((n, iter(enumerate(n.kids)), block, n.tag in _RUNNING or (running and n.tag not in _BLOCK)))

    enter(root, False)
    while todo:
        n, kids, block, running = todo[-1]
        for k, kid in kids:
            if isinstance(kid, str):
                held.append(" " if template and (id(n), k) in template else kid)
            elif kid.tag == "br" or (id(kid) not in opened and _boilerplate(kid, inside, running)):
                held.append(" ")
            else:
                enter(kid, running)
                break
        else:
            todo.pop()
            if block:
                flush()
    return out


# ---- simple tree matching over block trees

TEXT = "#"


class Outline:
    """The block tree of a page as arrays: inline elements belong to the texts, which are leaves.

    sign, kids and text of every entry; a text leaf has the sign TEXT, its cleaned text, and the places of
    its raw texts in ``where``.  ``shape`` names equal subtrees (signs only) alike within one ``shapes`` table.
    """

    def __init__(self, root: Node):
        self.sign: list[str] = [root.sign]
        self.kids: list[list[int]] = [[]]
        self.text: list[str] = [""]
        self.where: list[list[tuple[int, int]]] = [[]]
        held: list[str] = []
        where: list[tuple[int, int]] = []

        def flush(owner: int) -> None:
            if held:
                text = clean("".join(held))
                if text:
                    self.kids[owner].append(len(self.sign))
                    self.sign.append(TEXT)
                    self.kids.append([])
                    self.text.append(text)
                    self.where.append(where.copy())
                held.clear()
                where.clear()

        todo: list[tuple[Node, Iterator, int, bool]] = [(root, iter(enumerate(root.kids)), 0, True)]
        while todo:
            n, kids, owner, block = todo[-1]
            for k, kid in kids:
                if isinstance(kid, str):
                    held.append(kid)
                    where.append((id(n), k))
                elif kid.tag == "br":
                    held.append(" ")
                elif kid.tag in _BLOCK:
                    flush(owner)
                    at = len(self.sign)
                    self.kids[owner].append(at)
                    self.sign.append(kid.sign)
                    self.kids.append([])
                    self.text.append("")
                    self.where.append([])
                    todo.append((kid, iter(enumerate(kid.kids)), at, True))
                    break
                else:
                    todo.append((kid, iter(enumerate(kid.kids)), owner, False))
                    break
            else:
                todo.pop()
                if block:
                    flush(owner)

    def number(self, table: dict[tuple, int], texts: dict[tuple, int]) -> tuple[list[int], list[int], list[int], list[int]]:
        """(shape, whole, size, leaves) of every entry; the tables are shared by the trees that are to be compared.

        Subtrees with equal signs have one shape, and those with equal texts as well one ``whole``.
        """
        n = len(self.sign)
        shape, whole, size, leaves = [0] * n, [0] * n, [1] * n, [0] * n
        for i in range(n - 1, -1, -1):  # children come after their parents
            own, sign = self.kids[i], self.sign[i]
            shape[i] = table.setdefault((sign, *[shape[k] for k in own]), len(table))
            whole[i] = texts.setdefault((sign, self.text[i], *[whole[k] for k in own]), len(texts))
            leaves[i] = sign == TEXT
            for k in own:
                size[i] += size[k]
                leaves[i] += leaves[k]
        return shape, whole, size, leaves


class Alignment:
    """Simple tree matching: the most pairs of entries with equal signs that keep parents and order.

    Of several largest matchings of two lists of children, one with the most texts in subtrees that are equal
    in full is taken.  What is equal at both ends is matched first, which loses nothing; the rest is solved row by
    row with whole-array steps, and pairs of shapes are weighed once.  Pages may nest deeply, so nothing recurses.
    """

    def __init__(self, a: Outline, b: Outline):
        self.a, self.b = a, b
        table, texts = {}, {}
        self.shape_a, self.whole_a, self.size_a, self.leaves_a = a.number(table, texts)
        self.shape_b, self.whole_b, _, _ = b.number(table, texts)
        self.weight: dict[tuple[int, int], int] = {}

    @staticmethod
    def _ends(x: list[int], y: list[int], same_a: list[int], same_b: list[int]) -> tuple[int, int]:
        """How many children are equal at the beginning and at the end."""
        n, lo = min(len(x), len(y)), 0
        while lo < n and same_a[x[lo]] == same_b[y[lo]]:
            lo += 1
        hi = 0
        while hi < n - lo and same_a[x[-1 - hi]] == same_b[y[-1 - hi]]:
            hi += 1
        return lo, hi

    def _rows(self, x: list[int], y: list[int]) -> Iterator[np.ndarray]:
        """For every child in ``x`` its weights with all of ``y``."""
        columns: dict[int, np.ndarray] = {}
        for i in x:
            s = self.shape_a[i]
            if s not in columns:
                known: dict[int, int] = {}
                for j in y:
                    t = self.shape_b[j]
                    if t not in known:
                        known[t] = self.size_a[i] if s == t else self.weight.get((s, t), 0) if self.a.sign[i] == self.b.sign[j] else 0
                columns[s] = np.fromiter((known[self.shape_b[j]] for j in y), np.int64, len(y))
            yield columns[s]

    @staticmethod
    def _table(rows: Iterator[np.ndarray], n: int) -> Iterator[np.ndarray]:
        best = np.zeros(n + 1, np.int64)
        yield best
        for w in rows:
            step = np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0))
            best = np.concatenate([best[:1], np.maximum.accumulate(step)])
            yield best

    def weigh(self, i: int = 0, j: int = 0) -> int:
        """The number of pairs below and with two entries of equal sign."""
        if self.a.sign[i] != self.b.sign[j]:
            return 0
        todo = [(i, j, False)]
        while todo:
            i, j, ready = todo.pop()
            key = (self.shape_a[i], self.shape_b[j])
            if key in self.weight:
                continue
            if key[0] == key[1]:
                self.weight[key] = self.size_a[i]
                continue
            x, y = self.a.kids[i], self.b.kids[j]
            lo, hi = self._ends(x, y, self.shape_a, self.shape_b)
            mid_x, mid_y = x[lo : len(x) - hi], y[lo : len(y) - hi]
            if not ready:
                todo.append((i, j, True))
                by_sign: dict[str, dict[int, int]] = {}
                for k in mid_y:
                    by_sign.setdefault(self.b.sign[k], {})[self.shape_b[k]] = k
                for s, k in {self.shape_a[k]: k for k in mid_x}.items():
                    todo.extend((k, m, False) for t, m in by_sign.get(self.a.sign[k], {}).items() if (s, t) not in self.weight)
                continue
            for best in self._table(self._rows(mid_x, mid_y), len(mid_y)):
                pass
            self.weight[key] = 1 + sum(self.size_a[k] for k in x[:lo]) + sum(self.size_a[k] for k in x[len(x) - hi :]) + int(best[-1])
        return self.weight[self.shape_a[0], self.shape_b[0]]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """The matched entries, from the roots down."""
        if not self.weigh():
            return
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            yield i, j
            x, y = self.a.kids[i], self.b.kids[j]
            if not x or not y:
                continue
            lo, hi = self._ends(x, y, self.whole_a, self.whole_b)
            todo.extend(zip(x[:lo], y[:lo]))
            todo.extend(zip(x[len(x) - hi :], y[len(y) - hi :]))
            x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
            spots: dict[int, list[int]] = {}
            for c, k in enumerate(y):
                spots.setdefault(self.whole_b[k], []).append(c)
            if not any(self.whole_a[k] in spots for k in x):
                # no subtree is equal in full: shapes decide alone
                lo, hi = self._ends(x, y, self.shape_a, self.shape_b)
                todo.extend(zip(x[:lo], y[:lo]))
                todo.extend(zip(x[len(x) - hi :], y[len(y) - hi :]))
                x, y, spots = x[lo : len(x) - hi], y[lo : len(y) - hi], {}
            if not x or not y:
                continue
            many = 1 + sum(self.leaves_a[k] for k in x)  # structure comes first, equal texts second

            def rows() -> Iterator[np.ndarray]:
                for k, w in zip(x, self._rows(x, y)):
                    w = w * many
                    if self.whole_a[k] in spots:
                        w[spots[self.whole_a[k]]] += self.leaves_a[k]
                    yield w

            best = np.stack(list(self._table(rows(), len(y))))
            r, c = len(x), len(y)
            while r and c:
                if best[r, c] == best[r - 1, c]:
                    r -= 1
                elif best[r, c] == best[r, c - 1]:
                    c -= 1
                else:
                    r, c = r - 1, c - 1
                    todo.append((x[r], y[c]))


def tree_match(a: Node, b: Node) -> int:
    """The size of the largest common tree of two pages' blocks."""
    return Alignment(Outline(a), Outline(b)).weigh()


def _mark(texts: list[str]) -> int:
    """By what copies of a page are put aside: the least hash of the three-word shingles of its texts.

    Copies with small changes mostly share it.
    """
    words = "\n".join(texts).encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = max(1, len(h) - 2)
    mixed = h[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2):
        if len(h) > 2:
            mixed = (mixed ^ h[k : n + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
    return int(mixed.min() >> np.uint64(1))


@dataclass(frozen=True)
class Reference:
    """A reference page of a host: its outline, and which of its texts belong to the template."""

    outline: Outline
    template: frozenset[int]


def _equal_leaves(reference: Outline, page: Outline, only: frozenset[int] | None = None) -> list[tuple[int, int]]:
    """(leaf of the reference, leaf of the page) that are matched and hold the same text."""
    held = set(page.text)
    if not any(t and t in held for t in (reference.text if only is None else map(reference.text.__getitem__, only))):
        return []  # nothing to be found: no need to align
    return [(i, j) for i, j in Alignment(reference, page).pairs() if reference.sign[i] == TEXT and (only is None or i in only) and reference.text[i] == page.text[j]]


@lru_cache(maxsize=256)
def _outlines(references: str) -> tuple[Outline, ...]:
    return tuple(Outline(parse(page)) for page in json.loads(references))


@lru_cache(maxsize=256)
def _wrapper(references: str, template: str) -> tuple[Reference, ...]:
    """References that hold a part of the template; ``template`` lists (reference, leaf) pairs as ``r:leaf``."""
    own: dict[int, set[int]] = {}
    for pair in template.split():
        r, leaf = pair.split(":")
        own.setdefault(int(r), set()).add(int(leaf))
    outlines = _outlines(references)
    return tuple(Reference(outlines[r], frozenset(leaves)) for r, leaves in sorted(own.items()))


def main_text(page: str | None, wrapper: tuple[Reference, ...] = ()) -> str:
    """The article of a page: its blocks joined by line breaks."""
    if not page:
        return ""
    tree = parse(page)
    template: set[tuple[int, int]] = set()
    if wrapper:
        outline = Outline(tree)
        for ref in wrapper:
            for _, j in _equal_leaves(ref.outline, outline, ref.template):
                template.update(outline.where[j])
    return "\n".join(_read(tree, template))


def _read(tree: Node, template: set[tuple[int, int]]) -> list[str]:
    roots = _find_roots(tree)
    if roots:
        return [b for r in roots for b in blocks(r, True, template)]
    return blocks(tree, False, template, _wrappers(tree, template))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _shared(reference: Outline, page: Outline) -> tuple[set[int], int]:
    """The leaves of a page that hold what the reference has at the same place, and how many signs they have."""
    same = {j for _, j in _equal_leaves(reference, page)}
    return same, sum(len(page.text[j]) for j in same)


def _least_alike(pages: list[str]) -> list[str]:
    """The first page, and one after the other those that share the least with what is chosen."""
    left = [Outline(parse(p)) for p in pages]
    chosen, most = [0], [0.0] * len(pages)
    while len(chosen) < min(REFERENCES, len(pages)):
        for k, o in enumerate(left):
            most[k] = max(most[k], _shared(left[chosen[-1]], o)[1] / max(1, sum(map(len, o.text))))
        chosen.append(min((k for k in range(len(pages)) if k not in chosen), key=lambda k: (most[k], k)))
    return [pages[k] for k in chosen]


def reference_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, refs): REFERENCES different pages of every host that has as many, as a JSON array."""
    own = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).filter((F.length("html") > 0) & (F.col("host") != ""))
    # numbers first: of a host of any size only CANDIDATES hashes of a task are shuffled
    hashes = own.select("host", F.xxhash64("html").alias("h")).distinct()
    few = hashes.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("h"), "h"))).filter(F.col("place") <= CANDIDATES)
    few = staged(few.select("host", "h"), "reference-hashes")
    found = own.withColumn("h", F.xxhash64("html")).join(few, ["host", "h"]).groupBy("host", "h").agg(F.min("html").alias("html"))
    found = found.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "html"))), lambda x: x["html"]).alias("some"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = [json.dumps(_least_alike(some)) for some in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(refs, pa.string())], names=["host", "refs"])

    return found.filter(F.size("some") >= LEAST_PAGES).mapInArrow(choose, "host string, refs string")


def _with(pages: DataFrame, wrappers: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with the wrapper of their host beside them; broadcast if all of them are small."""
    size = wrappers.agg(F.sum(sum((F.length(c) for c in columns), F.length("host") + 40))).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")


def learn_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, refs, template): the template places of every host with three different pages or more, from all its pages.

    A text of a reference belongs to the template if more than half of the different pages of the host, and
    three at least, hold it at the place that simple tree matching aligns with it.  Copies of a page count once.
    """
    refs = staged(reference_pages(pages, url, html), "references")
    own = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).filter((F.length("html") > 0) & (F.col("host") != ""))
    own = _with(own, refs, ["refs"]).filter(F.col("refs").isNotNull()).select("host", "html", "refs")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                # a partial aggregation; place null stands for the page itself
                rows: dict[tuple, None] = {}
                for h, page, own_refs in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns)):
                    outline = Outline(parse(page))
                    equal = [_equal_leaves(ref, outline) for ref in _outlines(own_refs)]
                    # what it shares with the page least like it is likely template and tells no pages apart
                    common = min(({j for _, j in e} for e in equal), key=lambda e: sum(len(outline.text[j]) for j in e))
                    mark = _mark([t for j, t in enumerate(outline.text) if t and j not in common])
                    rows[h, mark, None] = None
                    for r, e in enumerate(equal):
                        rows.update(dict.fromkeys((h, mark, f"{r}:{i}") for i, _ in e))
                hosts, marks, places = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(marks, pa.int64()), pa.array(places, pa.string())], names=["host", "mark", "place"])

    held = own.mapInArrow(learn, "host string, mark bigint, place string").distinct().groupBy("host", "place").agg(F.count("*").alias("n"))
    held = staged(held.filter(F.col("place").isNull() | (F.col("n") >= LEAST_PAGES)), "held")
    of = held.filter("place is null").select("host", F.col("n").alias("of"))
    some = held.filter("place is not null").join(of, "host").filter("2 * n > of")
    found = some.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("place")), " ").alias("template"))
    return found.join(refs, "host").select("host", "refs", "template")


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty page has an empty text.  Hosts with fewer than three different pages, and pages without
    a host, are read without a template.  Repeated rows are extracted each, ties don't arise; other columns are
    not looked at.  Pages of any length and depth are read whole.  An empty table gives an empty result.
    """
    wrappers = staged(learn_wrappers(pages, url, html), "wrappers")
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    joined = _with(own, wrappers, ["refs", "template"]).select("page_id", "url", "html", "refs", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(h, _wrapper(r, t) if t else ()) for h, r, t in zip(*(c.to_pylist() for c in part.columns[2:]))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
