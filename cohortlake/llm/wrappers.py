"""Operator 2, HTML main text by wrapper induction.

Pages of one host come from few templates.  Pages whose top elements have the
same signatures are one layout; a wrapper is induced for each host and
layout, and one for all pages of a host of several layouts, which serves
those too rare for their own.  Texts are counted over all different pages of
the host and layout.  One that nearly all have at its node path is the
template's.  The DOM tree of every page is aligned, by simple tree matching,
with that of the page that shows most of those texts; a text outside an
article whose place shows texts that come back from page to page (menus,
adverts and footers taken from a stock) is the template's too.  A node that
varies is a slot for content.  The wrapper is the tree that leads to the template's
nodes.  Each page is aligned with its host's wrapper; texts that match the
template go, the rest is content.  Pages that share their longest text are
copies and count once, or their articles would look like template.  Of the
content, the articles
stay (all that don't stand in another, in page order), without what HTML or
usual class names mark as menu, header, footer, sidebar, notice, advert,
form, script, style or reader comment: those vary from page to page on some
hosts.  A class name marks an element if all its words are of that kind
("cookie-notice", "site-footer"; not "has-sidebar"); it never marks html, body
or main, nor what holds all articles or, without articles, most of the text.

Copies go before texts are counted.  No page is left out of a count, and
every page is extracted.  Any text comes back some time on enough pages, so
whether texts come back is stated for ``AMONG`` pages: the share of pages
whose text another one of that many is expected to show, from the counts
over all pages.  Host groups are never gathered: pages meet the tree of one
page, then wrappers, not each other.

Defined cases: null or empty html has empty text; a host of fewer than
``MIN_PAGES`` different pages has no wrapper and its pages are cut by
structure alone; a null URL is a host of its own; repeated rows give
repeated results; broken or cut markup is closed as browsers do; other
columns are ignored; long pages are parsed whole.
"""

from __future__ import annotations

import html as entities
import json
import marshal
import re
from collections import Counter
from collections.abc import Iterator
from itertools import count
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, map_rows

MIN_PAGES = 4
#: Share of pages that must show the same text at a node; or, outside an article, a text that another one of ``AMONG`` pages is expected to show there.
AMONG = 40
CONSTANT, RECURRING = 0.8, 0.25

#: Wrappers sent to every executor at most; more are joined by a shuffle.
BROADCAST_WRAPPERS = 20_000

#: Scope of the wrapper for all layouts of a host.
ALL = 0

#: Lists of children with up to this many pairs squared are aligned in plain loops, longer ones on arrays, with the same result.
ALIGN = 64
#: Matches of pairs of shapes, and numbers of a list's rows of them, that are kept at once; others are made again.
KNOWN, CELLS = 100_000, 4_000_000

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
RAW = "script|style|noscript|template|iframe|svg|textarea|title|object|canvas|select"
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav",
            "ol", "p", "pre", "section", "table", "ul"}
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body"}

# Elements and words of class, id or role that aren't main text.
NOT_CONTENT = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "head"}
MARK = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|gdpr|popup|modal|overlay|sidebar|side|menu|nav\w*|breadcrumbs?|footer|"
                  r"masthead|comments?|replies|respond|disqus|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|search|pagination|pager|toolbar|contentinfo|complementary", re.I)
#: Words beside a mark that only say where or in what it stands.
PLACE = {"site", "page", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "inner", "outer", "box", "bar", "block", "area", "list", "item", "items", "link", "links",
         "container", "wrapper", "wrap", "section", "widget", "panel", "slot", "unit", "buttons", "icons", "form", "posts", "articles", "stories"}
#: Elements that marks never apply to, and share of a page's text that is most of it.
FRAME, MOST = {"html", "body", "main"}, 0.5

TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</\1\s*>|.*$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S | re.I)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def is_marked(attributes: str) -> bool:
    """Whether a class, id or role is made of mark words (and words of place) alone."""
    for token in attributes.lower().split():
        words = [w for w in re.split("[_-]+", token) if w]
        marks = [MARK.fullmatch(w) is not None for w in words]
        if any(marks) and all(m or w in PLACE for m, w in zip(marks, words)):
            return True
    return False


class Node:
    """An element (``sig``: tag and class) or a text ("#text"); ``off`` where it is no main text, ``marked`` where only its attributes say so."""

    __slots__ = ("tag", "sig", "text", "children", "off", "marked", "fixed")

    def __init__(self, tag: str, sig: str, text: str = "", off: bool = False, marked: bool = False):
        self.tag, self.sig, self.text, self.children, self.off, self.marked, self.fixed = tag, sig, text, [], off or marked, marked and not off, False


def parse(source: str) -> Node:
    """The tree of blocks and their texts; inline elements are part of the text around them."""
    root = Node("#root", "#root")
    stack, buffer, at = [root], [], 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            stack[-1].children.append(Node("#text", "#text", text))

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    for m in TOKEN.finditer(source):
        if m.start() > at:
            buffer.append(source[at:m.start()])
        at = m.end()
        if not m[3]:
            if m[1] and m[1].lower() not in ("script", "style"):
                buffer.append(" ")
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in INLINE:
                while len(stack) > 1 and stack[-1].tag in INLINE:  # an inline element that was kept for its class
                    if stack[-1].tag == tag:
                        close(len(stack) - 1)
                    break
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        attributes = " ".join(f"{x[2] or x[3] or x[4] or ''}" for x in ATTRIBUTE.finditer(m[4])) if m[4] and "=" in m[4] else ""
        marked = bool(attributes and tag not in FRAME and is_marked(attributes))
        if tag in INLINE and not marked:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
                if tag == "hr":
                    flush()
            continue
        flush()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        elif tag in CLOSES_LIKE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES_LIKE[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        in_article = any(x.tag in ("article", "main") for x in stack)
        node = Node(tag, f"{tag}.{attributes.lower()}", off=tag in NOT_CONTENT or (tag == "header" and not in_article), marked=marked)
        stack[-1].children.append(node)
        if not (m[4] and m[4].endswith("/") and marked and tag in INLINE):
            stack.append(node)
    if at < len(source):
        rest = source[at:]
        cut_at = rest.rfind("<")  # a tag that the end of the page cuts off is no text
        buffer.append(rest if cut_at < 0 or ">" in rest[cut_at:] or not re.match(r"</?[a-zA-Z!]", rest[cut_at:]) else rest[:cut_at])
    close(1)
    return root


def match(a: Node, b: Node, pairs: list | None = None) -> int:
    """Simple tree matching: the size of the largest order-preserving match of two trees whose roots match; ``pairs`` gets the matched text nodes."""
    if a.sig != b.sig:
        return 0
    total, below = _Matches(a, b).of(a, b)

    def walk(p: Node, q: Node, below: list) -> None:
        if p.sig == "#text":
            pairs.append((p, q))
        for i, j, inner in below:
            walk(p.children[i], q.children[j], inner)

    if pairs is not None:
        walk(a, b, below)
    return total


class _Matches:
    """Largest matches of the nodes of two trees.

    A match depends on shapes (signatures all the way down) alone: it is made
    once for a pair of shapes, as places of children.  Every list of children
    is aligned whole; of long ones a row of sums is kept for each square root
    of their number, and the rows between are made again on the way back.
    """

    def __init__(self, a: Node, b: Node):
        self.numbers: dict[tuple, int] = {}
        self.shape: dict[int, int] = {}
        self.known: dict[tuple[int, int], tuple[int, list]] = {}
        self._number(a)
        self._number(b)

    def _number(self, node: Node) -> int:
        n = self.shape[id(node)] = self.numbers.setdefault((node.sig, *[self._number(c) for c in node.children]), len(self.numbers))
        return n

    def of(self, a: Node, b: Node) -> tuple[int, list]:
        """Size of the match of two nodes of one signature, and the matched (place of child, place of child, what is matched below them)."""
        x, y = a.children, b.children
        if not x or not y:
            return 1, []
        key = self.shape[id(a)], self.shape[id(b)]
        got = self.known.get(key)
        if got is None:
            got = self._aligned(x, y)
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[key] = got
        return got

    def _aligned(self, x: list[Node], y: list[Node]) -> tuple[int, list]:
        lo, total, below, shape = 0, 1, [], self.shape
        while lo < len(x) and lo < len(y) and shape[id(x[lo])] == shape[id(y[lo])]:  # equal shapes in front: no match is larger than one with both
            n, inner = self.of(x[lo], y[lo])
            total += n
            below.append((lo, lo, inner))
            lo += 1
        x, y = x[lo:], y[lo:]
        if not x or not y:
            return total, below
        for i, j in (self._short if len(x) * len(y) <= ALIGN * ALIGN else self._long)(x, y):
            n, inner = self.of(x[i], y[j])
            total += n
            below.append((lo + i, lo + j, inner))
        return total, below

    def _short(self, x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
        w = [[self.of(p, q)[0] if p.sig == q.sig else 0 for q in y] for p in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, under, of = best[i], best[i + 1], w[i]
            for j in range(len(y) - 1, -1, -1):
                v = under[j + 1] + of[j] if of[j] else 0
                row[j] = max(v, under[j], row[j + 1])
        return self._back(best, lambda i: w[i], 0, len(x), 0, len(y))[0]

    @staticmethod
    def _back(best, sizes, i: int, end: int, j: int, width: int) -> tuple[list[tuple[int, int]], int]:
        """The matched places from row ``i`` to ``end`` and column ``j`` on, and the column reached; ``best``: rows ``i`` to ``end`` of sums."""
        out, first = [], i
        while i < end and j < width:
            here, under, n = best[i - first], best[i - first + 1], sizes(i)[j]
            if n and here[j] == under[j + 1] + n:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif here[j] == under[j]:
                i += 1
            else:
                j += 1
        return out, j

    def _long(self, x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
        """As ``_short``, row by row on arrays."""
        place: dict[int, int] = {}
        of_y = np.array([place.setdefault(self.shape[id(q)], len(place)) for q in y])
        by_sig: dict[str, dict[int, Node]] = {}
        for q, k in zip(y, of_y.tolist()):
            by_sig.setdefault(q.sig, {})[k] = q
        rows: dict[int, np.ndarray] = {}

        def sizes(i: int) -> np.ndarray | None:
            p = x[i]
            at = self.shape[id(p)]
            if at not in rows:
                if len(rows) * len(y) > CELLS:
                    rows.clear()
                by_shape = np.zeros(len(place), np.int64)
                for k, q in by_sig.get(p.sig, {}).items():
                    by_shape[k] = self.of(p, q)[0]
                rows[at] = by_shape[of_y]
            return rows[at]

        def above(under: np.ndarray, i: int) -> np.ndarray:
            w = sizes(i)
            row = under.copy()
            np.maximum(row[:-1], np.where(w > 0, under[1:] + w, 0), out=row[:-1])
            return np.maximum.accumulate(row[::-1])[::-1]

        step = isqrt(len(x)) + 1
        row, kept = np.zeros(len(y) + 1, np.int64), {}
        for i in range(len(x), -1, -1):
            if i < len(x):
                row = above(row, i)
            if i % step == 0 or i == len(x):
                kept[i] = row
        out, j = [], 0
        for start in range(0, len(x), step):
            end = min(start + step, len(x))
            best = [kept[end]]
            for i in range(end - 1, start - 1, -1):
                best.append(above(best[-1], i))
            found, j = self._back(best[::-1], sizes, start, end, j, len(y))
            out += found
        return out


def _texts(node: Node) -> Iterator[str]:
    for c in node.children:
        if c.sig == "#text":
            yield c.text
        else:
            yield from _texts(c)


def _hash(*parts: str) -> int:
    """A signed 64-bit hash; never ``ALL``."""
    import xxhash
    h = xxhash.xxh64_intdigest("\0".join(parts)) or 1
    return h - (1 << 64) if h >> 63 else h


def node_hashes(node: Node, path: str = "") -> Iterator[tuple[Node, int]]:
    """Every text node with the hash of its path (signatures) and text."""
    for c in node.children:
        if c.sig == "#text":
            yield c, _hash(path, c.text)
        else:
            yield from node_hashes(c, f"{path}/{c.sig}")


def layout(root: Node) -> int:
    """Hash of the signatures of the page's top elements, numbers in them aside."""
    top = root
    while (inner := next((c for c in top.children if c.tag in ("html", "body")), None)) is not None:
        top = inner
    return _hash(re.sub(r"\d+", "0", top.sig), *sorted({re.sub(r"\d+", "0", c.sig) for c in top.children}))


def pack(root: Node, outside: bool = False) -> bytes:
    """A tree in page order, to send it on; ``outside``: without what stands in articles."""
    out, stack = [], [(0, root)]
    while stack:
        depth, node = stack.pop()
        out.append((depth, node.tag, node.sig, node.text, node.off))
        if not (outside and node.tag in ("article", "main")):
            stack.extend((depth + 1, c) for c in reversed(node.children))
    return marshal.dumps(out)


def unpack(data: bytes) -> Node:
    path: list[Node] = []
    for depth, tag, sig, text, off in marshal.loads(data):
        node = Node(tag, sig, text, off)
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def slots(base: Node, page: Node) -> list[int]:
    """For each text of ``base`` the hash of the text that ``page`` shows there, 0 if none; both without what stands in articles."""
    def nodes(node: Node) -> Iterator[Node]:
        for c in node.children:
            if c.sig == "#text":
                yield c
            else:
                yield from nodes(c)

    shown: dict[int, int] = {}
    pairs: list = []
    match(base, page, pairs)
    for a, b in pairs:
        shown[id(a)] = _hash(b.text)
    return [shown.get(id(c), 0) for c in nodes(base)]


def recurs(counts: list[tuple[int, int]], among: int = AMONG) -> bool:
    """Whether a slot's texts come back; ``counts``: numbers of pages that show a text, and how many texts so many pages show."""
    total = sum(n * texts for n, texts in counts)
    if total < MIN_PAGES:
        return False
    others = min(among, total) - 1
    # none of the others, drawn from all other pages, shows the text that n pages show
    share = sum(n * texts * (1 - prod(max(total - n - i, 0) / (total - 1 - i) for i in range(others))) for n, texts in counts)
    return share >= RECURRING * total


def reduced(tree: Node, constants: set[int], recurring: set[int]) -> str | None:
    """The wrapper as JSON: [signature, text, children] of what leads to template texts of ``tree``; a null text is any.

    ``constants``: node hashes that nearly all pages have; ``recurring``: slots (see ``slots``) whose texts come back.
    """
    constant, slot = {id(c) for c, h in node_hashes(tree) if h in constants}, count()

    def kept(node: Node, in_article: bool):
        if node.sig == "#text":
            back = not in_article and next(slot) in recurring
            if id(node) in constant:
                return [node.sig, node.text, []]
            return [node.sig, None, []] if back else None
        inside = in_article or node.tag in ("article", "main")
        below = [x for x in (kept(c, inside) for c in node.children) if x]
        return [node.sig, "", below] if below else None

    found = kept(tree, False)
    return json.dumps(found) if found else None


def induce(sources: list[str], constants: set[int] | None = None, among: int = AMONG) -> str | None:
    """The wrapper (see ``reduced``) of a few pages, as ``wrappers`` makes it of many.

    ``constants``: node hashes that nearly all pages have; without it, those nearly all of ``sources`` have.
    """
    distinct: dict[str, Node] = {}
    for s in sources:
        tree = parse(s)
        distinct.setdefault(max(_texts(tree), key=len, default=""), tree)
    trees = list(distinct.values())
    if len(trees) < MIN_PAGES:
        return None
    hashes = [{h for _, h in node_hashes(t)} for t in trees]
    if constants is None:
        constants = {h for h, n in Counter(h for x in hashes for h in x).items() if n >= CONSTANT * len(trees)}
    # all are aligned with the tree that shows most of the constant texts
    first = trees[max(range(len(trees)), key=lambda i: len(hashes[i] & constants))]
    base = unpack(pack(first, outside=True))
    shown = [Counter(x) for x in zip(*(slots(base, unpack(pack(t, outside=True))) for t in trees))]
    return reduced(first, constants, {i for i, c in enumerate(shown) if recurs(list(Counter(n for h, n in c.items() if h).items()), among)})


def _tree(x: list) -> Node:
    node = Node(x[0].split(".")[0], x[0], x[1])
    node.children = [_tree(c) for c in x[2]]
    return node


def unmark(root: Node) -> None:
    """Take marks back that hide all articles, or (where there is none) most of the page's text."""
    def size(node: Node) -> int:
        return sum(len(c.text) if c.sig == "#text" else size(c) for c in node.children)

    def blocks(node: Node, path: list[Node]) -> Iterator[list[Node]]:
        for c in node.children:
            if c.tag in ("article", "main"):
                yield [*path, c]
            if c.tag != "article":
                yield from blocks(c, [*path, c])

    found = list(blocks(root, []))
    articles = [x for x in found if x[-1].tag == "article"] or found
    if any(not any(n.off for n in path) for path in articles):
        return
    if articles:
        longest = max(articles, key=lambda path: size(path[-1]))
        for n in [*longest, *(path[-1] for path in articles)]:
            n.off = n.off and not n.marked
        return
    node, most = root, MOST * size(root)
    while node is not None:
        node = next((c for c in node.children if c.sig != "#text" and size(c) > most), None)
        if node is not None:
            node.off = node.off and not node.marked


def main_text(source: str, wrapper: Node | None) -> tuple[str, int]:
    """Main text of a page, and how many of its texts were the template's."""
    root = parse(source)
    unmark(root)
    return without(root, wrapper)


def without(root: Node, wrapper: Node | None) -> tuple[str, int]:
    """``main_text`` of a page's tree whose marks are settled."""
    fixed = 0
    if wrapper is not None:
        pairs: list = []
        match(wrapper, root, pairs)
        for a, b in pairs:
            if a.text is None or a.text == b.text:
                b.fixed = True
                fixed += 1

    def collect(node: Node, out: list[str]) -> list[str]:
        for c in node.children:
            if c.tag == "#text":
                if not c.fixed:
                    out.append(c.text)
            elif not c.off:
                collect(c, out)
        return out

    def find(node: Node, tag: str, out: list[Node]) -> list[Node]:
        for c in node.children:
            if c.tag == tag:
                out.append(c)
            elif not c.off:
                find(c, tag, out)
        return out

    for tag in ("article", "main"):
        parts = [" ".join(collect(x, [])) for x in find(root, tag, []) if not x.off]
        if any(parts):
            return " ".join(x for x in parts if x), fixed
    return " ".join(collect(root, [])), fixed


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def looked_at(pages: DataFrame) -> DataFrame:
    """Rows (at, host, layout, key, nodes) of pages: key is a hash of the longest text, nodes those of the texts."""
    arrow = pa.schema([("at", pa.int64()), ("host", pa.string()), ("layout", pa.int64()), ("key", pa.int64()), ("nodes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for x in batch.column(2):
                tree = parse(x.as_py())
                nodes = list(node_hashes(tree))
                for c, v in zip(out, (layout(tree), _hash(max((n.text for n, _ in nodes), key=len, default="")), sorted({h for _, h in nodes}))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array(c, f.type) for c, f in zip(out, list(arrow)[2:]))], schema=arrow)

    return pages.where("html is not null").select("at", "host", "html").mapInArrow(run, "at long, host string, layout long, key long, nodes array<long>")


def with_trees(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, host) as (page_id, url, host, layout, tree: packed, with marks settled; null if the html is)."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        layouts, trees = [], []
        for x in batch.column(2):
            root = parse(x.as_py()) if x.is_valid else None
            layouts.append(layout(root) if root else None)
            if root:
                unmark(root)
            trees.append(pack(root) if root else None)
        yield {"page_id": batch.column(0), "url": batch.column(1), "host": batch.column(3), "layout": layouts, "tree": trees}

    return map_rows(pages.select("page_id", "url", "html", "host"), run, "page_id long, url string, host string, layout long, tree binary")


def with_outlines(pages: DataFrame) -> DataFrame:
    """Rows (at, host, layout, key, outline) of pages: as ``looked_at``, and the packed tree without what stands in articles."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"layout": [], "key": [], "outline": []}
        for x in batch.column(2):
            root = parse(x.as_py())
            for c, v in zip(out.values(), (layout(root), _hash(max(_texts(root), key=len, default="")), pack(root, outside=True))):
                c.append(v)
        yield {"at": batch.column(0), "host": batch.column(1), **out}

    return map_rows(pages.where("html is not null").select("at", "host", "html"), run, "at long, host string, layout long, key long, outline binary")


def _sent(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def aligned(pages: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows (host, scope, key, at, shown: ``slots``) of all pages that a row of ``bases`` (host, scope, outline) is for, by its layout or for all layouts."""
    few = bases.count() <= BROADCAST_WRAPPERS
    own, common = (F.broadcast(x) if few else x for x in (bases.where(F.col("scope") != ALL).select("host", F.col("scope").alias("layout"), F.col("outline").alias("own")),
                                                          bases.where(F.col("scope") == ALL).select("host", F.col("outline").alias("common"))))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        trees: dict[bytes, Node] = {}
        out: dict[str, list] = {"host": [], "scope": [], "key": [], "at": [], "shown": []}
        for r in batch.to_pylist():
            page = unpack(r["outline"])
            for scope, base in ((r["layout"], r["own"]), (ALL, r["common"])):
                if base is not None:
                    if base not in trees:
                        trees[base] = unpack(base)
                    for c, v in zip(out.values(), (r["host"], scope, r["key"], r["at"], slots(trees[base], page))):
                        c.append(v)
        yield out

    met = with_outlines(pages).join(own, ["host", "layout"], "left").join(common, "host", "left").where("own is not null or common is not null")
    return map_rows(met.select("host", "layout", "key", "at", "outline", "own", "common"), run, "host string, scope long, key long, at long, shown array<long>")


def wrappers(pages: DataFrame, among: int = AMONG) -> DataFrame:
    """Rows (host, scope, wrapper), scope a layout or ``ALL``; ``pages``: page_id, host, html."""
    pages = pages.withColumn("at", F.xxhash64("page_id", "html"))
    looked = cut(looked_at(pages))
    several = cut(looked.groupBy("host").agg((F.min("layout") != F.max("layout")).alias("several")).where("several"))
    scoped = looked.join(_sent(several, BROADCAST_WRAPPERS), "host", "left").withColumn("scope", F.explode(F.when(F.col("several"), F.array("layout", F.lit(ALL).cast("long"))).otherwise(F.array("layout"))))
    # one page of each longest text; the others are its copies
    different = cut(scoped.groupBy("host", "scope", "key").agg(F.min(F.struct("at", "nodes")).alias("page")).select("host", "scope", "page.at", "page.nodes"))
    totals = cut(different.groupBy("host", "scope").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES))
    counts = different.select("host", "scope", F.explode("nodes").alias("node")).groupBy("host", "scope", "node").agg(F.count("*").alias("n")).where("n > 1")
    constant = counts.join(_sent(totals, BROADCAST_WRAPPERS), ["host", "scope"]).where(F.col("n") >= CONSTANT * F.col("pages"))
    constants = cut(totals.join(constant.groupBy("host", "scope").agg(F.collect_list("node").alias("constants")), ["host", "scope"], "left")
                    .select("host", "scope", F.coalesce("constants", F.array().cast("array<long>")).alias("constants")))
    # of each host and layout, all pages are aligned with the page that shows most of the constant texts
    has = F.size(F.array_intersect("nodes", "constants"))
    first = different.join(_sent(constants, BROADCAST_WRAPPERS), ["host", "scope"]).groupBy("host", "scope").agg(F.min_by("at", F.struct(-has, "at")).alias("at"))
    found = pages.where("html is not null").select("at", "host", "html").join(_sent(cut(first), BROADCAST_WRAPPERS), ["at", "host"]).dropDuplicates(["host", "scope"])

    def outlined(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {n: batch.column(i) for i, n in enumerate(("host", "scope", "html"))} | {"outline": [pack(parse(x.as_py()), outside=True) for x in batch.column(2)]}

    bases = cut(map_rows(found.select("host", "scope", "html"), outlined, "host string, scope long, html string, outline binary"))
    shown = aligned(pages, bases).groupBy("host", "scope", "key").agg(F.min(F.struct("at", "shown")).alias("page"))  # copies count once
    texts = shown.select("host", "scope", F.posexplode("page.shown").alias("slot", "text")).where("text != 0").groupBy("host", "scope", "slot", "text").agg(F.count("*").alias("n"))
    # a slot's texts by the number of pages that show them: few rows, however many pages
    spread = texts.groupBy("host", "scope", "slot", "n").agg(F.count("*").alias("texts")).groupBy("host", "scope").agg(F.collect_list(F.struct("slot", "n", "texts")).alias("spread"))

    def fit(batch: pa.RecordBatch) -> Iterator[dict]:
        made = []
        for r in batch.to_pylist():
            by_slot: dict[int, list] = {}
            for x in r["spread"] or ():
                by_slot.setdefault(x["slot"], []).append((x["n"], x["texts"]))
            made.append(reduced(parse(r["html"]), set(r["constants"]), {i for i, c in by_slot.items() if recurs(c, among)}))
        yield {"host": batch.column(0), "scope": batch.column(1), "wrapper": made}

    ready = bases.join(constants, ["host", "scope"]).join(spread, ["host", "scope"], "left").select("host", "scope", "html", "constants", "spread")
    return map_rows(ready, fit, "host string, scope long, wrapper string").where("wrapper is not null")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = AMONG) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points) and n_template (texts that were the host template's).

    ``sample``: number of pages that the share of recurring texts is stated for (``AMONG``); all pages are counted.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host(F.col("url")))
    made = cut(wrappers(rows, sample))
    few = made.count() <= BROADCAST_WRAPPERS
    own, common = (F.broadcast(x) if few else x for x in (made.where(F.col("scope") != ALL).withColumnRenamed("scope", "layout"), made.where(F.col("scope") == ALL).select("host", F.col("wrapper").alias("common"))))
    schema = "page_id long, url string, text string, n_chars long, n_template long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        for batch in batches:
            texts, numbers = [], []
            for source, wrapper in zip(batch.column(2), batch.column(3)):
                key = wrapper.as_py()
                if key is not None and key not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    trees[key] = _tree(json.loads(key))
                text, n = without(unpack(source.as_py()), trees.get(key) if key else None) if source.is_valid else ("", 0)
                texts.append(text)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(numbers, pa.int64())], schema=arrow)

    return with_trees(rows).join(own, ["host", "layout"], "left").join(common, "host", "left") \
        .select("page_id", "url", "tree", F.coalesce("wrapper", "common").alias("wrapper")).mapInArrow(run, schema)
