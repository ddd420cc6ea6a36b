"""HTML extraction by wrapper induction.

Pages of one host are aligned by simple tree matching into a wrapper tree, which
counts for each of its text nodes in how many pages it stands and which texts
recur there. A node with one text in most of its pages is constant and becomes
template; a node whose text varies is a slot and becomes content. Wrappers are
made from all pages, and every page is read through its host's. Each task merges
its pages, and a host's parts are then merged alike, so what meets in one task
grows with the number of tasks and not with the pages; a slot keeps a few counted
texts only (Misra and Gries).

Elements that are no part of an article by tag, class, id or role (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are left out first. A check follows where a page marks its article by
``article`` or ``main``: constant texts within it are put back, and slots outside
it go. Parsing, alignment and reading keep their own stacks, so neither depth nor
length of a page has a limit.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.common import checkpointed, in_batches, joined_labels
from trawl.llm.url_filter import split_url

#: A text is template in at least this many pages and this share of those that have its node.
LEAST_PAGES, LEAST_SHARE = 3, 0.6
#: A page of which less than this share would stay is a copy of others, and keeps its template texts.
LEAST_LEFT = 0.25
#: Texts that a node of a wrapper counts: a text in more than one of nine pages of a node is among them.
COUNTED = 8
#: Nodes of a host's wrappers that a task holds at once; then it hands them on.
HELD_NODES = 100_000
#: All wrappers together are sent to every task up to this size; beyond, only those of the hosts with most pages are.
BROADCAST_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and of which nothing is read.
RAW = frozenset("script style textarea iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
IN_HEAD = frozenset("title meta link base style script noscript template".split())
NOT_ARTICLE = RAW | frozenset("head nav footer aside button select option datalist menu dialog template svg".split())
#: Elements that a start tag ends when they are open within the nearest of the scopes.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words of classes and ids outside an article.
CHROME = re.compile(
    r"(?:^|[\s_-])(ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|side|sidebar\w*|skip|social|sponsor\w*|subscribe|"
    r"toolbar|topbar|widget)(?:$|[\s_-])", re.I)  # fmt: skip
#: Whole classes and ids within an article, where a word alone may be part of what the article calls its own parts.
CHROME_WITHIN = re.compile(
    r"(?:^|\s)(?:(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*)(?:[_-](?:box|slot|unit|block|container|wrapper|area|bar))?|"
    r"(?:site|main|page|side)?[_-]?(?:nav|navbar|navigation|menu|sidebar|footer|breadcrumbs?|toolbar|topbar)|"
    r"(?:comments?|disqus|respond|replies)(?:[_-](?:list|section|area|thread|box|form))?|commentlist|"
    r"(?:cookies?|consent|newsletter|popup|modal|subscribe|notices?)(?:[_-](?:box|bar|banner|notice|form|signup))?|"
    r"(?:share|sharing|social)(?:[_-](?:bar|box|buttons?|links?|icons?|media))?|"
    r"(?:related|recommended)(?:[_-](?:posts?|articles?|stories|links|content))?|widget)(?:$|\s)", re.I)  # fmt: skip
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLE = frozenset(("article", "main"))
#: Cells of a table of matchings that is held whole; larger ones are halved until they fit, with the same matching size.
HELD_CELLS = 1 << 21
#: Where a block stands: outside what the page marks, in a ``main`` beside the article that it holds, in the article.
OUTSIDE, BESIDE, WITHIN = 0, 1, 2
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
TEXT = "#"


class Node:
    """An element, or a text when ``tag`` is ``#``; ``names`` are class and id."""

    __slots__ = ("tag", "label", "children", "text", "names", "role", "hidden", "chrome")

    def __init__(self, tag: str, label: str = "", text: str = "", names: str = "", role: str = "", hidden: bool = False):
        self.tag, self.label, self.text, self.names, self.role, self.hidden = tag, label or tag, text, names, role, hidden
        self.children: list[Node] = []
        self.chrome = False


def parse(source: str) -> Node:
    """The element tree; comments, declarations and a tag cut off by the end are left out, character references decoded."""
    root = Node("root")
    stack, at, n = [root], 0, len(source)

    def text(part: str) -> None:
        if not part:
            return
        if stack[-1].tag == "head" and not part.isspace():
            stack.pop()
        stack[-1].children.append(Node(TEXT, text=entities.unescape(part)))

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        if tag in BLOCK:
            _end(stack, {"p"}, {"table", "button"})
        if tag in ENDS:
            _end(stack, *ENDS[tag])
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        hidden = "hidden" in m[3].lower() and ("hidden" in m[3].lower().split() or attributes.get("aria-hidden") == "true")
        label = f"{tag}.{attributes['class']}" if attributes.get("class") else tag
        node = Node(tag, label, "", names, attributes.get("role", "").lower(), hidden)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _end(stack: list[Node], tags: set[str], scopes: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scopes:
            return


def squeezed(text: str) -> str:
    return " ".join(text.split())


def _is_chrome(node: Node, inside: bool) -> bool:
    if node.tag in ("html", "body"):
        return False
    if node.hidden or node.tag in NOT_ARTICLE or node.role in CHROME_ROLES:
        return True
    if inside or node.tag in ARTICLE:
        return node.tag != "main" and bool(CHROME_WITHIN.search(node.names))
    return node.tag == "header" or bool(CHROME.search(node.names))


def marked(root: Node) -> tuple[Node, list[Node]]:
    """The tree with chrome marked, and the outermost elements that mark its article.

    A form is chrome unless it holds such an element or, where none is there,
    most of the text that the page would have: some servers put whole pages in one.
    """
    articles: list[Node] = []
    forms: list[Node] = []
    stack = [(root, False, False)]
    parents: dict[int, Node] = {}
    order: list[Node] = []
    while stack:
        node, inside, out = stack.pop()
        order.append(node)
        if node.tag != TEXT:
            node.chrome = _is_chrome(node, inside)
            out = out or node.chrome
            if node.tag == "form" and not out:
                forms.append(node)
            if node.tag in ARTICLE and not out and not inside:
                articles.append(node)
                inside = True
        for c in reversed(node.children):
            parents[id(c)] = node
            stack.append((c, inside, out))
    if forms:
        size: dict[int, int] = {}
        holds = {id(a) for a in articles}
        for node in reversed(order):
            if node.chrome:
                continue
            size[id(node)] = len(squeezed(node.text)) + sum(size.get(id(c), 0) for c in node.children)
            if id(node) in holds and id(node) in parents:
                holds.add(id(parents[id(node)]))
        for form in forms:
            whole = not articles and 2 * size.get(id(form), 0) > size.get(id(root), 0)
            form.chrome = id(form) not in holds and not whole
    return root, [a for a in articles if not _within_chrome(a, parents)]


def _within_chrome(node: Node, parents: dict[int, Node]) -> bool:
    while (node := parents.get(id(node))) is not None:
        if node.chrome:
            return True
    return False


def _hash(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), path)


# --- alignment ------------------------------------------------------------------------------------------------------------


class Wrapped:
    """A node of a wrapper: in how many pages it stands, and counts of the texts (by hash) that recur there."""

    __slots__ = ("label", "children", "count", "texts", "shape")

    def __init__(self, label: str, count: int = 1, texts: dict[int, int] | None = None):
        self.label, self.count, self.texts = label, count, texts or {}
        self.children: list[Wrapped] = []
        self.shape = -1


def counted(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    """Misra and Gries' summary of two summaries."""
    out = dict(a)
    for k, n in b.items():
        out[k] = out.get(k, 0) + n
    if len(out) > COUNTED:
        least = sorted(out.values(), reverse=True)[COUNTED]
        out = {k: n - least for k, n in out.items() if n > least}
    return out


def wrapped(root: Node) -> Wrapped:
    """A page as a wrapper of itself: elements that are chrome and blank texts are left out."""
    top = Wrapped(root.label)
    stack = [(root, top)]
    while stack:
        node, out = stack.pop()
        for c in node.children:
            if c.chrome or c.tag == TEXT and not c.text.strip():
                continue
            made = Wrapped(c.label, 1, {_hash(0, squeezed(c.text)): 1} if c.tag == TEXT else None)
            out.children.append(made)
            if c.children:
                stack.append((c, made))
    return top


class Shapes:
    """Structures of trees as numbers; ``match`` is the size of the largest order- and level-preserving matching of two with equal roots."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.of: list[tuple[str, tuple, int]] = []
        self.memo: dict[tuple[int, int], int] = {}

    def number(self, root: Wrapped) -> None:
        """Number every node of a tree, from the leaves up."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children
        for node in reversed(order):
            key = (node.label, tuple(c.shape for c in node.children))
            if key not in self.numbers:
                self.numbers[key] = len(self.of)
                self.of.append((*key, 1 + sum(self.of[c][2] for c in key[1])))
            node.shape = self.numbers[key]

    def match(self, a: int, b: int) -> int:
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.memo:
                stack.pop()
            elif x == y:
                self.memo[x, y] = self.of[x][2]
            elif self.of[x][0] != self.of[y][0]:
                self.memo[x, y] = 0
            else:
                _, left, right, _ = apart(self.of[x][1], self.of[y][1])
                missing = {(p, q) for p in set(left) for q in set(right) if (p, q) not in self.memo}
                if missing:
                    stack += missing
                else:
                    alike = (self.of[x][2] - 1) - sum(self.of[p][2] for p in left)
                    self.memo[x, y] = 1 + alike + int(self.table(left, right, last=True)[-1])
        return self.memo[a, b]

    def table(self, left: tuple, right: tuple, last: bool = False) -> np.ndarray:
        """Best matchings of all beginnings of two rows of children whose pairs are known, or the ``last`` row of these alone."""
        out = np.zeros((2 if last else len(left) + 1, len(right) + 1), np.int64)
        kinds, at = np.unique(np.array(right, np.int64), return_inverse=True)
        gains = {p: np.array([self.memo[p, q] for q in kinds.tolist()], np.int64) for p in set(left)}
        for i, p in enumerate(left):
            above, row = (out[i % 2], out[1 - i % 2]) if last else (out[i], out[i + 1])
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gains[p][at]), out=row[1:])
        return out[len(left) % 2] if last else out

    def pairs(self, left: tuple, right: tuple) -> list[tuple[int, int]]:
        """Places of the children that a best matching of two rows pairs, in order."""
        found: list[tuple[int, int]] = []
        stack = [(0, len(left), 0, len(right))]
        while stack:
            a, b, c, d = stack.pop()
            if b - a > 1 and (b - a + 1) * (d - c + 1) > HELD_CELLS:
                half = (a + b) // 2
                ends = self.table(left[half:b][::-1], right[c:d][::-1], last=True)[::-1]
                cut = c + int(np.argmax(self.table(left[a:half], right[c:d], last=True) + ends))
                stack += [(a, half, c, cut), (half, b, cut, d)]
                continue
            table, i, j = self.table(left[a:b], right[c:d]), b - a, d - c
            while i and j:
                m = self.memo[left[a + i - 1], right[c + j - 1]]
                if m and table[i, j] == table[i - 1, j - 1] + m:
                    found.append((a + i - 1, c + j - 1))
                    i, j = i - 1, j - 1
                elif table[i, j] == table[i - 1, j]:
                    i -= 1
                else:
                    j -= 1
        return sorted(found)


def apart(left: tuple, right: tuple) -> tuple[int, tuple, tuple, int]:
    """(length of the equal beginnings of two rows, what lies between, length of the equal ends).

    A best matching pairs equal beginnings and ends node by node, as no node matches more than its own size.
    """
    least = min(len(left), len(right))
    begin = next((i for i in range(least) if left[i] != right[i]), least)
    end = next((i for i in range(least - begin) if left[-1 - i] != right[-1 - i]), least - begin)
    return begin, left[begin : len(left) - end], right[begin : len(right) - end], end


def merge(wrapper: Wrapped, page: Wrapped) -> None:
    """Align two wrappers: matched nodes add their counts, the other nodes of the second are inserted where they stand."""
    shapes = Shapes()
    shapes.number(wrapper)
    shapes.number(page)
    shapes.match(wrapper.shape, page.shape)
    stack = [(wrapper, page)]
    while stack:
        a, b = stack.pop()
        a.count += b.count
        a.texts = counted(a.texts, b.texts)
        begin, left, right, end = apart(tuple(c.shape for c in a.children), tuple(c.shape for c in b.children))
        stack += zip(a.children[:begin], b.children[:begin], strict=True)
        stack += zip(a.children[begin + len(left) :], b.children[begin + len(right) :], strict=True)
        for p in set(left):
            for q in set(right):
                shapes.match(p, q)
        row, i, j = [], begin, begin
        for x, y in [*(shapes.pairs(left, right) if left and right else ()), (len(left), len(right))]:
            row += b.children[j : begin + y] + a.children[i : begin + x]
            i, j = begin + x + 1, begin + y + 1
            if x < len(left):
                stack.append((a.children[begin + x], b.children[begin + y]))
                row.append(a.children[begin + x])
        a.children[begin : begin + len(left)] = row


class Merged:
    """Wrappers merged two of a rank at a time, so that most merges are of small ones."""

    def __init__(self):
        self.ranks: list[tuple[int, Wrapped]] = []

    def add(self, wrapper: Wrapped) -> None:
        rank = 0
        while self.ranks and self.ranks[-1][0] == rank:
            first = self.ranks.pop()[1]
            merge(first, wrapper)
            wrapper, rank = first, rank + 1
        self.ranks.append((rank, wrapper))

    def whole(self) -> Wrapped | None:
        """All of them as one."""
        while len(self.ranks) > 1:
            last = self.ranks.pop()[1]
            merge(self.ranks[-1][1], last)
        return self.ranks[0][1] if self.ranks else None


def size(root: Wrapped) -> int:
    n, stack = 0, [root]
    while stack:
        node = stack.pop()
        n += 1
        stack += node.children
    return n


def packed(root: Wrapped) -> str:
    """A wrapper as JSON: its nodes in order, each with the number of its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append([node.label, node.count, len(node.children), [[str(k), n] for k, n in node.texts.items()]])
        stack += reversed(node.children)
    return json.dumps(out)


def unpacked(text: str) -> Wrapped:
    top = Wrapped("", 0)
    open_ = [(top, 1)]
    for label, count, n, texts in json.loads(text):
        parent, left = open_.pop()
        node = Wrapped(label, count, {int(k): c for k, c in texts})
        parent.children.append(node)
        if left > 1:
            open_.append((parent, left - 1))
        if n:
            open_.append((node, n))
    return top.children[0]


def template(root: Wrapped) -> bytes:
    """Hashes of (path, text) of a wrapper's constant texts, sorted, eight bytes each."""
    out, stack = set(), [(root, 0)]
    while stack:
        node, path = stack.pop()
        for text, n in node.texts.items():
            if n >= max(LEAST_PAGES, LEAST_SHARE * node.count):
                out.add(_hash(path, str(text)))
        stack += ((c, _hash(path, c.label)) for c in node.children)
    return np.array(sorted(out), np.uint64).tobytes()


def induce(pages: list[str]) -> bytes:
    """The template of pages of one host; copies of one page count once."""
    merged = Merged()
    for source in dict.fromkeys(pages):
        merged.add(wrapped(marked(parse(source))[0]))
    whole = merged.whole()
    return template(whole) if whole is not None else b""


# --- reading ----------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _constant(wrapper: bytes) -> frozenset[int]:
    return frozenset(np.frombuffer(wrapper, np.uint64).tolist())


def _holds_article(main: Node) -> bool:
    stack = list(main.children)
    while stack:
        node = stack.pop()
        if not node.chrome:
            if node.tag == "article":
                return True
            stack += node.children
    return False


def _blocks(root: Node, articles: list[Node], constant: frozenset[int]) -> Iterator[tuple[str, bool, int]]:
    """(text, whether any of it varies, where it stands) of each block of a page, in page order."""
    marks = {id(a): BESIDE if a.tag == "main" and _holds_article(a) else WITHIN for a in articles}
    said: list[str] = []
    varies, at = False, OUTSIDE
    stack: list[tuple[Node | None, int, int]] = [(c, 0, OUTSIDE) for c in reversed(root.children)]
    while stack:
        node, path, place = stack.pop()
        if node is not None and node.tag == TEXT:
            said.append(node.text)
            at = place
            if not varies and (text := squeezed(node.text)):
                varies = not constant or _hash(_hash(path, TEXT), str(_hash(0, text))) not in constant
        elif node is not None and node.tag == "br":
            said.append(" ")
        elif node is None or not node.chrome:
            if node is None or node.tag in BLOCK:
                yield squeezed("".join(said)), varies, at
                said, varies = [], False
            if node is not None:
                place = marks.get(id(node), WITHIN if place == BESIDE and node.tag == "article" else place)
                below = _hash(path, node.label) if constant else 0
                if node.tag in BLOCK:
                    stack.append((None, 0, place))
                stack += ((c, below, place) for c in reversed(node.children))
    yield squeezed("".join(said)), varies, at


def extract(source: str, wrapper: bytes = b"") -> str:
    """Main text of a page: one line a block, white space in a block as single spaces.

    The slots: all blocks that are no chrome and hold a text which the wrapper
    doesn't know as constant there, or all blocks where hardly any would be left.
    Where elements mark the article, only blocks in them count, and its constant
    blocks are put back. A ``main`` that holds an ``article`` marks by it: beside
    the article, slots of ``main`` stay.
    """
    root, articles = marked(parse(source))
    blocks = [b for b in _blocks(root, articles, _constant(wrapper)) if b[0] and (b[2] != OUTSIDE or not articles)]
    left = sum(len(t) for t, varies, at in blocks if varies or at == WITHIN)
    whole = left < LEAST_LEFT * sum(len(t) for t, _, _ in blocks)
    return "\n".join(t for t, varies, at in blocks if varies or at == WITHIN or whole)


def wrappers(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """(host, wrapper, held): constant texts of each host's pages, and how many rows they are; copies of one html count once.

    Pages are moved as trees of labels and hashes of texts, not as html.
    """
    rows = pages.select(F.col(host_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    held = rows.groupBy("host").agg(F.count("*").alias("held"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [packed(wrapped(marked(parse(source.as_py()))[0])) for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees, pa.string())], ["host", "h", "tree"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([packed(merged.whole())], pa.string())], ["host", "tree"])

        now, merged, nodes = None, Merged(), 0
        for batch in batches:
            for host, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if merged.ranks and (host != now or nodes >= HELD_NODES and (nodes := size(merged.whole())) >= HELD_NODES):
                    yield row()
                    merged, nodes = Merged(), 0
                now, page = host, unpacked(tree.as_py())
                nodes += size(page)
                merged.add(page)
        if merged.ranks:
            yield row()

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        merged = Merged()
        for t in sorted(group["tree"]):
            merged.add(unpacked(t))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [template(merged.whole())]})

    trees = in_batches(rows.select("host", F.xxhash64("html").alias("h"), "html"), parsed, "host string, h bigint, tree string")
    once = trees.dropDuplicates(["host", "h"]).sortWithinPartitions("host", "h").select("host", "tree")
    made = in_batches(once, part, "host string, tree string").groupBy("host").applyInPandas(whole, "host string, wrapper binary")
    return made.join(held, "host")


def main_text(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``df`` without its html and with main_text and main_chars (code points) for each page, repeated rows included.

    Null html counts as empty and gives the empty text; pages without a host
    form one host. Nothing is cut: the whole page is read, however long or deep.
    Columns named like the new ones are dropped. An empty table gives no rows.
    """
    others = [c for c in df.columns if c != html_col and c.lower() not in ("main_text", "main_chars")]
    keyed = df.select(*others, html_col, F.coalesce(split_url(F.col(url_col))[0], F.lit("")).alias("_host"))
    made = checkpointed(wrappers(keyed, "_host", html_col))
    bytes_ = made.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0
    if bytes_ <= BROADCAST_BYTES:
        named = F.broadcast(made.select(F.col("host").alias("_known"), F.col("wrapper").alias("_wrapper")))
        joined = keyed.join(named, F.col("_host") == F.col("_known"), "left").drop("_known")
    else:
        named = made.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"), "held")
        joined = joined_labels(keyed, named, "_host")
    schema = T.StructType([*df.select(*others).schema.fields, T.StructField("main_text", T.StringType()), T.StructField("main_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(html_col), batch.column("_wrapper").dictionary_encode().to_pylist(), strict=True)
            texts = [extract(h.as_py() or "", w or b"") for h, w in rows]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], schema.fieldNames())

    return in_batches(joined.drop("_host"), run, schema)
