"""Main text of HTML pages by union-free regular-expression wrappers.

A page is read as a stream of tags and texts, nested by the tags. A wrapper is a
union-free regular expression over such streams: items in order, each once (1),
optional (?), repeated (+) or both (*), with text slots or texts that never change.
Streams are aligned one after the other with the wrapper so far (by their longest matching
runs of keys): items that only one side has become optional, neighbours with the same key
and repeating groups of items become repeated, texts that differ become slots. Pages of a
host with the same tags and texts count once, whatever their scripts and comments. The
different ones meet by host and a salt from what they hold, in order, so that no task gets
a hot host whole and the wrapper and its counts do not depend on how the pages are dealt
out; then the salts of a host meet.

The wrapper says where a host's content part is: its outermost article items, else its main
items, else the innermost item that holds nearly all text of slots, repeated and optional
items, there from the first such child to the last. Every page is aligned with its host's
wrapper, place by place, and its text is what stands in the content part (and article or
main elements that fit no place). Nothing in the content part is template. Outside of it,
which counts on hosts without article and main only, a text goes if it never changes at its
place and stands there on nearly all (TEMPLATE_SHARE) of at least TEMPLATE_PAGES different
pages. In every part, menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments go, told by element, role and whole class or id tokens (a number
at a token's end is left out: ad-2; "share-price" and "has-sidebar" are no marks). Where the
only article or main stands inside of what a token marks, the longer text counts: its own,
or the one found without it.

Defined results: null or empty html has empty text; pages without url share one host;
cut-off pages, unclosed elements and stray "<" are read as browsers do (a paragraph ends
where the next block begins; from DEEPEST open elements on, further ones are not nested, as
browsers also have a bound, and no text is lost); white space inside a block, including
no-break spaces, becomes one space. Pages of any length and width are read whole. Rows that
repeat a page_id are pages of their own; an empty table gives an empty one; further columns
are carried along by extract(), but for those with the names of results (text, n_chars).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections import Counter as Names
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import carried, hashable, table, written

TEMPLATE_PAGES, TEMPLATE_SHARE, CONTENT_SHARE, DEEPEST, KEYS_HELD = 3, 0.9, 0.8, 150, 100_000
#: A host with more than SALT_PAGES pages is dealt to several tasks. More than HOT_HOSTS such hosts cannot be: beyond that many, SALT_PAGES grows.
SALT_PAGES, HOT_HOSTS = 100, 50_000
#: Wrappers of so many bytes in all are broadcast; beyond, pages meet them by host and salt.
BROADCAST_BYTES = 16_000_000
#: Later places of a key at which a repeating group may begin again.
AGAIN = 8

# HTML's element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form iframe object svg canvas button select textarea input menu dialog noembed noframes".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent notice notices gdpr nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond share sharing social related newsletter subscribe subscription signup login popup modal overlay pager pagination widget".split())
CHROME_TOKENS = CHROME_WORDS | frozenset("ad-banner ad-container ad-slot ad-unit ad-wrapper banner-ad comment-list comment-respond comments-area comments-list comments-section cookie-banner cookie-bar cookie-consent cookie-notice footer-links login-form main-menu main-nav main-navigation nav-links nav-menu navbar-nav newsletter-form newsletter-signup page-footer page-navigation post-navigation privacy-notice promo-box related-articles related-links related-posts share-bar share-buttons share-links sidebar-widget signup-form site-footer site-nav site-navigation social-icons social-links social-share top-nav widget-area".split())
# a new element on the left ends an open element on the right
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<(?![a-zA-Z/!?])|</(?![a-zA-Z])|[^<]+", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NUMBER = re.compile(r"[-_]*[0-9]+\Z")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element, or a text if children is None."""

    __slots__ = ("name", "key", "chrome", "children", "text", "fixed", "marked", "content")

    def __init__(self, name: str, key: str, chrome: bool, children: list | None, text: str = "") -> None:
        self.name, self.key, self.chrome, self.children, self.text, self.fixed, self.marked, self.content = name, key, chrome, children, text, False, False, ""


class Open:
    """Elements that are open, the innermost last, and how often each name is among them."""

    def __init__(self) -> None:
        self.nodes, self.names = [Node("#root", "#root", False, [])], Names()

    def add(self, node: Node) -> None:
        self.place(node)
        self.nodes.append(node)
        self.names[node.name] += 1

    def place(self, node: Node) -> None:
        """Put a node where it belongs: below the innermost element, or, deeper than DEEPEST, below the last one above that."""
        top = self.nodes[-1]
        if len(self.nodes) > DEEPEST:
            if top.chrome or top.marked:
                if node.children is None:
                    return  # a text of what never is content
                node.chrome, node.marked = node.chrome or top.chrome, node.marked or top.marked
            top = self.nodes[DEEPEST - 1]
        last = top.children[-1] if top.children else None
        if node.children is None and last is not None and last.children is None:
            last.text += node.text
        else:
            top.children.append(node)

    def cut(self, at: int) -> None:
        """End all elements from place at on."""
        block = None
        for node in self.nodes[at:]:
            self.names[node.name] -= 1
            if node.name in BLOCK:
                block = node
        deep = len(self.nodes) > DEEPEST
        del self.nodes[at:]
        if deep and block is not None:  # what follows is another block
            self.nodes[min(at, DEEPEST) - 1].children.append(Node(block.name, block.key, False, []))

    def end(self, name: str) -> None:
        if self.names[name] > 0:
            at = len(self.nodes) - 1
            while self.nodes[at].name != name:
                at -= 1
            self.cut(at)

    def make_way(self, name: str) -> None:
        """End elements that a new one ends: an open paragraph at a block, a list item at the next."""
        nodes = self.nodes
        if self.names["p"] > 0 and name in BLOCK and name not in ("tr", "tbody", "tfoot", "thead", "caption"):
            for i in range(len(nodes) - 1, 0, -1):
                if nodes[i].name == "p":
                    self.cut(i)
                    break
                if nodes[i].name in BLOCK or nodes[i].name in ("td", "th", "button"):
                    break
        ends, stops = CLOSES.get(name, ()), STOPS.get(name, ())
        if any(self.names[x] > 0 for x in ends):
            cut = None
            for i in range(len(nodes) - 1, 0, -1):
                if nodes[i].name in stops:
                    break
                if nodes[i].name in ends:
                    cut = i
            if cut is not None:
                self.cut(cut)


def parse(html: str) -> Node:
    open_ = Open()
    root = open_.nodes[0]
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if m is None:
            open_.place(Node("#text", "#", False, None, html[at]))
            at += 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            whole = m[0]
            if whole[0] != "<" or len(whole) <= 2 and whole[-1:] != ">":  # text, or a "<" that begins nothing
                open_.place(Node("#text", "#", False, None, whole))
            continue
        name = name.lower()
        if m[1]:
            open_.end(name)
            continue
        tokens, role, hidden, key = (), "", False, name
        if m[3].strip():
            for k, a, b, c in _ATTRIBUTE.findall(m[3]):
                k, value = k.lower(), (a or b or c).lower()
                if k == "role":
                    role = value.strip()
                elif k in ("class", "id"):
                    tokens = (*tokens, *(_NUMBER.sub("", x).replace("_", "-") for x in value.split()))
                    if k == "class":
                        key = f"{name}.{'.'.join(_DIGITS.sub('0', value).split())}"  # post-17 and post-18 are one place
                else:
                    hidden = hidden or k == "hidden" or value == "true"
        chrome = name in DROPPED or hidden or role in CHROME_ROLES
        if name == "article" and not {"comment", "comments"}.isdisjoint(tokens):
            chrome = True
        node = Node(name, key, chrome, [])
        node.marked = not CHROME_TOKENS.isdisjoint(tokens) and name not in ("html", "body", "article", "main")
        if name in BLOCK or name in CLOSES:
            open_.make_way(name)
        if name in RAW:
            open_.place(node)
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
        elif name in VOID or name == "svg" and m[3].rstrip().endswith("/"):
            open_.place(node)
        else:
            open_.add(node)
    return root


# -- wrappers: items are [key, quantifier, items below, [unchanging text or "", pages it stands on, characters] or None] --
def _text_key(text: str) -> str:
    return hashlib.md5(" ".join(text.split()).encode("utf-8", "surrogatepass")).hexdigest()[:12]


def expression(node: Node, seen: list[str] | None = None) -> list:
    """A page's own expression: every subtree an item, repeats folded. Without what never is content.

    seen gets the keys and texts as they stand before folding.
    """
    below, seen = [], [] if seen is None else seen
    seen.append(node.key)
    for c in _placed(node):
        if c.children is None:
            seen.append(text := _text_key(c.text))
            below.append(["#", "1", [], [text, 1, len(c.text)]])
        else:
            below.append(expression(c, seen))
    seen.append("/")
    return [node.key, "1", fold(below), None]


def _placed(node: Node) -> list[Node]:
    """Children that have a place in expressions."""
    return [c for c in node.children if (c.text.strip() if c.children is None else c.name not in RAW and not c.chrome)]


_EITHER = {"11": "1", "1?": "?", "1+": "+", "1*": "*", "??": "?", "?+": "*", "?*": "*", "++": "+", "+*": "*", "**": "*"}


def _quantifier(a: str, b: str) -> str:
    return _EITHER.get(a + b) or _EITHER[b + a]


def _optional(item: list) -> list:
    return [item[0], {"1": "?", "+": "*"}.get(item[1], item[1]), item[2], item[3]]


def _unchanged(a: list | None, b: list | None, apart: bool) -> list | None:
    """Text, pages and characters of two items. apart: they are of different pages; else of the same ones, or nobody knows."""
    if a is None or b is None:
        return None
    return [a[0] if a[0] == b[0] else "", a[1] + b[1] if apart else max(a[1], b[1]), a[2] + b[2]]


def merge_items(a: list, b: list, apart: bool = True) -> list:
    """One item that matches what either of two items with the same key matches."""
    return [a[0], _quantifier(a[1], b[1]), merge(a[2], b[2], apart), _unchanged(a[3], b[3], apart)]


def merge(a: list[list], b: list[list], apart: bool = True) -> list[list]:
    """Align two expressions: common items meet, others become optional."""
    x_keys, y_keys = [x[0] for x in a], [y[0] for y in b]
    if x_keys == y_keys:
        return fold([merge_items(x, y, apart) for x, y in zip(a, b)])
    out: list[list] = []
    for what, i, j, k, m in SequenceMatcher(None, x_keys, y_keys, autojunk=False).get_opcodes():
        if what == "equal":
            out += [merge_items(x, y, apart) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [_optional(x) for x in (*a[i:j], *b[k:m])]
    return fold(out)


def fold(items: list[list]) -> list[list]:
    """Neighbours with one key become one repeated item; a group of items that comes again, a repeated group."""
    near: list[list] = []
    for x in items:
        if near and near[-1][0] == x[0]:
            last = near.pop()
            many = "*" if last[1] in "?*" and x[1] in "?*" else "+"
            x = [x[0], many, merge(last[2], x[2], False), _unchanged(last[3], x[3], False)]
        near.append(x)
    if len(near) < 3:
        return near
    keys, places = [x[0] for x in near], {}
    for i, k in enumerate(keys):
        places.setdefault(k, []).append(i)
    out, i = [], 0
    while i < len(near):
        if keys[i] == "()":
            group, base, j = near[i][2], [x[0] for x in near[i][2]], i + 1
        else:
            k = bisect_right(places[keys[i]], i)
            again = (j for j in places[keys[i]][k : k + AGAIN] if 2 * j - i <= len(near) and keys[i + 1] == keys[j + 1] and keys[i:j] == keys[j : 2 * j - i])
            j = next(again, 0)
            group, base = near[i:j], keys[i:j]
        if j and keys[j : j + len(base)] == base:
            group = fold(group)
            while keys[j : j + len(base)] == base:
                group = merge(group, fold(near[j : j + len(base)]), False)
                j += len(base)
            out.append(["()", "+", group, None])
            i = j
        else:
            out.append(near[i])
            i += 1
    return out


def _weight(item: list, many: bool = False) -> int:
    """Characters below an item that are no unchanging text."""
    many = many or item[1] != "1"
    own = item[3][2] if item[3] and (many or not item[3][0]) else 0
    return own + sum(_weight(x, many) for x in item[2])


def content_part(items: list[list]) -> tuple[str, list]:
    """Kind (article, main or slots) and the content items of a wrapper; for slots one item, its first and its last child."""
    for kind in ("article", "main"):
        found, todo = [], list(items)
        while todo:
            x = todo.pop()
            name, *tokens = x[0].split(".")
            if name == kind:
                found.append(x)
            elif CHROME_TOKENS.isdisjoint(tokens):
                todo += x[2]
        if found:
            return kind, found
    at = ["", "1", items, None]
    while True:
        weights = [_weight(x) for x in at[2]]
        inner = next((x for x, w in zip(at[2], weights) if w and w >= CONTENT_SHARE * sum(weights)), None)
        if inner is None or inner[1] != "1" or not inner[2]:
            some = [x for x, w in zip(at[2], weights) if w]
            return "slots", [at, some[0], some[-1]] if some else []
        at = inner


class Places:
    """Items below one wrapper item as an automaton over keys, to align a page's children with them."""

    def __init__(self, items: list[list], pages: float, part: tuple[str, list] | None = None) -> None:
        """pages: on how many a template text stands. part: the content part; in it, nothing is told apart."""
        kind, content = content_part(items) if part is None else part
        self.pages, self.part, self.kind = pages, (kind, content), kind
        self.content = {id(x) for x in content} if kind != "slots" else set()
        self.bounds = {id(x) for x in content[1:]} if kind == "slots" else set()
        self.inside = False  # between the first and the last child with slots
        self.empty: list[list[int]] = []  # moves without a child, by state
        self.takes: dict[int, tuple[str, str | None, Places | None, int, str]] = {}  # state: key, template text, places below if they matter, next state, kind of content
        self.known: dict[int, dict[str, list[int]]] = {}
        self.start = self._state()
        self.end = self._add(items, self.start, False)
        self.matters = any(t[1] or t[2] or t[4] for t in self.takes.values())

    def _state(self) -> int:
        self.empty.append([])
        return len(self.empty) - 1

    def _add(self, items: list[list], at: int, repeated: bool) -> int:
        for x in items:
            key, quantifier, below, text = x
            kind = self.kind if id(x) in self.content else ""
            edge = id(x) in self.bounds
            opens = edge and not self.inside
            kept = self.inside or edge  # in the content part
            if opens:
                self.inside = len(self.bounds) > 1
            elif edge:
                self.inside = False
            a, end = self._state(), self._state()
            many = repeated or quantifier in "+*"
            if key == "()":
                b = self._add(below, a, many)
            else:
                b = self._state()
                inner = None if not below or kind or kept else Places(below, self.pages, self.part)
                fixed = text and text[0] and not many and not kept and self.kind == "slots" and quantifier == "1" and text[1] >= self.pages
                self.takes[a] = (key, text[0] if fixed else None, inner if inner and inner.matters else None, b, kind)
            self.empty[at].append(a)
            self.empty[b].append(end)
            if quantifier in "+*":
                self.empty[b].append(a)
            if quantifier in "?*":
                self.empty[at].append(end)
            at = end
        return at

    def _next(self, state: int) -> dict[str, list[int]]:
        """Taking states that can come next, by key; -1 under "" if the items can end here."""
        found = self.known.get(state)
        if found is None:
            found, todo, seen = {}, [state], {state}
            while todo:
                x = todo.pop()
                if x in self.takes:
                    found.setdefault(self.takes[x][0], []).append(x)
                if x == self.end:
                    found[""] = [-1]
                for y in reversed(self.empty[x]):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            self.known[state] = found
        return found

    def mark(self, node: Node) -> None:
        """Set content and fixed at what stands below node at such places."""
        children, now, trail = _placed(node), {self.start: None}, []
        for c in children:
            step: dict[int, int] = {}
            for state in now:
                for x in self._next(state).get(c.key, ()):
                    step.setdefault(x, state)
            trail.append(step)
            if step:
                now = {}
                for x in step:
                    now.setdefault(self.takes[x][3], x)
        done = next((x for x in now if "" in self._next(x)), next(iter(now)))
        for c, step in zip(reversed(children), reversed(trail)):
            if not step:
                continue
            x = next(x for x in step if self.takes[x][3] == done)
            _, text, below, _, kind = self.takes[x]
            c.content = kind
            if text and text == _text_key(c.text):
                c.fixed = True
            elif below:
                below.mark(c)
            done = step[x]


# -- extraction ---------------------------------------------------------------------
def _regions(node: Node, name: str, marked: bool = False) -> list[Node]:
    """Outermost elements of the content part or of a name; marked: also below elements that class or id tokens mark."""
    found = []
    for c in node.children:
        if c.children is not None and not c.chrome and (marked or not c.marked):
            found += [c] if name in (c.content, c.name) else _regions(c, name, marked)
    return found


def _text_of(regions: list[Node], whole: bool = False) -> str:
    blocks: list[list[str]] = [[]]

    def walk(node: Node) -> None:
        for c in node.children:
            if c.children is None:
                if not c.fixed:
                    blocks[-1].append(c.text)
            elif c.chrome or c.marked or whole and c.name == "header":
                blocks[-1].append(" ")
            elif c.name in BLOCK:
                blocks.append([])
                walk(c)
                blocks.append([])
            elif c.name in ("br", "td", "th", "img", "wbr", "option"):
                blocks[-1].append("" if c.name == "wbr" else " ")
                walk(c)
            else:
                walk(c)

    for r in regions:
        blocks.append([])
        walk(r)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(html: str | None, wrapper: Places | None = None) -> str:
    """Main text of a page: what stands in the content part of its host's wrapper (from the root on); without wrapper, in the page's own."""
    root = parse(html or "")
    if wrapper is not None:
        wrapper.mark(Node("", "", False, [root]))
    articles = _regions(root, "article")
    if articles:
        return _text_of(articles)
    main = _regions(root, "main")
    found = _text_of(main or [root], not main)
    inside = _regions(root, "article", True) or (not main and _regions(root, "main", True))
    return max(found, _text_of(inside), key=len) if inside else found


# -- Spark ---------------------------------------------------------------------------
def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def hot_hosts(pages: DataFrame, url: str) -> DataFrame:
    """host and salts of the hosts with very many pages: HOT_HOSTS rows at most, whatever the pages."""
    counts = written(pages.groupBy(_host(F.col(url)).alias("__host")).agg(F.count(F.lit(1)).alias("n")), "hosts")
    per = max(SALT_PAGES, -(-(counts.agg(F.sum("n")).first()[0] or 0) // HOT_HOSTS))
    return counts.where(F.col("n") > per).select("__host", F.ceil(F.col("n") / per).cast("int").alias("__salts"))


def _packed(items: list) -> bytes:
    return zlib.compress(json.dumps(items, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def _unpacked(data: bytes) -> list:
    return json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", hot: DataFrame | None = None) -> DataFrame:
    """host, items (the wrapper, packed) and pages (long: different pages it was aligned with)."""
    names = ["host", "salt", "key", "items", "pages"]
    types = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64())
    schema = "host string, salt int, key string, items binary, pages long"
    hot = hot_hosts(pages, url) if hot is None else hot

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a page; copies that are near each other go here already."""
        held: set[tuple[str, str]] = set()
        for batch in batches:
            rows = []
            for host, salts, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen: list[str] = []
                items = [expression(parse(text or ""), seen)]
                key = hashlib.md5("\0".join(seen).encode("utf-8", "surrogatepass")).hexdigest()
                if (host, key) not in held:
                    held.add((host, key))
                    rows.append((host, int(key[:8], 16) % salts, key, _packed(items), 1))
            if len(held) > KEYS_HELD:
                held.clear()
            yield table_of(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one host and salt follow each other, equal keys too."""
        at, last, items, n = None, None, [], 0
        for batch in batches:
            rows = []
            for host, salt, key, data, pages_ in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (host, salt):
                    if at is not None:
                        rows.append((*at, "", _packed(items), n))
                    at, last, items, n = (host, salt), key, _unpacked(data), pages_
                elif key != last:
                    last, items, n = key, merge(items, _unpacked(data)), n + pages_
            yield table_of(rows)
        if at is not None:
            yield table_of([(*at, "", _packed(items), n)])

    salted = pages.select(_host(F.col(url)).alias("__host"), F.col(html).alias("__html")).join(F.broadcast(hot), "__host", "left")
    each = salted.select("__host", F.coalesce("__salts", F.lit(1)).alias("salts"), "__html").mapInArrow(local, schema)
    once = each.repartition("host", "salt").sortWithinPartitions("host", "salt", "key").mapInArrow(meet, schema)
    by_host = once.select("host", F.lit(0).alias("salt"), F.lpad(F.col("salt").cast("string"), 6, "0").alias("key"), "items", "pages")
    return by_host.repartition("host").sortWithinPartitions("host", "key").mapInArrow(meet, schema).select("host", "items", "pages")


@lru_cache(maxsize=64)
def places_of(items: bytes | None, pages: int | None) -> Places | None:
    """A host's wrapper to align its pages with; None if it tells nothing."""
    if not items:
        return None
    places = Places(_unpacked(items), max(TEMPLATE_PAGES, TEMPLATE_SHARE * (pages or 0)))
    return places if places.matters else None


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without html, plus text (string) and n_chars (long)."""
    hot = written(hot_hosts(pages, url), "hot-hosts")
    w = written(infer_wrappers(pages, url, html, hot), "wrappers").withColumnsRenamed({"host": "__host", "items": "__items", "pages": "__pages"})
    keep = carried(pages, ("text", "n_chars"), html)
    placed = pages.withColumn("__h", _host(F.col(url)))
    size = w.agg(F.sum(F.length("__items") + F.length("__host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = placed.join(F.broadcast(w), F.col("__h") == F.col("__host"), "left")
    else:  # a hot host's pages meet as many copies of its wrapper as it has salts
        copies = w.join(F.broadcast(hot), "__host", "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
        spread = placed.join(F.broadcast(hot.withColumnRenamed("__host", "__hh")), F.col("__h") == F.col("__hh"), "left")
        spread = spread.withColumn("__p", F.pmod(F.xxhash64(*hashable(pages)), F.coalesce("__salts", F.lit(1))))
        joined = spread.join(copies, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__s")), "left")
    joined = joined.select(*[pages[c] for c in keep], pages[html].alias("__html"), "__items", "__pages")
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(keep)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, places_of(w, n)) for h, w, n in zip(*(part.column(k + i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLE: dict[str, str] = {}
