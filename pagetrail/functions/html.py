"""The one opaque stage: HTML text to links and content blocks, in Arrow batches.

The parser only turns markup into flat rows (links, and the blocks of the body
in document order). Trimming, Markdown layout, link clean-up and everything
after that stay in native Columns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these helpers with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINK_TYPE = T.StructType().add("pos", "integer").add("href", "string")
_BLOCK_TYPE = (
    T.StructType().add("tag", "string").add("text", "string").add("href", "string")
    .add("cells", T.ArrayType(T.ArrayType(T.StringType())))
)
LINKS_TYPE = T.StructType().add("base_href", "string").add("links", T.ArrayType(_LINK_TYPE))
PAGE_TYPE = (
    T.StructType().add("title", "string").add("meta_description", "string").add("base_href", "string")
    .add("links", T.ArrayType(_LINK_TYPE)).add("blocks", T.ArrayType(_BLOCK_TYPE)).add("error", "string")
)

_LINK = pa.struct([("pos", pa.int32()), ("href", pa.string())])
_BLOCK = pa.struct(
    [("tag", pa.string()), ("text", pa.string()), ("href", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]
)
_PAGE = pa.struct(
    [
        ("title", pa.string()),
        ("meta_description", pa.string()),
        ("base_href", pa.string()),
        ("links", pa.list_(_LINK)),
        ("blocks", pa.list_(_BLOCK)),
        ("error", pa.string()),
    ]
)
_LINKS = pa.struct([("base_href", pa.string()), ("links", pa.list_(_LINK))])

#: Pages of a batch that are parsed at once.
PART_BYTES, PART_ROWS = 256 << 10, 500

# What counts as boilerplate.
DROP_TAGS = frozenset(
    "script style noscript iframe object embed nav header footer aside button".split()
)
DROP_CLASSES = frozenset(
    "nav navbar sidebar menu ad ads advertisement google-ad banner popup modal social share facebook "
    "twitter instagram linkedin comments comment button btn scroll skip toggle elementor-action".split()
)
DROP_IDS = frozenset(["comments", "comment"])
DROP_CLASS_PARTS = ("cookie", "gdpr")

# Element groups of the HTML standard.
RAW_TEXT = frozenset("script style noscript iframe noembed noframes xmp textarea title".split())
ESCAPABLE = frozenset(["textarea", "title"])
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset(
    "address article aside blockquote button center details dialog dir div dl dd dt fieldset figcaption figure "
    "footer form header hgroup li listing main menu nav ol p pre search section summary ul table hr xmp plaintext".split()
)
CLOSES_P = (BLOCK | HEADINGS) - {"button"}
SPECIAL = BLOCK | HEADINGS | VOID | RAW_TEXT | frozenset(
    "applet body caption colgroup frameset head html marquee object select tbody td template tfoot th thead tr".split()
)
SCOPE_END = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset("caption colgroup tbody tfoot thead tr td th".split())
TABLE_FRAME = frozenset("table tbody tfoot thead tr".split())
MARKER_TAGS = frozenset("td th caption object marquee applet template".split())

_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)>"
)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?")
_CHAR_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TEXT}


def _attr_text(value: str) -> str:
    """Character references as the standard reads them inside attributes."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        ref = m.group()
        if ref[1] == "#":
            return unescape(ref)
        followed_by_equals = not ref.endswith(";") and value[m.end() : m.end() + 1] == "="
        return html5[ref[1:]] if ref[1:] in html5 and not followed_by_equals else ref

    return _CHAR_REF.sub(one, value)


def _attrs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text:
        for name, value in _ATTR.findall(text):
            name = name.lower()
            if name not in out:
                if value[:1] in "\"'":
                    value = value[1:-1]
                out[name] = _attr_text(value)
    return out


def _tokens(html: str, with_text: bool = True):
    """(kind, name, text): kind is "text", "start", "end" or "comment". Linear in the text.

    Without text only the tags are told.
    """
    pos, n = 0, len(html)
    find, match = html.find, _TAG.match
    while pos < n:
        lt = find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos and with_text:
            yield "text", "", unescape(html[pos:lt])
        if lt == n:
            return
        m = match(html, lt)
        if m is not None:
            pos = m.end()
            slash, name, rest = m.groups()
            name = name.lower()
            if slash:
                yield "end", name, ""
                continue
            yield "start", name, rest
            if name in RAW_TEXT:
                end = _RAW_END[name].search(html, pos)
                stop = end.start() if end else n
                raw = html[pos:stop]
                if raw and with_text:
                    yield "text", name, unescape(raw) if name in ESCAPABLE else raw
                pos = stop
            elif name == "plaintext":
                if with_text:
                    yield "text", name, html[pos:]
                return
        elif _TAG_START.match(html, lt):  # the text ends inside a tag
            return
        elif html.startswith("<!--", lt):
            yield "comment", "", ""
            if html.startswith((">", "->"), lt + 4):
                pos = html.index(">", lt) + 1
                continue
            end = find("-->", lt + 4)
            pos = end + 3 if end >= 0 else n
        elif html.startswith(("<!", "<?", "</"), lt):
            yield "comment", "", ""
            end = find(">", lt)
            pos = end + 1 if end >= 0 else n
        else:
            if with_text:
                yield "text", "", "<"
            pos = lt + 1


class _Links:
    """Base address and links, in document order."""

    def __init__(self):
        self.base, self.links = None, []

    def see(self, tag: str, text: str) -> None:
        href = _attrs(text).get("href")
        if href is not None:
            if tag == "a":
                self.links.append({"pos": len(self.links), "href": href})
            elif self.base is None:
                self.base = href

    def result(self) -> dict:
        return {"base_href": self.base, "links": self.links}


class _Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "drop", "open")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.parent, self.open = tag, attrs, [], None, False
        self.drop = tag in DROP_TAGS or (bool(attrs) and self._boilerplate())

    def _boilerplate(self) -> bool:
        a = self.attrs
        cls = a.get("class", "")
        return (
            a.get("id") in DROP_IDS
            or bool(cls) and (not DROP_CLASSES.isdisjoint(cls.split()) or any(p in cls for p in DROP_CLASS_PARTS))
            or self.tag == "img" and ("data-src" in a or a.get("src", "").startswith("data:"))
        )

    def kept(self) -> bool:
        """In the tree, and neither this nor anything around it is boilerplate."""
        n = self
        while not n.drop:
            if n.parent is None:
                return n.tag in ("head", "body")
            n = n.parent
        return False

    def text(self) -> str:
        if len(self.kids) == 1 and isinstance(self.kids[0], str):
            return self.kids[0]
        return "".join(n for n in self.walk() if isinstance(n, str))

    def walk(self):
        """Kept nodes and texts below this one, in document order."""
        todo = self.kids[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif not n.drop:
                yield n
                todo.extend(reversed(n.kids))

    def find(self, *tags: str):
        return [n for n in self.walk() if not isinstance(n, str) and n.tag in tags]


class _Tree:
    """Small HTML tree builder: implied end tags, open formatting, tables."""

    def __init__(self, html: str):
        self.head, self.body = _Node("head", {}), _Node("body", {})
        self.html_drop = False
        self.stack = [self.body]
        self.active: list = []  # open formatting elements; None marks a cell or object
        self.in_body = False
        self.raw: _Node | None = None
        self.links = _Links()
        self.meta: list[_Node] = []  # title and meta elements wherever they stand
        for kind, name, text in _tokens(html):
            if kind == "text":
                self._text(name, text)
            elif kind == "start":
                if name == "a" or name == "base":
                    self.links.see(name, text)
                self._start(name, text)
            elif kind == "end":
                self._end(name)
            elif self.in_body:  # keeps the texts around it apart
                self.stack[-1].kids.append(_Node("#comment", {}))

    # -- insertion -------------------------------------------------------
    def _append(self, node) -> None:
        top = self.stack[-1]
        if top.tag in TABLE_FRAME and not (isinstance(node, _Node) and (node.tag in TABLE_PARTS or node.tag in RAW_TEXT)):
            if not (isinstance(node, str) and node.isspace()):
                table = next(n for n in reversed(self.stack) if n.tag == "table")
                top = table.parent
                at = top.kids.index(table)
                if isinstance(node, _Node):
                    node.parent = top
                top.kids.insert(at, node)
                return
        if isinstance(node, str):
            if top.kids and isinstance(top.kids[-1], str):
                top.kids[-1] += node
                return
        else:
            node.parent = top
        top.kids.append(node)

    def _push(self, node: _Node) -> None:
        self._append(node)
        self.stack.append(node)
        node.open = True
        if node.tag in MARKER_TAGS:
            self.active.append(None)

    def _pop(self) -> _Node:
        node = self.stack.pop()
        node.open = False
        if node.tag in MARKER_TAGS:
            while self.active and self.active.pop() is not None:
                pass
        return node

    def _pop_to(self, node: _Node) -> None:
        while self._pop() is not node:
            pass

    def _in_scope(self, tags, extra=()) -> _Node | None:
        for n in reversed(self.stack):
            if n.tag in tags:
                return n
            if n.tag in SCOPE_END or n.tag in extra:
                return None
        return None

    def _close(self, tags, extra=()) -> bool:
        node = self._in_scope(tags, extra)
        if node is not None:
            self._pop_to(node)
        return node is not None

    def _reopen_formatting(self) -> None:
        """Formatting that an implied end tag cut off goes on in the new place."""
        i = len(self.active)
        while i > 0 and self.active[i - 1] is not None and not self.active[i - 1].open:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = clone = _Node(old.tag, old.attrs)
            self._push(clone)

    def _remember(self, node: _Node) -> None:
        """Keep an open formatting element; of equal ones only the last three count."""
        equal = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                equal.append(n)
        if len(equal) >= 3:
            self.active.remove(equal[-1])
        self.active.append(node)

    # -- tokens ----------------------------------------------------------
    def _text(self, raw_tag: str, text: str) -> None:
        if self.raw is not None and raw_tag:
            self.raw.kids.append(text)
            return
        if not self.in_body:
            if text.isspace():
                return
            self.in_body = True
            text = text.lstrip("\t\n\f\r ")
        if self.active:
            self._reopen_formatting()
        self._append(text)

    def _start(self, tag: str, text: str) -> None:
        attrs = _attrs(text)
        if tag in ("html", "body", "head"):
            if tag == "body":
                self.in_body = True
                self.body.drop = self.body.drop or _Node("body", attrs).drop
            elif tag == "html":
                self.html_drop = self.html_drop or _Node("html", attrs).drop
            return
        node = _Node(tag, attrs)
        if tag == "title" or tag == "meta":
            self.meta.append(node)
        if not self.in_body:
            if tag in IN_HEAD:
                node.parent = self.head
                self.head.kids.append(node)
                self.raw = node
                return
            self.in_body = True
        if tag in TABLE_PARTS and self._table_part(tag):
            return
        if tag in CLOSES_P:
            self._close(("p",), ("button",))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        elif tag == "li":
            self._close_item(("li",))
        elif tag in ("dd", "dt"):
            self._close_item(("dd", "dt"))
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._pop()
        elif tag == "button":
            self._close(("button",))
        elif tag == "a":
            after_marker = self.active[::-1]
            for n in after_marker:
                if n is None:
                    break
                if n.tag == "a":
                    self._end_formatting("a")
                    break
        if tag not in CLOSES_P and tag not in RAW_TEXT and tag not in TABLE_PARTS:
            self._reopen_formatting()
        if tag in RAW_TEXT:
            self._append(node)
            self.raw = node
        elif tag in VOID or text.endswith("/") and self._in_scope(("svg", "math")):
            self._append(node)
        else:
            self._push(node)
            if tag in FORMATTING:
                self._remember(node)

    def _table_part(self, tag: str) -> bool:
        """Make room for a table part; True when the tag is to be ignored."""
        table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
        if table is None:
            return True
        stop = {"td": ("tr",), "th": ("tr",), "tr": ("tbody", "thead", "tfoot")}.get(tag, ())
        while self.stack[-1] is not table and self.stack[-1].tag not in stop:
            self._pop()
        if tag in ("td", "th") and self.stack[-1] is table:
            self._push(_Node("tr", {}))
        return False

    def _close_item(self, tags) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self._pop_to(n)
                break
            if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                break
        self._close(("p",), ("button",))

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._start("br", "")
        elif tag in RAW_TEXT:
            self.raw = None
        elif tag in ("body", "html", "head") or tag in VOID:
            return
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag in HEADINGS:
            self._close(HEADINGS)
        elif tag == "li":
            self._close(("li",), ("ol", "ul"))
        elif tag == "p":
            self._close(("p",), ("button",))
        elif tag in TABLE_FRAME or tag in TABLE_PARTS:
            node = next((n for n in reversed(self.stack) if n.tag in (tag, "table")), None)
            if node is not None and node.tag == tag:
                self._pop_to(node)
        elif tag in BLOCK or tag in MARKER_TAGS:
            self._close((tag,))
        else:
            for n in reversed(self.stack):
                if n.tag == tag:
                    self._pop_to(n)
                    break
                if n.tag in SPECIAL:
                    break

    def _end_formatting(self, tag: str) -> None:
        """Close the last open formatting element of this name; what an open block
        inside it already holds keeps the formatting, what follows does not."""
        node = None
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == tag:
                node = n
                break
        if node is None:
            return
        self.active.remove(node)
        if not node.open:
            return
        at = self.stack.index(node)
        block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
        if block is None:
            self._pop_to(node)
            return
        holder = block.parent
        if holder is not None and block in holder.kids:
            holder.kids.remove(block)
        inner = _Node(node.tag, node.attrs)
        inner.kids, inner.parent = block.kids, block
        for k in inner.kids:
            if isinstance(k, _Node):
                k.parent = inner
        block.kids = [inner] if inner.kids else []
        block.parent = node.parent
        node.parent.kids.insert(node.parent.kids.index(node) + 1, block)
        end = self.stack.index(block)
        for n in self.stack[at:end]:
            n.open = False
        del self.stack[at:end]


def _block(node: _Node) -> dict | None:
    tag = node.tag
    if tag in ("ul", "ol"):
        return {"tag": tag, "cells": [[li.text()] for li in node.find("li")]}
    if tag == "table":
        return {"tag": tag, "cells": [[c.text() for c in tr.find("td", "th")] for tr in node.find("tr")]}
    if tag == "img":
        return {"tag": tag, "text": node.attrs.get("alt"), "href": node.attrs.get("src")}
    if tag == "a":
        return {"tag": tag, "text": node.text(), "href": node.attrs.get("href")}
    if tag == "br":
        return {"tag": tag}
    if tag in HEADINGS or tag in ("p", "strong", "b", "em", "i", "code", "pre", "blockquote"):
        return {"tag": tag, "text": node.text()}
    return None


def _blocks(body: _Node) -> list[dict]:
    out: list[dict] = []
    todo = body.kids[::-1]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append({"tag": "#text", "text": n})
        elif not n.drop:
            block = _block(n)
            if block is not None:
                out.append(block)
            else:
                todo.extend(reversed(n.kids))
    return out


def extract_links(html: str | None) -> dict | None:
    """Base address and every ``a[href]`` of the whole document, in document order."""
    if html is None:
        return None
    links = _Links()
    for kind, name, text in _tokens(html, with_text=False):
        if kind == "start" and (name == "a" or name == "base"):
            links.see(name, text)
    return links.result()


def extract_page(html: str | None) -> dict | None:
    """Everything of one page; a page that cannot be read gives only ``error``."""
    if html is None:
        return None
    try:
        tree = _Tree(html)
        out = tree.links.result()
        tree.body.drop = tree.body.drop or tree.html_drop
        tree.head.drop = tree.html_drop
        meta = [n for n in tree.meta if n.kept()]
        described = [n.attrs.get("content") for n in meta if n.tag == "meta" and n.attrs.get("name") == "description"]
        out["title"] = "".join(n.text() for n in meta if n.tag == "title")
        out["meta_description"] = described[0] if described else None
        out["blocks"] = [] if tree.body.drop else _blocks(tree.body)
        return out
    except Exception as exc:  # one bad page must not fail the task
        return {"error": f"{type(exc).__name__}: {exc}"}


def _in_parts(html: pa.Array, extract: Callable[[str | None], dict | None], kind: pa.DataType) -> pa.Array:
    """``extract`` of every page. A page of Python objects is many times its text, so only those of ``PART_BYTES`` of text (or
    of one page) exist at a time; whole batches are held in Arrow alone."""
    parts, i = [], 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while i < len(html):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART_BYTES, "right")))
        j = min(j, i + PART_ROWS)
        parts.append(pa.array([extract(h) for h in html.slice(i, j - i).to_pylist()], type=kind))
        i = j
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


@F.arrow_udf(PAGE_TYPE)
def _parse_page(html: pa.Array) -> pa.Array:
    return _in_parts(html, extract_page, _PAGE)


@F.arrow_udf(LINKS_TYPE)
def _parse_links(html: pa.Array) -> pa.Array:
    return _in_parts(html, extract_links, _LINKS)


def parse_page(html: Column) -> Column:
    """Title, description, base address, links and content blocks of a page."""
    return _parse_page(html)


def parse_links(html: Column) -> Column:
    """Only base address and links: no tree is built."""
    return _parse_links(html)
