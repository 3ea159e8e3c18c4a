"""What can still be read of a sitemap that is not well-formed, inside Arrow batches.

Spark's XML reader gives such a document up as a whole, so only these come here: the entries that end before the bad spot
are kept, and the spot is named.
"""

from __future__ import annotations

import sys
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOTS = ("urlset", "sitemapindex")
#: is_index and locs of the entries kept (null where an entry has no loc); reason, and line (from 1) and byte (from 0) of
#: the spot, all null where the document reads well after all.
SCANNED = "struct<is_index boolean, locs array<string>, reason string, line int, place bigint>"
_ARROW = pa.struct(
    [("is_index", pa.bool_()), ("locs", pa.list_(pa.string())), ("reason", pa.string()), ("line", pa.int32()), ("place", pa.int64())]
)


def scan(text: str) -> tuple[bool, list[str | None], str | None, int | None, int | None]:
    """White space and a byte order mark in front do no harm."""
    body = text.lstrip("﻿ \t\r\n")
    skipped = text[: len(text) - len(body)]
    open_: list[str] = []
    entries: dict[str, list[str | None]] = {"url": [], "sitemap": []}
    root, loc, parts = None, None, None

    def start(name: str, _: dict) -> None:
        nonlocal root, loc, parts
        open_.append(name.rpartition(":")[2])
        if len(open_) == 1:
            root = open_[0]
        elif len(open_) == 2:
            loc = None
        elif len(open_) == 3 and open_[1] in entries and open_[2] == "loc":
            parts = []

    def characters(piece: str) -> None:
        if parts is not None:
            parts.append(piece)

    def end(_: str) -> None:
        nonlocal loc, parts
        if len(open_) == 3 and parts is not None:
            loc, parts = "".join(parts).strip(), None
        elif len(open_) == 2 and open_[1] in entries:
            entries[open_[1]].append(loc)
        open_.pop()

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    reason = line = place = None
    try:
        parser.Parse(body.encode(), True)
    except expat.ExpatError as error:
        # after the root element is closed nothing can be lost any more
        if open_ or root is None:
            reason = expat.ErrorString(error.code)
            line, place = error.lineno + skipped.count("\n"), parser.ErrorByteIndex + len(skipped.encode())
    if root is not None and root not in ROOTS:
        reason, line, place = f"root element is {root}", None, None
        entries = {"url": [], "sitemap": []}
    is_index = bool(entries["sitemap"])
    return is_index, entries["sitemap"] if is_index else entries["url"], reason, line, place


def scan_array(texts: pa.Array) -> pa.Array:
    """Nulls stay null."""
    rows = [None if t is None else dict(zip(_ARROW.names, scan(t))) for t in texts.to_pylist()]
    return pa.array(rows, _ARROW)

