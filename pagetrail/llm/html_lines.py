"""Main text of pages by line-block distribution.

Markup is stripped in one pass: every block element begins a line, borders of containers leave empty lines, and what can
never be text of an article (scripts, styles, comments, forms, menus, headers and footers of the page, side bars,
notices, adverts, reader comments, by element, role, class or id) leaves nothing. Lines' text lengths, without link
text, are summed over sliding windows of ``WINDOW`` lines. A *surge* is the first line whose window holds
``SURGE`` code points; the *dive* is where a window holds none. Text between a surge and its dive is kept, whole. Where no
window is that full, the fullest one counts as the surge, so a short page keeps its text. If the page marks an
article or main element, only lines in it are looked at, and any text surges. Runs of three or more lines of nothing
but links are menus outside of such an element.

Character references are decoded after markup is gone; white space (Unicode's) inside a block becomes one space; blocks
are joined by one line feed. ``br`` is white space. A tag that the page ends in the middle of ends the text, as for a
browser. Every row gives one row; null and blank html give an empty text; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, MENU = 3, 80, 3

# Elements by what they are to the text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
NEVER = frozenset(
    "head nav footer aside form menu dialog template svg math object canvas select button video audio map".split()
)
CONTAINERS = frozenset("html body main article section div header table ul ol dl fieldset center blockquote".split())
MARKED = frozenset("article main".split())
CLOSES_P = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 hr pre nav footer aside form".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs masthead header topbar footer sidebar aside rail widget widgets cookie cookies consent gdpr "
    "notice notices notification alert newsletter subscribe subscription signup login popup modal overlay comment comments "
    "commentlist disqus respond reply replies discussion related recommended share sharing social pagination pager toolbar "
    "skiplink copyright legal disclaimer search".split()
)
#: A class that begins so says what a page has, not what the element is.
ABOUT = frozenset("has with no without is not".split())
HOLDERS = frozenset("content wrapper container layout main page body grid".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|([!?/]))")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")


def is_chrome(name: str, rest: str) -> bool:
    """Whether an element with the attributes ``rest`` is part of the page around the article."""
    if name in NEVER:
        return True
    if name in ("html", "body") or not rest or rest.isspace():
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        low = value.lower()
        if key == "hidden" or key == "aria-hidden" and low == "true" or key == "style" and "display:none" in low.replace(" ", ""):
            return True
        if key == "role" and low in ROLES:
            return True
        if key in ("class", "id"):
            for one in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower().split():
                parts = [p for p in _PARTS.split(one) if p]
                if parts and parts[0] not in ABOUT and parts[-1] not in HOLDERS and not CHROME.isdisjoint(parts):
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """Lines of the page: text, whether it is all links, whether it lies in a marked article. Empty lines included."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    plain: list[str] = []  # of them, what is no link's
    stack: list[tuple[str, bool]] = []
    count: dict[str, int] = {}
    skip = marked = links = 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, not "".join(plain).strip(), marked > 0))
            parts.clear()
            plain.clear()

    def pop() -> str:
        nonlocal skip, marked
        name, chrome = stack.pop()
        count[name] -= 1
        skip -= chrome
        if name in MARKED:
            marked -= 1
        return name

    def gap(name: str) -> None:
        if name in CONTAINERS:
            out.append(("", False, marked > 0))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skip:
            parts.append(page[at:stop])
            if not links:
                plain.append(page[at:stop])
        if not m:
            break
        if m[1]:
            stop = page.find("-->", m.end())
            at = end if stop < 0 else stop + 3
            continue
        if m[4]:
            stop = page.find(">", m.end())
            at = end if stop < 0 else stop + 1
            continue
        rest = _REST.match(page, m.end())
        if not rest:
            break  # the page ends inside of a tag
        at, name = rest.end(), m[3].lower()
        if m[2]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                if not skip:
                    close()
                if count.get(name):
                    while True:
                        gone = pop()
                        if not skip:
                            gap(gone)
                        if gone == name:
                            break
            continue
        if name in RAW:
            tail = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = tail.start() if tail else end
            if tail:
                rest = page.find(">", at)
                at = end if rest < 0 else rest + 1
            continue
        if name == "br":
            if not skip:
                parts.append(" ")
            continue
        if name in INLINE:
            if name == "a" and not links:
                links = 1
            if name in VOID or not is_chrome(name, rest[0][:-1]):
                continue
        elif not skip:
            close()
        if stack and (stack[-1][0] == "p" and name in CLOSES_P or stack[-1][0] == name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            pop()
        if name in VOID:
            continue
        chrome = is_chrome(name, rest[0][:-1]) or name == "header" and not marked
        if not skip and not chrome:
            gap(name)
        links = 0 if name not in INLINE else links
        stack.append((name, chrome))
        count[name] = count.get(name, 0) + 1
        skip += chrome
        marked += name in MARKED and True
    if not skip:
        close()
    return out


def between(sizes: list[int], surge: list[int], marked: list[bool]) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to its dive; ``surge`` is what a window holds that begins at the line."""
    n = len(sizes)
    window = [sum(sizes[i : i + WINDOW]) for i in range(n)]
    out, i, done = [], 0, 0
    while i < n:
        if sizes[i] and window[i] >= surge[i]:
            j = i
            while j < n and window[j]:
                j += 1
            first = i
            while first > done and (
                any(sizes[max(0, first - WINDOW + 1) : first])
                or first >= WINDOW and marked[first - WINDOW] and sizes[first - WINDOW]
            ):
                first -= 1  # short lines right before the surge belong to it
            out.append((first, j))
            i = done = j
        i += 1
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    marked = [m for _, _, m in lines]
    sizes = [0 if linked else len(text) for text, linked, _ in lines]
    menu, i = [False] * len(lines), 0
    while i < len(lines):  # runs of links, whatever empty lines lie between
        j, run = i, []
        while j < len(lines) and (lines[j][1] or not lines[j][0]):
            run += [j] * bool(lines[j][0])
            j += 1
        for k in run if len(run) >= MENU else ():
            menu[k] = True
        i = max(j, i + 1)
    for k, (text, linked, _) in enumerate(lines):
        if linked and not menu[k]:
            sizes[k] = len(text)
    inside = sum(len(text) for text, _, m in lines if m)
    trusted = inside > 0 and inside >= sum(size for size, m in zip(sizes, marked) if not m)
    if trusted:
        sizes = [len(line[0]) if line[2] else size for line, size in zip(lines, sizes)]
    fullest = max((sum(sizes[i : i + WINDOW]) for i in range(len(sizes))), default=0)
    if not fullest:
        return ""
    surge = [1 if trusted and m else min(SURGE, fullest) for m in marked]
    kept = between(sizes, surge, marked)
    return "\n".join(lines[k][0] for a, b in kept for k in range(a, b) if sizes[k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
