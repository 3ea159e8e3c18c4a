"""Markdown layout of the parsed blocks, in native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import HEADINGS, parse_page
from .text import clean_markdown, trim_u


def _lit(s: str) -> Column:
    return F.lit(s)


def render_block(b: Column) -> Column:
    """Markdown of one block."""
    raw = F.coalesce(b["text"], _lit(""))
    text = trim_u(raw)
    blank = _lit("\n\n")
    quoted = F.transform(
        F.filter(F.transform(F.split(text, "\n"), trim_u), lambda s: s != ""),
        lambda s: F.concat(_lit("> "), s, _lit("\n")),
    )
    bullets = F.transform(b["cells"], lambda c: F.concat(_lit("- "), trim_u(c[0]), _lit("\n")))
    numbered = F.transform(
        b["cells"],
        lambda c, i: F.concat((i + 1).cast("string"), _lit(". "), trim_u(c[0]), _lit("\n")),
    )
    rows = F.transform(
        b["cells"],
        lambda row, i: F.concat(
            _lit("|"),
            F.array_join(F.transform(row, lambda c: F.concat(_lit(" "), trim_u(c), _lit(" |"))), ""),
            _lit("\n"),
            F.when(i == 0, F.concat(F.repeat(_lit("|---"), F.size(row)), _lit("|\n"))).otherwise(""),
        ),
    )
    tag = b["tag"]
    has_href = F.coalesce(b["href"], _lit("")) != ""
    level = F.substring(tag, 2, 1).try_cast("int")
    return (
        F.when(tag == "#text", text)
        .when(tag == "p", F.when(text != "", F.concat(blank, text, blank)).otherwise(""))
        .when(tag == "br", "\n")
        .when(tag.isin("strong", "b"), F.concat(_lit("**"), text, _lit("**")))
        .when(tag.isin("em", "i"), F.concat(_lit("*"), text, _lit("*")))
        .when(tag == "code", F.concat(_lit("`"), text, _lit("`")))
        .when(tag.isin(*sorted(HEADINGS)), F.concat(blank, F.repeat(_lit("#"), level), _lit(" "), text, blank))
        .when(tag == "pre", F.concat(_lit("\n\n```\n"), raw, _lit("\n```\n\n")))
        .when(tag == "blockquote", F.concat(blank, F.array_join(quoted, ""), _lit("\n")))
        .when(tag == "ul", F.concat(blank, F.array_join(bullets, ""), _lit("\n")))
        .when(tag == "ol", F.concat(blank, F.array_join(numbered, ""), _lit("\n")))
        .when(tag == "table", F.concat(blank, F.array_join(rows, ""), _lit("\n")))
        .when(
            tag == "a",
            F.when(has_href & (text != ""), F.concat(_lit("["), text, _lit("]("), b["href"], _lit(")"))).otherwise(text),
        )
        .when(
            tag == "img",
            F.when(
                b["href"].isNotNull() & ~b["href"].startswith("data:") & (raw != ""),
                F.concat(_lit("!["), raw, _lit("]("), b["href"], _lit(")")),
            ).otherwise(""),
        )
        .otherwise("")
    )


def page_title(page: Column) -> Column:
    return trim_u(page["title"])


def meta_description(page: Column) -> Column:
    return trim_u(page["meta_description"])


def page_markdown(page: Column) -> Column:
    """Clean Markdown of a parsed page."""
    title, desc = page_title(page), meta_description(page)
    return clean_markdown(
        F.concat(
            F.when(title != "", F.concat(_lit("# "), title, _lit("\n\n"))).otherwise(""),
            F.when(desc != "", F.concat(_lit("*"), desc, _lit("*\n\n"))).otherwise(""),
            F.array_join(F.transform(page["blocks"], render_block), ""),
        )
    )


def html_to_markdown(html: Column) -> Column:
    return page_markdown(parse_page(html))
