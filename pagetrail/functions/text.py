"""Text scalars (Column -> Column), all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of the Unicode White_Space property.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# ASCII white space as a regex class; Java's own \s also holds \x0B.
_WS = r"[\t\n\f\r ]"
_WS_NO_NL = r"[\t\f\r ]"
# A run of white space that is not just one space already.
_WS_RUN = rf"[\t\n\f\r]{_WS}*+| {_WS}++"

# Boilerplate phrases that clean_text deletes, in this order, without case.
BOILERPLATE_PHRASES = [
    "cookie policy",
    "privacy policy",
    "terms of service",
    "accept cookies",
    "this website uses cookies",
    "subscribe to our newsletter",
    "follow us on",
    "share this article",
    "print this page",
    "scroll to top",
    "skip to content",
    "book a demo",
    "know more",
    "data:image/gif;base64,[A-Za-z0-9+/=]+",
    "elementor-action",
]
ANCHOR_LINK = r"\[.*?\]\(#[^)]*\)"


def trim_u(s: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def strip_control(s: Column) -> Column:
    """Drop every control character (category Cc)."""
    return F.regexp_replace(s, r"\p{Cc}+", "")


def split_lines(s: Column) -> Column:
    return F.split(s, "\n")


def truncate(s: Column, n: int, marker: str = "...") -> Column:
    """``s``, or plus ``marker`` its longest start of whole characters within ``n`` bytes, when it is longer than that."""
    raw = s.cast("binary")

    def continues(at: int) -> Column:
        """The byte at ``at`` (from 1) belongs to the character before it; the first one never does."""
        return F.hex(F.substring(raw, at, 1)).rlike("^[89AB]")

    end = F.when(~continues(n + 1), n).when(~continues(n), n - 1).when(~continues(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(s) > n, F.concat(raw.substr(F.lit(1), end).cast("string"), F.lit(marker))).otherwise(s)


def markdown_size(md: Column) -> Column:
    """Size in bytes; a missing text counts as empty."""
    return F.coalesce(F.octet_length(md), F.lit(0))


def enough_markdown(md: Column, error: Column | None = None) -> Column:
    """No error, and more than 100 bytes once trimmed."""
    long_enough = F.coalesce(F.octet_length(trim_u(md)), F.lit(0)) > 100
    return long_enough if error is None else long_enough & (F.coalesce(error, F.lit("")) == "")


def enough_html(html: Column) -> Column:
    """At least 100 bytes once trimmed."""
    return F.coalesce(F.octet_length(trim_u(html)), F.lit(0)) >= 100


def clean_markdown(md: Column) -> Column:
    """Normalise blank lines around headings and runs of spaces.

    The patterns use possessive loops and start only at a line start, so one
    pass costs time linear in the text also on long lines full of ``#``.
    """
    md = F.regexp_replace(md, r"\n{3,}", "\n\n")
    md = F.regexp_replace(md, rf"\n{_WS_NO_NL}*+\n{_WS}*+(#{{1,6}})", "\n\n$1")
    md = F.regexp_replace(
        md, rf"(?dm)(?:^|\G)([^\n#]*+#[^\n]*+)\n{_WS_NO_NL}*+\n{_WS}*+", "$1\n\n"
    )
    md = F.regexp_replace(md, r" {2,}", " ")
    return trim_u(md)


def _folded(s: Column) -> Column:
    """Lower case, with the long s as a plain one, so that it holds whatever a caseless match finds."""
    return F.translate(F.lower(s), "\u017f", "s")


def clean_text(text: Column) -> Column:
    """One-line text without boilerplate phrases and in-page anchor links.

    The phrases go one after the other, since deleting one may join the next. Each pass
    first looks for the plain phrase, so a text pays for the regex only where it occurs.
    """
    text = trim_u(F.regexp_replace(text, _WS_RUN, " "))
    passes = F.array(
        *[F.struct(F.lit(p.split("[")[0]).alias("needle"), F.lit(f"(?iu){p}").alias("pattern")) for p in BOILERPLATE_PHRASES]
    )

    def state(s: Column) -> Column:
        return F.struct(s.alias("text"), _folded(s).alias("folded"))

    cleaned = F.aggregate(
        passes,
        state(text),
        lambda acc, p: F.when(
            F.contains(acc["folded"], p["needle"]), state(F.regexp_replace(acc["text"], p["pattern"], F.lit("")))
        ).otherwise(acc),
        lambda acc: F.when(
            F.contains(acc["text"], F.lit("](#")), F.regexp_replace(acc["text"], f"(?s){ANCHOR_LINK}", "")
        ).otherwise(acc["text"]),
    )
    return trim_u(cleaned)


def parse_added(progress: Column) -> Column:
    """The count in "added N new URLs", else null."""
    return F.regexp_extract(progress, r"added ([0-9]+) new URLs", 1).try_cast("int")


def rate_text(x: Column) -> Column:
    """Two decimals, for display only."""
    return F.format_string("%.2f", x.cast("double"))
