"""HTML parsing and Markdown layout."""

import time

import pyarrow as pa
import pytest

from pagetrail.functions import html
from pagetrail.functions.html import extract_links, extract_page
from pagetrail.functions.markdown import html_to_markdown

MARKDOWN = [
    ("<h1> A </h1><h3>B</h3><h6>C</h6>", "# A\n\n### B\n\n###### C"),
    ("<p> one <b>two</b> </p><p> </p><p>three", "one two\n\nthree"),
    ("a<br>b", "a\nb"),
    ("x <strong> s </strong> y <em>e</em><i>i</i> <code> c </code>", "x**s**y*e**i*`c`"),
    ("<pre> a  b\n c</pre>", "```\n a b\n c\n```"),
    ("<blockquote> a\n\n  b </blockquote>", "> a\n> b"),
    ("<ul><li> a <li>b<ul><li>c</ul></ul>", "- a\n- bc\n- c"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("<a href='/x?a=1&amp;b'> t </a><a href=''>u</a><a>v</a><a href=/w> </a>", "[t](/x?a=1&b)uv"),
    ("<img src=/a.png alt=' A '><img src='data:x' alt=b><img src=c><img data-src=d src=e alt=f>", "![ A ](/a.png)"),
    ("<table><tr><td> a <td>b</tr><tr><th>c</table>", "| a | b |\n|---|---|\n| c |"),
    ("<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table>", "| h |\n|---|\n| x |"),
    ("<div><section>a <span> b</span></section></div>", "ab"),
    ("<title>T &amp; U</title><meta name=description content=' d '><body>x", "# T & U\n\n*d*\n\nx"),
    ("<title>Only</title>", "# Only"),
    ("", ""),
    ("<nav>n</nav><div class='big ads'>a</div><p class=xcookie-bar>c</p><p id=comments>d</p><button>e</button><p class=Nav>kept</p>", "kept"),
    ("<body class=gdpr-on><p>x</body>", ""),
    ("<script>var a='</p><p>no';</script><style>p{}</style><noscript><p>n</p></noscript><p>yes", "yes"),
    ("<!-- <p>no</p> --><p>a<!-- x -->b</p>c<!-- y --> d", "ab\n\ncd"),
    ("<p><b>bold<p>still</p> tail", "bold\n\nstill\n\n**tail**"),
    ("<b>1<p>2</b>3</p>", "**1**\n\n23"),
    ("<p>a <i>b</p> c</i> d", "a b\n\n*c*d"),
    ("a < b &lt; c", "a < b < c"),
    ("<table>stray<tr><td>x</table>", "stray\n\n| x |\n|---|"),
    ("<p>one<div>two</div>three</p>", "one\n\ntwothree"),
    ("<svg><path d='x'/><title>t</title></svg><p>z</p>", "# t\n\nt\n\nz"),
    ("<select><option>a<option>b</select>", "ab"),
    ("<dl><dt>a<dd>b</dl>", "ab"),
]


def test_markdown_rules(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKDOWN)], "i int, html string")
    got = {r["i"]: r["md"] for r in df.select("i", html_to_markdown(F.col("html")).alias("md")).collect()}
    for i, (source, expected) in enumerate(MARKDOWN):
        assert got[i] == expected, source


def hrefs(html):
    return [link["href"] for link in extract_links(html)["links"]]


@pytest.mark.parametrize("html, expected", [
    ("<nav><a href=/a>x</a></nav><footer><A HREF='/b'>y</A></footer><a name=c>z</a>", ["/a", "/b"]),
    ("<a href=\"/x?a=1&copy=2&amp;c&notit;&lt\">", ["/x?a=1&copy=2&c&notit;<"]),
    ("<!-- <a href=/no> --><script>'<a href=/no>'</script><textarea><a href=/no></textarea><a href=/yes>", ["/yes"]),
    ("<a title='>' href=/q>", ["/q"]),
    ("<a href=/one href=/two>", ["/one"]),
    ("<a href>", [""]),
    ("<a href=/cut", []),
    ("<a href='/cut>", []),
    ("< a href=/x>", []),
])
def test_links(html, expected):
    assert hrefs(html) == expected


def test_base_and_missing():
    assert extract_links("<base href=/b/><base href=/c/>")["base_href"] == "/b/"
    assert extract_links(None) is None and extract_page(None) is None


@pytest.mark.parametrize("hostile", [
    "<a " * 100_000, "<b>" * 20_000 + "x", "<p>" * 50_000, "<" * 200_000, "<a href='" * 50_000, "&" * 200_000, "<p><b>x" * 20_000, "<!--" * 50_000,
    "<div>" * 5_000 + "x" + "</div>" * 5_000,
])
def test_hostile_pages_end(hostile):
    start = time.time()
    assert extract_page(hostile) is not None
    assert time.time() - start < 20


def test_pages_of_a_batch_are_parsed_in_parts(monkeypatch):
    """What lives as Python objects is bounded by a part's bytes and rows, not by the batch."""
    page = "<html><body>" + "<p>some text</p>" * 300 + "<a href=/x>x</a></body></html>"
    batch = pa.array([page, None, "", "<p>short</p>"] * 500)
    lists, made = [], pa.array
    monkeypatch.setattr(html.pa, "array", lambda x, **kind: (lists.append([len(x), sum(len(page) for p in x if p and len(p["blocks"]) > 9)]), made(x, **kind))[1])
    got = html._in_parts(batch, html.extract_page, html._PAGE)
    monkeypatch.undo()
    assert got.equals(pa.array([html.extract_page(h) for h in batch.to_pylist()], type=html._PAGE))
    assert len(lists) > 4 and max(n for n, _ in lists) <= html.PART_ROWS and max(size for _, size in lists) <= html.PART_BYTES
    large = pa.array(["<p>" + "x" * html.PART_BYTES, "<p>a"] * 2)
    assert [x["blocks"][0]["text"][:1] for x in html._in_parts(large, html.extract_page, html._PAGE).to_pylist()] == ["x", "a"] * 2
    empty = pa.array([], type=pa.string())
    assert html._in_parts(empty, html.extract_links, html._LINKS).type == html._LINKS and len(html._in_parts(pa.array([None] * 1200, type=pa.string()), html.extract_links, html._LINKS)) == 1200
