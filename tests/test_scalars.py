"""Golden rows per scalar function."""

import pytest

from pagetrail.functions import checks, text, urls


def check(apply, function, cases, types=None):
    args = [c[0] for c in cases]
    assert apply(function, args, types) == [c[1] for c in cases]


def test_clean_url(apply):
    check(apply, urls.clean_url, [
        ("  https://a.b/c \n", "https://a.b/c"), (" x　", "x"), ("a\tb\nc\rd", "abcd"), ("a\x07\x9fb", "ab"),
        ("a b", "a b"), ("", ""), ("\u0085 \x00", ""), (None, None),
    ])


def test_trim_and_control(apply):
    check(apply, text.trim_u, [("  x y  ", "x y"), ("​x", "​x"), ("\x1cx", "\x1cx")])
    check(apply, text.strip_control, [("a\x00\x1f\x7f\x80b­", "ab­")])


def test_is_skippable(apply):
    check(apply, urls.is_skippable, [
        ("/a.PDF", True), ("/a.pdf?x=1", False), ("/authors", True), ("admin/x", False), ("/x#y", True), ("mailto:a@b", True),
        ("/docs", False), ("/hotel:1", True), ("/A.JpEg", True), ("/a.pdf\n", False), ("/images", False), ("/img/", True), ("/xpdf", False),
    ])


BASE = "http://h.com:80/a/b/c?q=1#f"


@pytest.mark.parametrize("base", [BASE])
def test_resolve_url(apply, base):
    check(apply, urls.resolve_url, [((base, h), r) for h, r in [
        ("../x", "http://h.com:80/a/x"), ("./x", "http://h.com:80/a/b/x"), ("//h2/x", "http://h2/x"), ("?q", "http://h.com:80/a/b/c?q"),
        ("", "http://h.com:80/a/b/c?q=1"), ("#a", ""), ("a b", "http://h.com:80/a/b/a b"), ("/%2F", "http://h.com:80/%2F"),
        ("HTTP://U@EX.com/..//p/./", "http://U@EX.com//p/"), ("/a/..", "http://h.com:80/"), ("/..", "http://h.com:80/"), ("/../x", "http://h.com:80/x"),
        ("x/../../y/.", "http://h.com:80/a/y/"), ("mailto:a", "mailto:a"), ("/x?", "http://h.com:80/x"), ("y?z#k", "http://h.com:80/a/b/y?z"),
        ("/a/.hidden/..x", "http://h.com:80/a/.hidden/..x"), ("https://z.org", "https://z.org"),
    ]])


def test_canonical_url(apply):
    check(apply, urls.canonical_url, [
        ("http://H.com:80/a%20b?x=%20#f", "http://H.com:80/a b?x=%20"), ("HTTPS://u:p@h.com/%C3%A9", "https://h.com/é"), ("http://h.com/%zz", None),
        ("http://h.com", "http://h.com"), ("http://h.com/?", "http://h.com/"), ("http://h.com/a+b%2Bc", "http://h.com/a+b+c"), ("http://h.com/b/a?z&a", "http://h.com/b/a?z&a"),
    ])


def test_hosts(apply):
    check(apply, urls.site_hosts, [("https://www.a.b:8/x", ["www.a.b:8", "a.b:8"]), ("http://a.b", ["a.b", "www.a.b"])])
    check(apply, urls.same_site, [
        (("https://a.b/x", "http://a.b"), True), (("https://www.a.b", "http://a.b/q"), True), (("https://a.b", "http://www.a.b"), True),
        (("https://s.a.b", "http://a.b"), False), (("https://a.b:8", "http://a.b"), False), (("https://A.b", "http://a.b"), False), (("/x", "http://a.b"), False),
    ])


def test_fallback_urls(apply):
    check(apply, urls.fallback_urls, [
        ("https://a.b/x?y#z", ["https://www.a.b/x?y#z"]), ("https://www.a.b", ["https://a.b"]),
        ("http://a.b:8/x", ["http://www.a.b:8/x", "https://a.b:8/x", "https://www.a.b:8/x"]),
        ("http://www.a.b/", ["http://a.b/", "https://www.a.b/", "https://a.b/"]),
    ])


def test_places(apply):
    check(apply, urls.sitemap_candidates, [("http://a.b/x/y", [f"http://a.b{p}" for p in urls.SITEMAP_PATHS])])
    check(apply, urls.robots_url, [("https://a.b:9/x?y", "https://a.b:9/robots.txt")])


def test_url_patterns(apply):
    check(apply, lambda u: urls.url_patterns(u, ["/blog", "/docs"], ["/docs/old"]), [("/blog/x", True), ("/docs/old/1", False), ("/shop", False)])
    check(apply, lambda u: urls.url_patterns(u, exclude=["x"]), [("axb", False), ("ab", True)])
    check(apply, urls.url_patterns_col, [(("/a", [], ["b"]), True), (("/a", None, None), True), (("/a", ["c"], None), False), (("/ab", ["a"], ["b"]), False)], ["string", "array<string>", "array<string>"])


def test_statuses(apply):
    check(apply, checks.is_accessible, [(199, False), (200, True), (399, True), (400, False), (None, False)], ["int"])
    check(apply, checks.is_blocked, [(403, True), (429, True), (404, False)], ["int"])
    check(apply, checks.is_success_2xx, [(299, True), (300, False)], ["int"])
    check(apply, checks.access_error, [
        ((200, None), None), ((403, None), "HTTP 403: Forbidden (may need different approach)"), ((404, ""), "HTTP 404: 404 Not Found"),
        ((200, "timeout"), "timeout"), ((599, None), "HTTP 599: 599"),
    ], ["int", "string"])


def test_sizes(apply):
    check(apply, text.enough_markdown, [(" " + "x" * 100 + "\n", False), ("x" * 101, True), ("é" * 51, True), (None, False)])
    check(apply, text.enough_html, [("x" * 99, False), ("x" * 100, True), ("é" * 50, True)])
    check(apply, text.markdown_size, [("éa", 3), ("", 0), (None, 0)])
    check(apply, lambda s: text.truncate(s, 5), [("abcde", "abcde"), ("abcdef", "abcde..."), ("aéé", "aéé"), ("ééé", "éé..."), ("ab€€", "ab€..."), ("a😀😀", "a😀...")])


def test_job_id(apply):
    check(apply, checks.valid_job_id, [("ab", False), ("abc", True), ("x" * 50, True), ("x" * 51, False), ("a c", False), ("abc\n", False), ("A_b-9", True), (None, False)])


def test_tiers(apply):
    flags = [(None, None, None), (True, False, False), (False, True, False), (False, False, True), (True, True, True)]
    assert apply(checks.sitemap_tier_enabled, flags, ["boolean"] * 3) == [True, True, False, False, True]
    assert apply(checks.html_tier_enabled, flags, ["boolean"] * 3) == [True, False, True, False, True]
    check(apply, checks.needs_html_tier, [(9, True), (10, False), (None, True)], ["int"])
    check(apply, checks.needs_headless_tier, [(4, True), (5, False)], ["int"])


def test_duration(apply):
    got = apply(checks.duration_seconds, ["1m2.5s", "200ms", "", "5", "0", "-1s", "1h", "1x", "1.s", ".5s", "2h45m", "1us", "1µs", "+2s", "1s 2s"])
    assert got == pytest.approx([62.5, 0.2, 0.2, 0.2, 0, -1, 3600, 0.2, 1, 0.5, 9900, 1e-6, 1e-6, 2, 0.2])


def test_small_scalars(apply):
    check(apply, text.parse_added, [("HTML crawling added 12 new URLs (total: 20)", 12), ("added x new URLs", None), (None, None)])
    check(apply, checks.client_ip, [(("1.1.1.1, 2.2.2.2", "3", "4"), "1.1.1.1, 2.2.2.2"), (("", "3", "4"), "3"), ((None, None, "4"), "4")], ["string"] * 3)
    check(apply, text.rate_text, [(1.0, "1.00"), (2.346, "2.35")], ["double"])
    check(apply, checks.first_header_values, [({"a": ["1", "2"], "b": []}, {"a": "1"})], ["map<string,array<string>>"])
    assert [x is not None for x in apply(checks.parse_rfc3339, ["2024-01-01T00:00:00Z", "2024-01-01", "soon"])] == [True, True, False]
    check(apply, lambda s: checks.job_status_filter(s, None), [("failed", True)])


def test_clean_markdown(apply):
    check(apply, text.clean_markdown, [
        ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \t\n## b", "a\n\n## b"), ("# a\n \n   b", "# a\n\nb"), ("a   b", "a b"), ("\n\n x \n", "x"),
        ("# a\n\n  # b\n \n c", "# a\n\n# b\n\nc"), ("x # y # z\n\n\n\n  w", "x # y # z\n\nw"), ("####### a\n\n b", "####### a\n\nb"),
        ("a # b\nc", "a # b\nc"), ("\n\n#a\n\n\n\n#b\n\n \nc\n \nd", "#a\n\n#b\n\nc\n \nd"),
    ])


def test_clean_markdown_is_fast_on_hostile_text(apply):
    assert apply(text.clean_markdown, ["#" * 200_000 + " x", "# a " * 50_000 + "\n\n b"])[0].endswith(" x")


def test_clean_text(apply):
    cases = [(f"one {p.upper()} two", "one  two") for p in text.BOILERPLATE_PHRASES if "[" not in p]
    cases += [
        (" a \n\n b\tc ", "a b c"), ("x data:image/gif;base64,R0lGOD+/= y", "x  y"), ("a [Top](#top) b [x](/y)", "a  b [x](/y)"),
        ("accept cookie policycookies x", "x"), ("cookie know morepolicy", "cookie policy"),
        ("coKokie", "coKokie"), ("booK a demo", ""), ("\u017fcroll to top", ""), ("[a] [b](#c", "[a] [b](#c"),
    ]
    check(apply, text.clean_text, cases)
