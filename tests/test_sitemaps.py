"""Sitemap trees against a depth-first walk, and documents that break off."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from pagetrail.functions.sitemap_xml import scan
from pagetrail.operators import sitemaps
from pagetrail.session import materialize
from pagetrail.sources.unpack import unpack


def walked(edges, roots):
    """(root, path, url) in document order: a document that is its own ancestor is not entered, and its first place counts."""
    out = {}

    def enter(root, path, url, above):
        out.setdefault((root, url), path)
        for pos, child in edges.get(url, []):
            if child not in above:
                enter(root, [*path, pos], child, above | {child})

    for root in roots:
        enter(root, [], root, {root})
    return sorted((r, p, u) for (r, u), p in out.items())


def opened(spark, edges, roots, **how):
    rows = [(u, pos, c) for u, kids in edges.items() for pos, c in kids]
    children = spark.createDataFrame(rows, "url string, pos int, loc string")
    found = sitemaps.expand_sitemap_index(spark.createDataFrame([(r,) for r in roots], "url string"), children, **how)
    return sorted((r.root, r.path, r.url) for r in found.collect())


def test_fully_linked_index_is_entered_once_each(spark):
    names = [f"d{k}" for k in range(7)]
    edges = {n: list(enumerate(names)) for n in names}
    got = opened(spark, edges, ["d0", "d3"])
    assert len(got) == 14 and got == walked(edges, ["d0", "d3"])


def test_long_chain_and_cycle(spark):
    edges = {f"c{k}": [(0, f"c{k + 1}")] for k in range(15)} | {"x": [(0, "y")], "y": [(0, "x"), (1, "z")], "z": [(0, "z")]}
    assert opened(spark, edges, ["c0", "x"]) == walked(edges, ["c0", "x"])
    assert [p for _, p, _ in opened(spark, edges, ["c0"], max_depth=2)] == [[], [0], [0, 0]]


@pytest.mark.parametrize("seed", range(3))
def test_random_indexes(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(8)]
    edges = {n: [(p, rng.choice(names)) for p in range(rng.randint(0, 4))] for n in names}
    assert opened(spark, edges, names[:3]) == walked(edges, names[:3])


ENTRIES = "".join(f"<url><loc> http://h/{k} </loc><lastmod>soon</lastmod></url>" for k in range(3))


def test_documents_that_break_off(spark):
    ok = f'<?xml version="1.0"?><!-- <rss> --><s:urlset xmlns:s="x">{ENTRIES.replace("url>", "s:url>").replace("loc>", "s:loc>")}</s:urlset>'
    bodies = {
        "ok": ok, "behind": f"<urlset>{ENTRIES}</urlset> junk", "front": f"\n <?xml version='1.0'?><urlset>{ENTRIES}</urlset>",
        "cut": f"<urlset>{ENTRIES}<url><loc>http://h/9</loc>", "amp": f"<urlset>{ENTRIES[:70]}<url><loc>a&b</loc></url></urlset>",
        "text": "not found", "empty": "", "html": "<!DOCTYPE html><html><url><loc>x</loc></url></html>", "none": None,
        "index": "<sitemapindex><sitemap><loc>k</loc></sitemap><sitemap><lo", "bare": "<urlset/>",
    }
    docs = spark.createDataFrame(list(bodies.items()), "url string, body string")
    listed = {}
    for r in sitemaps.parse_sitemap_docs(docs).collect():
        listed.setdefault(r.url, []).append((r.pos, r.loc))
    three = [(k, f"http://h/{k}") for k in range(3)]
    assert {u: sorted(x) for u, x in listed.items()} == {
        "ok": three, "behind": three, "front": three, "cut": three, "amp": three[:1], "index": [(0, "k")],
    }
    errors = {r.url: (r.reason, r.n_kept) for r in sitemaps.sitemap_errors(docs).collect()}
    assert errors == {
        "cut": ("no element found", 3), "amp": ("not well-formed (invalid token)", 1), "text": ("syntax error", 0),
        "empty": ("no element found", 0), "html": ("root element is html", 0), "none": ("no body", 0), "index": ("unclosed token", 1),
    }
    roots = spark.createDataFrame([("index",), ("ok",), ("cut",)], "url string")
    opened = sitemaps.open_sitemaps(roots, docs)
    assert sorted((r.root, r.url, r.reason) for r in opened.documents.where("reason IS NOT NULL").collect()) == [
        ("cut", "cut", "no element found"), ("index", "index", "unclosed token"), ("index", "k", "not fetched"),
    ]
    assert opened.entries.count() == 6


def test_scan_names_the_spot():
    body = f"<urlset>\n{ENTRIES}\n<url><loc>é</url></urlset>"
    _, locs, reason, line, place = scan(body)
    assert len(locs) == 3 and reason == "mismatched tag" and line == 3
    assert body.encode()[place - 2 :].startswith(b"</url></urlset>")
    big = f"<urlset>{ENTRIES * 20000}"
    assert len(scan(big)[1]) == 60000


def test_gzip_is_read_up_to_the_bad_spot():
    text = os.urandom(60000).hex()
    packed = gzip.compress(text.encode())
    assert unpack(packed) == (text, None, None) and unpack(packed * 2)[0] == text * 2
    head, reason, place = unpack(packed[: len(packed) // 2])
    assert reason == "truncated" and place == len(packed) // 2 and text.startswith(head) and len(head) > 50000
    spoilt = bytearray(packed)
    spoilt[-1] ^= 1
    assert unpack(bytes(spoilt))[:2] == (text, "incorrect length check")
    assert unpack(packed + b"\0\0")[:2] == (text, "bytes after the end")
    assert unpack(b"") == ("", "truncated", 0) and unpack(b"plain text")[1] == "incorrect header check"


@pytest.mark.parametrize("share", [1000, 7])
def test_inventory_unfolds_what_jobs_ask_for(spark, monkeypatch, share):
    """Against the whole listing of every job; and what is written follows the classes and limits, not the jobs."""
    monkeypatch.setattr(sitemaps, "SHARE", share)
    rng = random.Random(4)
    docs = [(f"m{d}", "<urlset>" + "".join(f"<url><loc>u{rng.randrange(400)}</loc></url>" for _ in range(120)) + "</urlset>") for d in range(6)]
    docs += [("top", "<sitemapindex>" + "".join(f"<sitemap><loc>m{d}</loc></sitemap>" for d in (3, 1, 0, 3)) + "</sitemapindex>"), ("bare", "<urlset/>")]
    lists = [["top", "m5"], ["m2"], ["m5", "top", "m4"], ["bare"]]
    found = [(f"j{k}", o, u) for k in range(60) for o, u in enumerate(lists[k % 4])]
    limits = {f"j{k}": rng.choice([None, 0, 1, 7, 130, 10_000]) for k in range(60)}
    df = spark.createDataFrame(found, "job_id string, ord int, url string")
    opened = sitemaps.open_sitemaps(df.select("url").distinct(), spark.createDataFrame(docs, "url string, body string"))
    places = {}
    for r in opened.entries.collect():
        places.setdefault(r.root, []).append((r.path, r.loc))
    want = {}
    for job, o, root in found:
        for path, loc in places.get(root, []):
            seen = want.setdefault(job, {})
            seen[loc] = min(seen.get(loc, [o, *path]), [o, *path])
    written = []

    def counted(frame, **metrics):
        out = materialize(frame, **metrics)
        written.append((frame.columns, out[1]["rows"]))
        return out

    monkeypatch.setattr(sitemaps, "materialize", counted)
    limited = sitemaps.inventory(df, opened, spark.createDataFrame(list(limits.items()), "job_id string, limit int"))
    got = {}
    for r in limited.urls.collect():
        got.setdefault(r.job_id, []).append((r.ord, r.url))
    for job, seen in want.items():
        order = list(enumerate(sorted(seen, key=seen.get), 1))
        assert sorted(got.get(job, [])) == order[: limits[job] if limits[job] is not None else None], job
    assert {r.job_id: r.n_urls for r in limited.counts.collect()} == {j: len(s) for j, s in want.items()}
    written.clear()
    few = sitemaps.inventory(df, opened, df.select("job_id", F.lit(3).alias("limit")).distinct())
    assert few.urls.count() == 45 * 3 and next(n for c, n in written if "ord" in c) == 9
