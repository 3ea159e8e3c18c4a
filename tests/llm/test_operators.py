"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetrail.llm import ann, bpe, decontam, html_lines, licenses, line_dedup, quality_fm, rans, setsketch, toxicity

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, node string, ids string, llm_keys int, n_chars long"


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, None, "x", None, 7, None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "a", "one two three", "x" * 5000, "word " * 3000, "one two three", "é ü\n\n漢字 '", "<|endoftext|>"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# line-block extraction


def test_pages_equal_their_article(spark):
    import html as references

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_lines.extract(pages).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_surge_and_dive_without_landmarks():
    page = (
        '<body><div><a href=/>Home</a></div><div class="cookie-notice">We use cookies, accept them all or leave us now.</div>'
        "<div class='content with-sidebar'><h2>Title</h2><p>" + "A long first paragraph. " * 5 + "<p>Second &eacute;<br>one</p>"
        "<div class=ad>Buy</div><p>End.</p></div><div id=comments><p>" + "I liked it a lot. " * 9 + "</div><script>if(a</p>)</script>"
    )
    assert html_lines.main_text(page) == "Title\n" + ("A long first paragraph. " * 5).strip() + "\nSecond é one\nEnd."


BODY = [f"Paragraph {k} of the body, " + "which has more to say than any teaser. " * 4 for k in range(4)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_marked_element_is_not_the_article():
    body = [t.strip() for t in BODY]
    cards = "".join(f"<article><h3><a href=/{k}>Teaser {k}</a></h3><p>Read on {k}.</p></article>" for k in range(3))
    beside = f"<body><div class=left>{cards}</div><section><div>{paragraphs(BODY)}</div></section></body>"
    assert html_lines.main_text(beside).split("\n") == body
    headline = f"<body><main><h1>Only the headline</h1></main><div>{paragraphs(BODY)}</div></body>"
    assert html_lines.main_text(headline).split("\n") == ["Only the headline", *body]
    # a marked article takes nothing away either, and keeps its own short and linked lines
    links = "".join(f"<li><a href=/{k}>Source {k}</a>" for k in range(3))
    article = f"<article>{paragraphs(BODY)}<section><div><div><p>Short.</p></div></div></section><ul>{links}</ul></article>"
    after = html_lines.main_text(f"<body>{article}<div><div><p>{BODY[0]}</p></div></div></body>").split("\n")
    assert after == [*body, "Short.", "Source 0", "Source 1", "Source 2", body[0]]
    assert html_lines.main_text("<body><article><p>Brief.</p></article></body>") == "Brief."


def test_odd_pages(spark):
    html = [None, "", "   ", "<p>short</p>", "<p>a<b", "<!-- open", "<script>x", "<p class=\"x>y", "<a>" * 2000 + "deep", "&amp;&#233;&nbsp;x"]
    pages = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_lines.extract(pages).collect()}
    assert [got[i] for i in range(len(html))] == ["", "", "", "short", "a", "", "", "y", "deep", "&é x"]
    assert html_lines.extract(pages.limit(0)).count() == 0


def test_pages_take_linear_time():
    import time

    for piece in ("<div>", "<a href='", "<i></i>x", "<ul><li>x", "</p>"):
        start = time.perf_counter()
        html_lines.main_text(piece * 20000)
        assert time.perf_counter() - start < 5, piece


# decontamination


def test_leaks_equal_containment(spark, documents):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = decontam.finders(documents, bench)
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents, found).collect()}
    texts, items = documents.collect(), bench.collect()
    want = {(d.doc_id, b.item_id) for d in texts for b in items if b.text in d.text}
    assert want <= got and len(got - want) <= 1
    assert {r.doc_id for r in decontam.keep_clean(documents, found).collect()} == {d.doc_id for d in texts} - {d for d, _ in got}


def test_paraphrase_and_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    item = [word() for _ in range(30)]
    changed = [word() if k % 9 == 4 else w for k, w in enumerate(item)]
    noise = lambda n: " ".join(word() for _ in range(n))
    texts = [*ODD, noise(200) + " " + " ".join(item).upper() + "! " + noise(50), noise(40) + " " + ", ".join(changed), noise(300)]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, None, 0), (3, "", 0), (None, "zz yy", 0)], "item_id long, text string, cosine int")
    docs = docs_of(spark, texts)
    found = decontam.finders(docs, bench)
    n = len(ODD)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, found).collect()} == {(n, 1), (n + 1, 1)}
    kept = decontam.keep_clean(docs, found)
    assert kept.schema == docs.schema and kept.count() == len(texts) - 2
    assert decontam.finders(docs, bench.limit(0)) == []
    assert decontam.leaks(docs.limit(0), found).count() == 0


def test_short_items_among_other_benchmark_words(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(600)]
    items = [[rng.choice(vocabulary) for _ in range(1 + i % 7 if i % 7 > 1 else rng.randint(15, 59))] for i in range(200)]
    items += [items[2], ["once"], ["never"]]  # two items of the same words; items of one word
    words = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + own + [rng.choice(vocabulary) for _ in range(60)] for own in items[:-1]]
    words += [items[2][:-1], items[2][-1:]]  # two texts that hold an item only together
    bench = spark.createDataFrame([(i, " ".join(own)) for i, own in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, [*ODD, *(", ".join(own) for own in words)])
    stands = lambda own, text: any(text[k : k + len(own)] == own for k in range(len(text) - len(own) + 1))
    short = {i for i, own in enumerate(items) if len(own) < decontam.SHORTEST}
    want = {(len(ODD) + d, i) for d, text in enumerate(words) for i in short if stands(items[i], text)}
    found = decontam.finders(docs, bench)
    rows = [r for r in decontam.leaks(docs, found).collect() if r.item_id in short]
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 140
    assert all(r.lcs_share == 1 and r.answer_found for r in rows)
    assert not {d for d, _ in want} & {r.doc_id for r in decontam.keep_clean(docs, found).collect()}


def test_passage_that_fills_most_blocks(spark):
    often, rare = " ".join(f"often{k}" for k in range(30)), " ".join(f"rare{k}" for k in range(30))
    bench = spark.createDataFrame([(1, often), (2, rare)], "item_id long, text string")
    docs = docs_of(spark, [*[often] * 4, f"{rare} end", "clean words here", "other clean words", often[:-1], f"so {often}"])
    found = decontam.finders(docs, bench)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, found).collect()} == {*((d, 1) for d in (0, 1, 2, 3, 8)), (4, 2)}


# byte-level BPE


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    pieces = [*"ab'stmdrvel  \t\n\r　é1²½.,!?́漢\U0001f600\x85\x1c", "'s", "'re", "'ll", " '", "  ", "\n\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["a" * 3000, " " * 300, "ab" * 999]
    ids, at = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode_ordinary(t) for t in texts]
    back, where = codec.decode(ids, at)
    assert [back[a:b].decode() for a, b in zip(where, where[1:])] == texts
    got = {r.doc_id: r for r in bpe.round_trip(docs_of(spark, ODD), path, ids=True).collect()}
    for i, t in enumerate(ODD):
        want = library.encode_ordinary(t or "")
        assert list(got[i].ids) == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.round_trip(docs_of(spark, ODD), path, ids=True), path).collect()}
    assert [texts[i] for i in range(len(ODD))] == [t or "" for t in ODD]
    assert bpe.round_trip(docs_of(spark, []), path).count() == 0


def test_bpe_holds_little_of_a_batch(spark):
    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run

    docs, rng = Docs(), random.Random(2)
    bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], ["doc_id", "text"])
    list(docs.run(iter([batch.slice(0, 1)])))  # tables of the codec
    tracemalloc.start()
    rows = sum(out.num_rows for out in docs.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1500 and peak < 8 * batch.nbytes, peak / batch.nbytes


# line dedup

LINE = "A line that is long enough to be looked at by the operator"
LINES = [LINE, "  " + LINE.upper() + "\t", "own\n" + LINE + "\nend\n" + LINE, LINE, None, "", LINE + "\n", "short", LINE]
IDS = [3, 1, 2, 7, 4, 5, 6, 8, None]


def test_lines_of_odd_rows(spark):
    docs = docs_of(spark, LINES, IDS)
    index = line_dedup.build(docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.digest(docs, index).collect()}
    assert got == {3: (1, 1), 1: (1, 1), 2: (4, 2), 7: (1, 0), 4: (1, 0), 5: (1, 0), 6: (2, 1), 8: (1, 0), None: (1, 1)}
    out = line_dedup.drop_lines(docs, index)
    assert out.schema == docs.schema
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {3: "", 1: "", 2: "own\nend", 7: LINE, 4: None, 5: "", 6: "", 8: "short", None: ""}
    empty = docs_of(spark, [])
    assert line_dedup.digest(empty, line_dedup.build(empty)).count() == 0


def state(index):
    refs = {(bytes(r.key), r.doc_id) for r in index.refs.collect()}
    counts = {bytes(r.key): (r.n_docs, r.top_doc) for r in index.counts.collect()}
    kept = {k for k, (n, _) in counts.items() if n >= index.min_docs}
    sure = [k for r in index.filters.collect() for k in kept if line_dedup.Cuckoo.load(bytes(r.cells)).contains([k])[0]]
    return refs, counts, set(sure) == kept


def test_deletion_undoes_insertion(spark):
    other = [LINE, LINE.replace("line", "text"), None]
    first, later = docs_of(spark, LINES, IDS), docs_of(spark, other, [20, 21, 22])
    index = line_dedup.build(first)
    more = line_dedup.insert(index, later)
    assert state(more)[:2] == state(line_dedup.build(first.union(later)))[:2] and state(more)[2]
    back = line_dedup.delete(more, later.select("doc_id"))
    assert state(back) == state(index)
    less = line_dedup.delete(index, first.where("doc_id in (1, 2, 3, 6)").select("doc_id"))
    assert line_dedup.dropped_keys(less).count() == 0


def test_cuckoo_filter_has_no_false_negative():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    held = line_dedup.Cuckoo.load(bytes(line_dedup.Cuckoo.of(keys[:2000])))
    assert held.contains(keys[:2000]).all() and held.contains(keys[2000:]).mean() < 0.01
    for k in keys[:1000]:
        held.delete(k)
    assert held.contains(keys[1000:2000]).all() and held.contains(keys[:1000]).mean() < 0.01


# toxicity and quality


@pytest.mark.parametrize(("module", "label", "limit"), [(toxicity, "toxic", 0.8), (quality_fm, "quality", 0.93)])
def test_held_out_accuracy(spark, module, label, limit):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").where(~module.in_training(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= limit
    divisor, keep = (3, lambda m: m != 1) if module is toxicity else (5, lambda m: m != 0)
    ids = labels.select("doc_id", module.in_training(F.col("doc_id")).alias("t")).collect()
    assert all(r.t == keep(zlib.crc32(str(r.doc_id).encode()) % divisor) for r in ids)


@pytest.mark.parametrize("module", [toxicity, quality_fm])
def test_classifiers_on_odd_rows(spark, module):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(3, 1, 1, "x"), (4, 0, 0, "x"), (5, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in module.score(docs, module.train(docs, labels.limit(0))).collect()} <= {0.5} or module is toxicity
    assert module.score(docs.limit(0), model).count() == 0


def test_toxicity_keeps_the_balance_of_labels(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(16)) for _ in range(2200)]  # the label is not in the words
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 11 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    means = []
    for per_class in (5000, 150):
        scored = toxicity.score(docs, toxicity.train(docs, labels, lambda _: F.lit(True), per_class))
        means.append(np.mean([np.log(r.score / (1 - r.score)) for r in scored.collect()]))
    assert abs(means[0] - means[1]) < 0.7, means


def test_toxicity_learns_from_every_segment(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(50)]
    texts = []
    for i in range(200):
        own = [rng.choice(words) for _ in range(16 * 127)]
        if i % 2:
            own[16 + i % 16] = "zzyxqv"  # in the second segment of 127
        texts.append(" ".join(own))
    docs = docs_of(spark, [*texts, "zzyxqv " + texts[0][:80], texts[0][:80]])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels, lambda _: F.lit(True))).collect()}
    assert got[200] > 0.7 > got[201]


# nearest neighbours


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8)).round(3)
    x[:400] = x[0]  # a vector that very many rows share
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5100, [0.0] * 8, ""), (5200, [float("nan")] + [1.0] * 7, ""), (5300, [None] + [1.0] * 7, ""), (5400, [1.0], ""), (None, [1.0] * 8, "")]
    rows += rows[:3]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), k=10, every=100).collect()
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for _, i in sorted(zip(d, range(1500))) if i != q][:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == d[v] for _, v, s in own)
        hit, total = hit + len({v for _, v, _ in own} & set(want)), total + 10
        if q < 400:
            assert [v for _, v, _ in own] == want
    assert hit / total >= 0.9 and {r.query_id for r in got} == set(range(0, 1500, 100))
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# SetSketch


def components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(90)]
    texts = list(ODD)
    for k in range(60):  # a family around the threshold: pairs of it are linked or just not
        own = list(base)
        for _ in range(k % 5):
            own[rng.randrange(len(own))] = f"new{rng.randrange(9)}"
        texts.append(" ".join(own).upper() if k % 7 == 0 else "  ".join(own))
    texts += ["Equal text of six words here"] * 20
    want, sizes = components(texts, 4, 80)
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def family(rng, n, words=90, changes=5):
    """Copies of one text with some words changed: pairs are links, near misses and neither."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(1, changes)):
            own[rng.randrange(words)] = f"new{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def test_components_of_many_blocks(spark, monkeypatch):
    # small blocks, so that buckets and clusters are cut into many
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 16)
    monkeypatch.setattr(setsketch, "BLOCK_ITEMS", 900)
    rng = random.Random(11)
    texts = [t for n in (70, 50, 3) for t in family(rng, n)] + ["one two three four five"] * 3 + ["", None]
    want, sizes = components(["" if t is None else t for t in texts], 4, 80)
    assert 5 < len(set(want[:70])) < 60
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_no_pairs_of_a_large_group(spark):
    n = 250
    docs = docs_of(spark, [t for t in family(random.Random(3), n) for _ in range(2)], [k // 10 for k in range(2 * n)])
    drawn = setsketch.sketch(docs, 4)
    nodes = drawn.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    banded = setsketch.cut(setsketch.bands(nodes))
    multi = banded.join(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band")
    pairs = setsketch.cut(setsketch.likely_forest(multi, nodes, 0.8))
    near = setsketch.components(pairs)
    assert near.select("root").distinct().count() < 5 and pairs.count() < multi.count() - multi.select("band").distinct().count() + 1
    sets = setsketch.sets_of(near, docs, nodes, 4)  # ten texts share an id: still one set a node
    assert sets.count() == near.count() and sets.select("node").distinct().count() == near.count()
    found = setsketch.linked_forest(near.selectExpr("xxhash64(root) cluster", "0 p", "0 q", "node", "node root").join(sets, "node"), 80)
    assert 0 < found.count() < n


@pytest.mark.parametrize("cuts", [(40,), (1, 2, 3), (7, 8, 30), ()])
def test_groups_come_whole(cuts):
    key = np.repeat(np.arange(12), [3, 1, 1, 5, 2, 9, 1, 1, 8, 3, 4, 2])
    table = pa.RecordBatch.from_arrays([pa.array(key), pa.array(range(40))], ["g", "row"])
    edges = [0, *cuts, 40]
    out = list(setsketch.whole_groups((table.slice(a, b - a) for a, b in zip(edges, edges[1:])), ["g"]))
    assert [r for t, _ in out for r in t.column("row").to_pylist()] == list(range(40))
    parts = [set(t.column("g").to_pylist()) for t, _ in out]
    assert sum(map(len, parts)) == 12 and all(len(set(n)) == len(p) for (_, n), p in zip(out, parts))


def test_forest_spans_each_group():
    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 30, 300))
    kind = rng.integers(0, 4, 300)
    x, y = setsketch.grown(group, lambda a, b: kind[a] == kind[b])
    assert (group[x] == group[y]).all() and (kind[x] == kind[y]).all()
    assert len(x) == 300 - len(set(zip(group.tolist(), kind.tolist()))) and len(set(y.tolist())) == len(y)


def test_near_duplicates_of_odd_ids(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "only null", None], [9, 9, None, None, None, 4])
    got = sorted((r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(0, 4, True), (2, 9, True), (2, 9, True)]
    assert setsketch.near_duplicates(docs_of(spark, [])).count() == 0


def test_likelihood_meets_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        keep = int(2 * 2000 * share / (1 + share))
        b = np.concatenate([a[:keep], rng.integers(0, 1 << 63, 2000 - keep, dtype=np.uint64)])
        r, s = (setsketch.registers(setsketch.minima(x)) for x in (a, b))
        assert (setsketch.registers(np.minimum(setsketch.minima(a), setsketch.minima(b))) == np.maximum(r, s)).all()  # mergeable
        found = setsketch.likely(np.array([(r > s).sum()]), np.array([(r < s).sum()]), np.array([2000.0]), np.array([2000.0]))
        assert abs(found[0] - share) < 0.15


# licenses


def test_licenses_equal_brute_force(spark):
    texts = [*ODD, "Released UNDER the MIT-License, under the mit license", "cc by nc cc by nc", "SPDX License Identifier: GPL 3.0 only"]
    texts += ["licensed under the gnu general public license v3", "under the mit", "mit " * 500, "K under the mit license"]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for p, label in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
    n = len(ODD)
    assert got[n + 2].labels == "gpl-3" and got[n + 3].labels == "gpl-3" and got[n + 3].score == 1.0
    assert got[0].labels == "" and got[0].score == 0.0
    assert licenses.scan(docs_of(spark, [])).count() == 0
    assert len(licenses.rules()) > 200


def test_names_that_are_words_need_a_citation(spark):
    plain = ["Er kam mit dem Zug und mit 0 Punkten", "computing at mit, boston", "please cc by mail", "mit", "the isc met", "mit Lizenz"]
    cited = ["the MIT License", "released under mit", "licensed as ISC", "Lizenz: cc by 4.0 license", "bsd 2 clause", "spdx-license-identifier: MIT"]
    got = {r.doc_id: r.labels for r in licenses.scan(docs_of(spark, plain + cited)).collect()}
    assert [got[k] for k in range(len(plain))] == [""] * len(plain)
    assert [got[len(plain) + k] for k in range(len(cited))] == ["mit", "mit", "isc", "cc-by", "bsd-2-clause", "mit"]
    german = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'de'")
    labels = {r.doc_id: r.labels.split(",") for r in licenses.scan(german).collect()}
    texts = {r.doc_id: r.text.lower() for r in german.collect() if "mit" in labels[r.doc_id]}
    assert all("mit licen" in t or "under mit" in t or "under the mit" in t for t in texts.values())


# rANS


@pytest.mark.parametrize("n", [1, 5, rans.LANES, rans.LANES + 1, rans.LANES * rans.STEPS, rans.LANES * rans.STEPS + 1, 300_000])
def test_blocks_come_back(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint32)
    seen = np.bincount(ids)
    table = rans.Table(rans.scale({int(i): int(seen[i]) for i in np.flatnonzero(seen)}))
    block = table.encode(ids)
    assert (table.decode(block) == ids).all()
    broken = block | {"crcs": bytes(len(block["crcs"]))}
    with pytest.raises(ValueError):
        table.decode(broken)


def test_files_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "Hello WORLD's é a\x1cb c", "same"]
    ids = [5, 3, 9, 1, 0, 2, 8, 7, 6, 4, None, 3]
    folder = rans.write_documents(docs_of(spark, texts, ids), path)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in rans.read(spark, folder, ids=True).collect())
    coded = [(-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in zip(ids, texts)]
    assert sorted((i, x) for _, i, _, _, x in got) == sorted(coded)
    assert [g[1] for g in got] == sorted(i for i, _ in coded)
    start = 0
    for at, _, n, crc, x in got:
        assert (at, n, crc) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += n
    assert rans.read(spark, rans.write_documents(docs_of(spark, []), path)).count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("x"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, corpus_pipeline.cut(stage(spark, out, folder))
        assert out.dtypes == docs.dtypes, name
        assert out.join(before, "doc_id", "left_anti").count() == 0
        if name == "line dedup":
            assert out.count() == before.count()
    assert 0.5 * docs.count() < out.count() < docs.count()
    assert setsketch.near_duplicates(out).where("not kept").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, out, folder)
    assert last.count() == out.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    group = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [
        *((1, "a"), (None, "a"), (None, "alone"), (None, "other")),  # a copy without id takes no other such row with it
        *((2, "b"), (3, "b"), (3, "c"), (4, "c")),  # 3 is a copy in one group and the smallest id of another
        *((5, "d"), (5, "d"), (5, "e")),  # repeated rows of one id
        *((None, "f"), (None, "f"), (None, "f")),  # copies without any id
    ]
    docs = docs_of(spark, [*(group(name) for _, name in rows), None, "", ""], [*(i for i, _ in rows), None, None, 1])
    for given in (docs, corpus_pipeline.cut(docs.repartition(3))):
        out = corpus_pipeline.near_duplicates(spark, given, FOLDER)
        assert out.schema == docs.schema
        got = sorted((r.doc_id or 0, (r.text or "0").split("0")[0]) for r in out.collect())
        assert got == [(0, ""), (0, ""), (0, "alone"), (0, "f"), (0, "other"), (1, ""), (1, "a"), (2, "b"), (3, "c"), (5, "d"), (5, "e")]
