"""Hard negatives, tokenizer alignment and packing against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagetrail.llm import alignment, hard_negatives, packing, vocabulary

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, key binary, n long, row long, ids string, block string, sequence_id string"

HARD = [
    None, "", " ", "a", "  two  spaces ", "a  b", "<unk> </s> <|endoftext|> x", "▁ under", "é ü\n\n漢字 '\x00", "😀👍🏽", "same text here",
    "same text here", "same text here", "x" * 9000, "word " * 3000, " " * 3000, "don't WE'LL 1234567 1e-5", " nbsp　wide", "tab\tand\r\nline",
]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, None, "x", "y", None) for i, t in zip(ids, texts)], DOCS)


def prose(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéhilmnorst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    mark = lambda: rng.choice([" ", " ", " ", ", ", ".\n", "  ", " 17 "])
    return ["".join(rng.choice(words) + mark() for _ in range(rng.randint(0, 400))) for _ in range(n)]


# vocabularies


def library(special):
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = not special
    return made


def test_ids_equal_the_library():
    coder = vocabulary.byte_level(JSON)
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}" for c in points] + [t for t in HARD if t] + prose(20) + [" " * 1_500_000 + "x"]
    for special in (True, False):
        want = library(special).encode_batch(texts, add_special_tokens=False)
        assert all(coder.encode(t, special).tolist() == w.ids for t, w in zip(texts, want))
    assert coder.bytes.join(coder.encode("naïve 漢 <|endoftext|>", True)).tobytes().decode() == "naïve 漢 <|endoftext|>"


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, rng = vocabulary.word_bpe(path), random.Random(1)
    parts = [*"abcdefghijklmnopqrstuvwxyzABCZ0123456789.,!?-_'éüßñÉÅ漢ΣσςİǅŉœŒ", "the", "ing", "'ll", "'S", "tion", "<|endoftext|>", "e\u0301", "\x01", "\x1c", "\x85", "\xa0", "\xad", "\u200b"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(60_000)]
    words += [chr(c) + "a" + chr(c) for c in range(0x21, 0x3000) if not chr(c).isspace()] + ["x" * 20_000, "Word" * 500, "", "12345", "a1b2", "..."]
    want = Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(words, "<u2")] == [w.ids for w in want]
    assert coder.encode([], "<u2") == [] and sum(map(coder._plain, words)) > 10_000


# hard negatives

ROWS = "vec_id long, embedding array<double>, label int, score double, shard string, vec string, positive_score long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, k, None, "s", "v", 1) for i, v, k in rows], ROWS)


def brute_negatives(rows, every, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            s = scores[p]
            fit = [i for i in order if kept[i][0] != label and low * s <= 100 * scores[i] <= high * s][:negatives]
            out |= {(a, p, r, i, s, scores[i]) for r, i in enumerate(fit, 1)}
    return out


def mined(df, **how):
    rows = [tuple(r) for r in hard_negatives.mine(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(n, d, labels, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    return [(int(i), (scale * (centres[k] + rng.normal(size=d))).tolist(), int(k)) for i, k in enumerate(label)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    # small groups, so that shards and parts are many
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    rows = random_rows(900, 12, 4, 1, 0.1)
    assert mined(vectors_of(spark, rows), every=10) == brute_negatives(rows, 10)


def test_negatives_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.25, -0.25, 0.5]) for _ in range(3)], i % 3) for i in range(-60, 200)]
    rows += [(i, [0.5, 0.25, 0.0], 1) for i in range(200, 320)]  # a frequent vector
    rows += [(320, None, 1), (321, [0.5, None, 0.1], 1), (322, [float("nan"), 0.0, 1.0], 2), (323, [float("inf"), 0.0, 1.0], 2)]
    rows += [(324, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1), (325, [], 1), (326, [0.5], 2), (330, [0.1, 0.2, 0.3, 0.4], 0)]
    rows += [(0, [0.5, 0.5, 0.5], 0)] * 3 + [(10, [0.25, 0.0, 0.5], 2), (10, [0.25, 0.0, 0.25], 0)]
    assert mined(vectors_of(spark, rows), every=10) == brute_negatives(rows, 10)
    assert mined(vectors_of(spark, []), every=10) == set()
    assert mined(vectors_of(spark, [(0, [1.0], 1)]), every=10) == set()


def test_negatives_of_large_components(spark):
    """Products beyond 53 bits go by Python integers."""
    rows = random_rows(120, 5, 3, 2, 100_000.0)
    assert mined(vectors_of(spark, rows), every=10) == brute_negatives(rows, 10)


@pytest.mark.parametrize("top", [1, 90, 4000, 1 << 20, 1 << 27, 1 << 40])
def test_fields_hold_exact_products(top):
    rng = np.random.default_rng(top)
    rows, anchors = (np.floor(rng.uniform(-top, top, (n, 17))) for n in (301, 9))
    packed = hard_negatives.Fields(rows, float(np.abs(anchors).sum(1).max()))
    want = [[sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows] for a in anchors]
    assert packed.products(anchors).tolist() == want
    assert packed.per == {1: 10, 90: 2, 4000: 1, 1 << 20: 1, 1 << 27: 16, 1 << 40: 16}[top]
    none = hard_negatives.Fields(rows[:0], 10.0)
    assert none.products(anchors).shape == (9, 0)


# alignment


def brute_alignment(rows):
    """By single bytes: for each text the groups and links, then counts over all rows."""
    first, second = library(False), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    char = {c: b for c, b in vocabulary._bytes_of_characters().items()}
    name = {i: t for t, i in first.get_vocab(True).items()}
    found = []
    for doc, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        a_bytes = [bytes(char[c] for c in name[i]) for i in a]
        piece = second.id_to_piece
        b_bytes = [bytes([int(piece(i)[3:5], 16)]) if second.is_byte(i) else piece(i).replace("▁", " ").encode() for i in b]
        source = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != source or b"".join(b_bytes) != source:
            found.append((doc, 0, 0, [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(x, y) for x, p in zip(a, a_ends) for y, q in zip(b, b_ends) if p == q]
        groups, low = [], 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            inside = lambda ids, at: ",".join(str(i) for i, e in zip(ids, at) if low < e <= cut)  # noqa: B023, E731
            groups.append(f"{inside(a, a_ends)}|{inside(b, b_ends)}")
            low = cut
        found.append((doc, len(a), len(b), groups, links))
    count = Counter(x for f in found for x in f[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(
        (d, n_a, n_b, len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for d, n_a, n_b, g, x in found
    )


def aligned(df):
    return sorted(tuple(r) for r in alignment.align_documents(df, JSON, MODEL).collect())


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(alignment, "HOT", 5)
    texts = [t for t in HARD if t is None or len(t) < 5000] + [t[:600] for t in prose(60)] + ["a hot text, of a third of all"] * 40
    rows = list(enumerate(texts)) + [(3, "same text here"), (3, None)]
    assert aligned(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])) == brute_alignment(rows)


def test_alignment_of_long_and_empty(spark):
    long = ["word " * 3000, "x" * 9000, "ab cd\n" * 400_000]
    rows = {r[0]: r for r in aligned(docs_of(spark, long))}
    assert rows[2][1] > 1_000_000 and rows[2][3] == rows[2][4] > 0 and rows[0][3] > 0
    assert aligned(docs_of(spark, [])) == []
    assert aligned(docs_of(spark, [None, "", "▁"])) == [(i, 0, 0, 0, 0, 0, 0, "") for i in range(3)]


# packing


def brute_pieces(rows, size):
    coder, out = library(True), []
    for doc, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check_packed(rows, size):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(held)


def test_packing_equals_brute_force(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = packing.pack_documents(documents, JSON, 256).collect()
    want = brute_pieces([(r.doc_id, r.text) for r in documents.collect()], 256)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    least = -(-sum(w[3] for w in want) // 256)
    assert least <= check_packed(rows, 256) <= least * 1.01 + 1


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 4)
    ids = [None, 1, 1, *range(3, len(HARD))]
    rows = packing.pack_documents(docs_of(spark, HARD, ids), JSON, 64).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    assert got == brute_pieces(list(zip(ids, HARD)), 64)
    check_packed(rows, 64)
    assert packing.pack_documents(docs_of(spark, []), JSON).collect() == []


def test_sequences_hold_the_ids(spark):
    texts = [t for t in prose(30) if t]
    packed = packing.pack_documents(docs_of(spark, texts), JSON, 512, ids=True)
    back = {}
    for r in packed.collect():
        back.setdefault(r.doc_id, {})[r.piece] = r.ids
    whole = {d: [i for k in sorted(parts) for i in parts[k]] for d, parts in back.items()}
    assert whole == {k: [*library(True).encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    made = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in made) == sum(map(len, whole.values())) and max(len(r.ids) for r in made) <= 512


def test_fill_places_by_least_squares():
    """Each placement against the sum of squares worked out anew for every choice."""
    rng, size = random.Random(4), 40
    lengths = sorted((rng.randint(1, size) for _ in range(300)), reverse=True)
    sequence, offset = packing.fill(np.array(lengths), size)
    gaps = {}
    for length, own, at in zip(lengths, sequence.tolist(), offset.tolist()):
        squares = {}
        for gap in sorted({g for g in gaps.values() if g >= length}):
            after = Counter(gaps.values())
            after[gap] -= 1
            after[gap - length] += 1
            squares[gap] = sum(n * n for g, n in after.items() if g)
        want = min(squares, key=lambda g: (squares[g], g)) if squares else size
        assert size - at == want == gaps.get(own, size)
        gaps[own] = want - length


# exact look-up of benchmark passages, and the sample that classifiers are fitted on


def test_every_planted_passage_is_found(spark):
    """Items of a common vocabulary, put word for word between other words of it."""
    from pagetrail.llm import decontam

    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(400)])
    draw = lambda n: " ".join(words[np.minimum(rng.zipf(1.3, n), 400) - 1])
    items = [draw(int(n)) for n in rng.integers(3, 60, 300)]
    texts = [f"{draw(150)} {item} {draw(150)}" for item in items]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, decontam.finders(docs, bench)).collect()}
    want = {(d, k) for d, t in enumerate(texts) for k, item in enumerate(items) if f" {item} " in f" {t} "}
    assert want <= got and len(want) >= 300


@pytest.mark.parametrize("partitions", [3, 7])
def test_labelled_sample_of_repeated_rows(spark, partitions):
    from pagetrail.llm.common import labelled_sample

    docs = spark.createDataFrame([(k, f"text {k} {c}") for k in range(100) for c in range(4)], "doc_id long, text string").repartition(partitions)
    rows = [(k, k % 2) for k in range(100)] * 2 + [(4, 1), (None, 1), (7, None), (11, 5)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int").repartition(partitions)
    sample, sizes = labelled_sample(docs, labels, "toxic", lambda i: i >= 0, 10)
    got = sorted((r.text, r.label) for r in sample.collect())
    assert sizes == {0: 49, 1: 50} and [label for _, label in got].count(1) == 10 and len(got) == 20
    assert all(t.endswith(" 0") and int(t.split()[1]) % 2 == label for t, label in got)
    assert got == sorted((r.text, r.label) for r in labelled_sample(docs.coalesce(1), labels, "toxic", lambda i: i >= 0, 10)[0].collect())
