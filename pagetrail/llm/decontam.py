"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are split into passages (an item of up to ``LONGEST`` words is one). Words are lowered runs of letters
   and digits, in 64-bit hashes. How many blocks of ``BLOCK`` words of *all* documents hold each benchmark word gives
   its inverse frequency; a word in more than ``COMMON`` of the blocks weighs nothing.
2. A distributed randomised SVD of the passages' TF-IDF matrix A: each task multiplies its rows with a Gaussian test
   matrix and back (A'(A Omega)), tasks' sums are added, and the Nystrom formula gives the leading right singular vectors.
   Documents are folded in: their words outside the benchmark are orthogonal to every passage.
3. Documents are read in windows of two blocks, one block apart, whole texts. A window is a candidate for each passage
   whose cosine in the latent space is ``COSINE`` or more, if its part along the passage is ``COVER`` of the passage's
   length or more: a window holds half of the longest passage at least, so of a leak it holds more than that.
4. A candidate is verified on the window and its surroundings by the longest common subsequence with the passage: a leak
   if it covers ``EXACT`` of the passage, or ``LOOSE`` of it with the answer there: the passage's ``ANSWER`` words of
   highest inverse frequency.
5. Every passage also leaks where it stands word by word, sought by the hash of its first words at every word of every
   text and compared whole. Passages under ``SHORTEST`` words, which other benchmark words in a window drown, and those
   whose words all weigh nothing, as they stand in very many blocks, are sought in this way only: changed copies of these
   are not found.

Texts never move: counting and search are maps. Passages go to the driver in parts of at most ``PART`` (by hash of the
item), and each part has its own basis and search; a task holds the searches of all parts, so it grows with the benchmark.
Null and wordless items leak nowhere; null and wordless texts have no leaks. Rows with the same doc_id are judged row by
row. With an empty benchmark nothing is found and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, chunks, cut, flat, mix, slice_hash, words

BLOCK, LONGEST, STEP = 32, 96, 32
COMMON = 0.35
RANK, OVER = 128, 8
COSINE, COVER = 0.4, 0.3
EXACT, LOOSE, ANSWER, SHORTEST = 0.8, 0.65, 3, 8
PART = 1024


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the bounds of each text."""
    text = flat(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, bounds = words(text, ALNUM)
    return slice_hash(text.data, starts, ends), bounds


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes) of every passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_hashes(batch.column(1))
            at, out = [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                ranges = [(a, b)] if b - a <= LONGEST else [(max(a, min(k, b - 2 * BLOCK)), min(k + 2 * BLOCK, b)) for k in range(a, b - BLOCK, STEP)]
                for x, y in ranges if b > a else []:
                    at.append(i)
                    out.append(hashes[x:y].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(out, pa.list_(pa.int64()))], ["item_id", "words"]
            )

    picked = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "item_id long, words array<long>").dropDuplicates()


def lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of hashes that are in the sorted vocabulary, and their numbers there."""
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # one look at 16 bits of the hash settles most words
    gate = np.zeros(1 << 20, bool)
    gate[(vocabulary >> U64(44)).astype(np.int64)] = True
    at = np.flatnonzero(gate[(hashes >> U64(44)).astype(np.int64)])
    number = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    ok = vocabulary[number] == hashes[at]
    return at[ok], number[ok]


def blocks_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block, the first block of each text (and the end), and each block's text."""
    per = -(-np.diff(bounds) // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(per)), per)
    return bounds[:-1][owner] + (np.arange(len(owner)) - first[:-1][owner]) * BLOCK, first, owner


def block_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many blocks of all documents each word of ``vocabulary`` stands, and how many blocks there are."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for i, j in chunks(batch.column(0)):
                hashes, bounds = word_hashes(batch.column(0).slice(i, j - i))
                begins, _, _ = blocks_of(bounds)
                at, number = lookup(vocabulary, hashes)
                block = np.searchsorted(begins, at, "right") - 1
                total[:size] += np.bincount(np.unique(block * size + number) % size, minlength=size) if len(at) else 0
                total[size] += len(begins)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["number", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "number long, n long")
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("number").agg(F.sum("n").alias("n")).collect():
        counts[r.number] = r.n
    return counts[:size], int(counts[size])


def svd(part: DataFrame, vocabulary: np.ndarray, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (words x rank) of the TF-IDF rows of ``part`` (words)."""
    size, width = len(vocabulary), min(rank + OVER, len(vocabulary))
    omega = np.random.default_rng(3).normal(size=(size, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, width))
        for batch in batches:
            for own in batch.column(0):
                x = tf_idf(own.values.to_numpy().view(U64), vocabulary, weight)
                sums += np.outer(x, x @ omega)
        for k in range(0, size, 256):
            rows = sums[k : k + 256]
            if rows.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw, np.float64) for raw in table.column("rows").to_pylist())
        return pa.table({"k": table.column("k").slice(0, 1), "rows": pa.array([total.tobytes()], pa.binary())})

    y = np.zeros((size, width))
    partial = part.select("words").mapInArrow(run, "k int, rows binary")
    for r in partial.groupBy("k").applyInArrow(add, "k int, rows binary").collect():
        own = np.frombuffer(bytes(r.rows), np.float64).reshape(-1, width)
        y[r.k : r.k + len(own)] = own
    # Nystrom: A'A is about Y (Omega' Y)^-1 Y'
    shift = 1e-10 * max(1.0, np.linalg.norm(y))
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-12
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank]


def tf_idf(hashes: np.ndarray, vocabulary: np.ndarray, weight: np.ndarray) -> np.ndarray:
    _, number = lookup(vocabulary, hashes)
    return np.bincount(number, minlength=len(vocabulary)) * weight


class Grams:
    """Sequences of words by the hash of their first ``SHORTEST`` words, then compared whole."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists, self.lengths = lists, np.array([len(own) for own in lists], np.int64)
        self.heads = {}
        for head in sorted({min(len(own), SHORTEST) for own in lists}):
            number = np.flatnonzero(np.minimum(self.lengths, SHORTEST) == head)
            key = np.array([self.hashes(lists[p][:head], head)[0] for p in number.tolist()], U64)
            order = np.argsort(key, kind="stable")
            self.heads[head] = (*np.unique(key[order], return_index=True, return_counts=True), number[order])

    @staticmethod
    def hashes(words_: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on."""
        out = np.zeros(max(0, len(words_) - size + 1), U64)
        for k in range(size):
            out = out * U64(0x9E3779B97F4A7C15) + words_[k : k + len(out)]
        return mix(out)

    def find(self, words_: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of all places where a sequence stands within one text, and the numbers of the sequences."""
        at, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for head, (distinct, first, times, number) in self.heads.items():
            place, which = lookup(distinct, self.hashes(words_, head))
            end = bounds[np.searchsorted(bounds, place, "right")]
            for k in range(int(times.max())):  # the k-th sequence of an equal hash
                more = times[which] > k
                begin, row = place[more], number[first[which[more]] + k]
                inside = begin + self.lengths[row] <= end[more]
                begin, row = begin[inside], row[inside]
                for size in np.unique(self.lengths[row]).tolist():
                    own = self.lengths[row] == size
                    lists = np.array([self.lists[p] for p in row[own].tolist()], U64)
                    same = (words_[begin[own][:, None] + np.arange(size)] == lists).all(axis=1)
                    at.append(begin[own][same])
                    found.append(row[own][same])
        return np.concatenate(at), np.concatenate(found)


class Finder:
    """Search for the passages of one part; sent to tasks, at most ``PART`` passages of ``LONGEST`` words large."""

    def __init__(self, items: list[int], lists: list[np.ndarray], vocabulary, weight, basis):
        self.items, self.vocabulary = items, vocabulary
        used = weight > 0
        self.used_vocabulary, self.rows = vocabulary[used], (basis * weight[:, None])[used].astype(np.float32)
        latent = np.array([tf_idf(w, vocabulary, weight) @ basis for w in lists])
        self.length = np.linalg.norm(latent, axis=1).astype(np.float32)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.lists, self.places, self.answers = [w.tolist() for w in lists], [], []
        idf = dict(zip(vocabulary.tolist(), weight.tolist()))
        self.drawn = (self.length > 0) & np.array([len(own) >= SHORTEST for own in lists], bool)
        # every passage is sought word by word too, so that a cosine can lose changed copies only
        self.exact = Grams(lists)
        for own in self.lists:
            place = {}
            for k, w in enumerate(own):
                place[w] = place.get(w, 0) | 1 << k
            self.places.append(place)
            self.answers.append(sorted(place, key=lambda w: (-idf[w], w))[:ANSWER])

    def check(self, passage: int, context: list[int]) -> tuple[float, bool]:
        """Share of the passage in the longest common subsequence, and whether its answer is there."""
        own, place = self.lists[passage], self.places[passage]
        full = (1 << len(own)) - 1
        row = full
        for w in context:
            bits = place.get(w)
            if bits:
                hit = row & bits
                row = ((row + hit) | (row - hit)) & full
        return (len(own) - row.bit_count()) / len(own), set(self.answers[passage]) <= set(context)

    def find(self, column: pa.Array) -> list[dict[int, tuple[float, float, bool]]]:
        """Per text: item -> cosine, share of the longest common subsequence, answer, of its best passage that leaks."""
        hashes, bounds = word_hashes(column)
        begins, first, owner = blocks_of(bounds)
        out: list[dict] = [{} for _ in range(len(bounds) - 1)]
        at, number = lookup(self.used_vocabulary, hashes)
        exact = self.exact.find(hashes, bounds)
        if not len(at) and not len(exact[0]):
            return out
        block = np.searchsorted(begins, at, "right") - 1
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        sums = np.zeros((len(begins) + 1, self.rows.shape[1]), np.float32)
        slot = np.arange(len(at)) - edge[np.searchsorted(edge, np.arange(len(at)), "right") - 1]
        order = np.argsort(slot, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):  # the k-th words of all blocks
            sums[block[part]] += self.rows[number[part]]
        same = np.append(owner[1:] == owner[:-1], False)
        sums[:-1][same] += sums[1:][same]  # a window is a block and the next; going up, the next is not yet a window
        norm = np.linalg.norm(sums[:-1], axis=1)
        for k, p in zip(*exact):  # the window that begins with the block of the first word holds all of a short one
            w = np.searchsorted(begins, k, "right") - 1
            item, c = self.items[p], float(sums[w] @ self.latent[p] / norm[w]) if norm[w] else 0.0
            own = out[owner[w]]
            own[item] = max(own.get(item, (c, 1.0, True)), (c, 1.0, True))
        some = np.flatnonzero(norm > 0)
        for k in range(0, len(some), 4096):
            own = some[k : k + 4096]
            cosine = (sums[own] / norm[own, None]) @ self.latent.T
            covered = cosine * norm[own, None] >= COVER * self.length
            for w, p in zip(*np.nonzero((cosine >= COSINE) & covered & self.drawn)):
                doc = owner[own[w]]
                begin = begins[own[w]]
                a, b = max(bounds[doc], begin - BLOCK), min(bounds[doc + 1], begin + 3 * BLOCK)
                share, answer = self.check(p, hashes[a:b].tolist())
                if share >= EXACT or (share >= LOOSE and answer):
                    item, c = self.items[p], float(cosine[w, p])
                    if (share, c) > out[doc].get(item, (0, 0, 0))[1::-1]:
                        out[doc][item] = (c, share, answer)
        return out


def finders(docs: DataFrame, benchmark: DataFrame) -> list[Finder]:
    """A finder for each part of the benchmark; empty if it has no words. Runs jobs."""
    rows = cut(passages(benchmark))
    parts = -(-rows.count() // PART)
    made = []
    for k in range(parts):
        part = cut(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k))
        listed = sorted((-1 if r.item_id is None else r.item_id, r.words) for r in part.collect())
        if not listed:
            continue
        lists = [np.array(w, np.int64).view(U64) for _, w in listed]
        vocabulary = np.unique(np.concatenate(lists))
        counts, blocks = block_counts(docs, vocabulary)
        share = (counts + 1) / (blocks + 2)
        weight = np.where(share <= COMMON, -np.log(np.minimum(share, 1)), 0.0)
        if not weight.any():
            weight = np.ones(len(vocabulary))
        made.append(Finder([i for i, _ in listed], lists, vocabulary, weight, svd(part, vocabulary, weight)))
    return made


def leaks(docs: DataFrame, found: list[Finder]) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found: a row for each document and item that leaks into it."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                text, ids = batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i).to_pylist()
                merged: list[dict] = [{} for _ in ids]
                for f in found:
                    for own, new in zip(merged, f.find(text)):
                        own.update(new)
                rows = [(d, item, *v) for d, own in zip(ids, merged) for item, v in sorted(own.items())]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                    names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, found: list[Finder]) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns as they are."""
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(at)):
                part, clean = batch.slice(i, j - i), np.ones(j - i, bool)
                for f in found:
                    clean &= [not own for own in f.find(part.column(at))]
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
