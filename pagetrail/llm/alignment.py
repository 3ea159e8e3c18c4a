"""Alignment of two tokenizers' tokens over a corpus.

A text is encoded by a byte-level BPE file (A, after a space) and by a sentencepiece model (B). Where a token of A and one
of B end at the same byte they are linked, and such offsets cut both into groups. An id pair's count is how many links of
the whole corpus hold it.

Texts are shuffled by full text, so that each distinct one is tokenised and aligned once, in blocks of a few MB; what it
holds counts as often as the text stands in the corpus. A block keeps its distinct pairs once, and each of its texts the
places of its own pairs among them. Pair counts are summed over blocks, joined back to the pairs of each block, and each
text's measures are computed within its block; then they are joined to the rows of ``docs`` by the text's SHA-256. Texts of
more than a thousandth of all rows, so fewer than a thousand texts, are joined by broadcast, as their rows would meet in
one task.

Texts that are null or empty, or that one of the two encodes to other bytes than those of the space and the text, have no
tokens: their measures are 0 and their hash is empty. Rows with the same doc_id, or none, each get their measures; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut
from .vocabulary import TokenBytes, byte_level, pieces

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 8 << 20
#: A text that more than one in so many rows hold is joined by broadcast; there are fewer such texts than this.
HOT = 1000

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Aligned:
    """The tokens of some texts, end to end, with what links them. ``a_at``, ``b_at`` and ``group_at`` bound the texts."""

    def __init__(self, texts: list[str], path_a: str, path_b: str):
        first, second = byte_level(path_a), pieces(path_b)
        spaced = [" " + t for t in texts]
        a = [first.encode(t, special=False).astype(np.int64) for t in spaced]
        b = [np.array(ids, np.int64) for ids in second.encode(texts)]
        source = [t.encode() for t in spaced]
        good = self._exact(a, source, first.bytes) & self._exact(b, source, second.bytes) & np.array([t != "" for t in texts], bool)
        none = np.empty(0, np.int64)
        a = [ids if ok else none for ids, ok in zip(a, good)]
        b = [ids if ok else none for ids, ok in zip(b, good)]
        self.a, self.b = (np.concatenate([none, *x]) for x in (a, b))
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum([len(x) for x in y], dtype=np.int64)]) for y in (a, b))
        # all texts here have the same bytes on both sides, so ends count on through them; no token is empty
        a_ends, b_ends = np.cumsum(first.bytes.lengths[self.a]), np.cumsum(second.bytes.lengths[self.b])
        self.ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_last, self.b_last = np.searchsorted(a_ends, self.ends), np.searchsorted(b_ends, self.ends)
        self.group_at = np.searchsorted(self.a_last, self.a_at)

    @staticmethod
    def _exact(ids: list[np.ndarray], source: list[bytes], tokens: TokenBytes) -> np.ndarray:
        """Whether each text's tokens are its bytes."""
        sizes = np.array([int(tokens.lengths[x].sum()) for x in ids], np.int64)
        same = sizes == np.array([len(s) for s in source], np.int64)
        flat = tokens.join(np.concatenate([np.empty(0, np.int64), *ids])).tobytes()
        ends = np.cumsum(sizes).tolist()
        return np.array([bool(ok) and flat[e - len(s) : e] == s for ok, e, s in zip(same, ends, source)], bool)

    def pairs(self) -> np.ndarray:
        """One number for each link: the id of A in the upper and that of B in the lower 32 bits."""
        return self.a[self.a_last] << 32 | self.b[self.b_last]

    def written(self) -> list[bytes]:
        """Each text's groups, as ``a1,a2|b1;a3|b2,b3``."""
        groups = len(self.ends)
        a_group, b_group = np.searchsorted(self.a_last, np.arange(len(self.a))), np.searchsorted(self.b_last, np.arange(len(self.b)))
        ids, marks = (np.empty(len(self.a) + len(self.b), t) for t in (np.int64, np.uint8))
        a_end, b_start = self.a_last + 1, np.concatenate([[0], self.b_last[: groups - 1] + 1]) if groups else np.empty(0, np.int64)
        a_place, b_place = np.arange(len(self.a)) + b_start[a_group], np.arange(len(self.b)) + a_end[b_group]
        ids[a_place], ids[b_place] = self.a, self.b
        marks[a_place], marks[b_place] = ord(","), ord(",")
        marks[a_place[self.a_last]], marks[b_place[self.b_last]] = ord("|"), ord(";")
        digits = np.char.mod("%d", np.arange(int(ids.max(initial=0)) + 1)).astype("S")
        width = digits.dtype.itemsize
        table, sizes = digits.view(np.uint8).reshape(len(digits), width), np.char.str_len(digits)
        text, size = np.empty((len(ids), width + 1), np.uint8), sizes[ids]
        text[:, :width] = table[ids]
        text[np.arange(len(ids)), size] = marks
        flat = text[np.arange(width + 1) <= size[:, None]].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size + 1)])[self.a_at + self.b_at].tolist()
        return [flat[i : j - 1] if j > i else b"" for i, j in zip(cuts, cuts[1:])]


def _small(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs; their count gives the width back."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


ALIGNED = (
    "block long, key binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_pairs long, gaps binary, times binary, pairs binary, totals binary"
)
NAMES = [f.split()[0] for f in ALIGNED.split(", ")]
TYPES = [
    pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.int64(), *[pa.binary()] * 4,
]


def align(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each of ``texts`` (text, n), which are distinct: its key, its counts, and its pairs as places in the
    block's list, which is on the block's first row together with how often, by ``n``, each pair stands in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, rows, lists = TaskContext.get().partitionId() << 32, 0, [], []

        def close() -> pa.RecordBatch:
            every, place = np.unique(np.concatenate(lists), return_inverse=True)
            starts = np.cumsum([0, *map(len, lists)]).tolist()
            totals, out = np.zeros(len(every), np.int64), []
            for head, k, own, times in rows:
                at = place[starts[k] : starts[k + 1]][own]
                totals[at] += head[1] * times
                out.append((block, *head, len(at), _small(np.diff(at, prepend=0)), _small(times), None, None))
            out[0] = (*out[0][:-2], every.astype("<i8").tobytes(), totals.astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

        for batch in batches:
            for i, j in chunks(batch.column(0)):
                some, counts = batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()
                found = Aligned(some, path_a, path_b)
                codes, inverse = np.unique(found.pairs(), return_inverse=True)
                groups = np.diff(found.group_at)
                of = np.repeat(np.arange(len(some)), groups) * max(1, len(codes)) + inverse
                held, times = np.unique(of, return_counts=True)
                bounds = np.searchsorted(held, np.arange(len(some) + 1) * max(1, len(codes))).tolist()
                held %= max(1, len(codes))
                written, n_a, n_b = found.written(), np.diff(found.a_at).tolist(), np.diff(found.b_at).tolist()
                for t, text in enumerate(some):
                    raw, own = text.encode(), slice(bounds[t], bounds[t + 1])
                    sha, links = hashlib.sha256(written[t]).hexdigest() if written[t] else "", int(groups[t])
                    head = (hashlib.sha256(raw).digest(), counts[t], n_a[t], n_b[t], links, links, sha)
                    rows.append((head, len(lists), held[own], times[own]))
                    size += len(raw)
                lists.append(codes)
                if size >= BLOCK_BYTES:
                    yield close()
                    block, size, rows, lists = block + 1, 0, [], []
        if rows:
            yield close()

    return texts.select("text", "n").mapInArrow(run, ALIGNED)


def block_pairs(aligned: DataFrame) -> DataFrame:
    """block, place, pair, n of every block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, totals in zip(*(c.to_pylist() for c in batch.columns)):
                codes, n = np.frombuffer(pairs, "<i8"), np.frombuffer(totals, "<i8")
                columns = np.full(len(codes), block), np.arange(len(codes), dtype=np.int32), codes, n
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "pair", "n"])

    lists = aligned.where(F.col("pairs").isNotNull()).select("block", "pairs", "totals")
    return lists.mapInArrow(run, "block long, place int, pair long, n long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count over all of the corpus, best: whether no pair with its id of B counts more. At most as many rows meet in
    a window as A has ids."""
    counts = block_pairs(aligned).groupBy("pair").agg(F.sum("n").alias("count"))
    own = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    return counts.withColumn("best", F.col("count") == F.max("count").over(own))


def ids_of(pairs: DataFrame) -> DataFrame:
    """``pair_counts`` with the two ids (a_id, b_id) as columns."""
    return pairs.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "count", "best")


def _measure(lists: pa.Table, texts: pa.Table) -> pa.Table:
    count, best = np.empty(0, np.int64), np.empty(0, bool)
    if lists.num_rows:  # no links in the block: an empty list, which has no columns here
        order = np.argsort(lists.column("place").to_numpy())
        count, best = lists.column("count").to_numpy()[order], lists.column("best").to_numpy()[order]
    most, total = [], []
    for n, gaps, times in zip(*(texts.column(c).to_pylist() for c in ("n_pairs", "gaps", "times"))):
        at, times = np.cumsum(_large(gaps, n)), _large(times, n)
        most.append(int(times[best[at]].sum()))
        total.append(int((times * count[at]).sum()))
    kept = texts.select(["key", "n", "n_a", "n_b", "n_groups", "n_links"])
    kept = kept.append_column("n_best", pa.array(most, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
    return kept.append_column("groups_sha256", texts.column("groups_sha256"))


def measure(aligned: DataFrame) -> DataFrame:
    """key, n, all measures and groups_sha256 of every aligned text."""
    lists = block_pairs(aligned).drop("n").join(pair_counts(aligned), "pair").select("block", "place", "count", "best")
    own = aligned.drop("pairs", "totals").groupBy("block")
    schema = "key binary, n long, " + "".join(f"{m} long, " for m in MEASURES) + "groups_sha256 string"
    return own.cogroup(lists.groupBy("block")).applyInArrow(lambda texts, found: _measure(found, texts), schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``. Runs jobs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = F.col("text").isNotNull() & (F.col("text") != "")
    found = cut(measure(cut(align(rows.where(full).groupBy("text").agg(F.count(F.lit(1)).alias("n")), path_a, path_b))))
    # null and empty texts need no join, and would all meet in one task
    keyed = cut(rows.select("doc_id", F.when(full, F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("key")))
    least = keyed.count() // HOT
    often, rest = found.where(F.col("n") > least).drop("n"), found.where(F.col("n") <= least).drop("n")
    known = keyed.where(F.col("key").isNotNull())
    hot = known.join(F.broadcast(often), "key")
    others = known.join(F.broadcast(often.select("key")), "key", "left_anti").join(rest, "key")
    empty = keyed.where(F.col("key").isNull())
    empty = empty.select("key", "doc_id", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups_sha256"))
    return hot.unionByName(others).unionByName(empty).drop("key")
