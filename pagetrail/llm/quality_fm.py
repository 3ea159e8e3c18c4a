"""Quality classifier: a factorisation machine over hashed words, statistics of structure, and the length.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): pairwise interactions of all
features in time linear in their number. Features are the distinct words of the text (hashed; together of length one)
and one bin for each statistic: shares of capitals, digits, symbols, bars, of words that repeat the word before, of
distinct words and of distinct word triples, of words that end in symbols, lengths of words and lines, and the
number of words and bytes (the metadata). Neither lang, source, doc_id nor a label is an input of a score.

Training reads at most ``PER_CLASS`` labelled rows of either label, in numpy on the driver; what comes there is bounded
by the number of buckets for each row. Scoring is a map over the texts: nothing is shuffled.
Null and empty texts have statistics of zero and are scored as any other. With no labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Flat, chunks, flat, labelled_sample, mix, remainder, slice_hash, words

#: Labelled rows of either label that training may read.
PER_CLASS = 4000
BUCKETS = 1 << 16
FACTORS = 8
THRESHOLD = 0.3
STATS = 14
_BINS = 32
SIZE = BUCKETS + STATS * _BINS

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SYMBOL[[ord(c) for c in ".,'-"]] = False


def _total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each owner."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts end to end, and the offset of each text."""
    raw, offsets = flat(column)
    n = len(offsets) - 1
    starts, ends, bounds = words(Flat(raw, offsets))
    low = LOWER[raw]
    hashes = slice_hash(low, starts, ends)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1)
    capital, small = (raw >= 0x41) & (raw <= 0x5A), (raw >= 0x61) & (raw <= 0x7A)
    letters = np.maximum(_total(capital | small, offsets), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    triple = hashes[:-2] + hashes[1:-1] * U64(3) + hashes[2:] * U64(5) if len(hashes) > 2 else np.empty(0, U64)
    inside = owner[:-2] == owner[2:] if len(hashes) > 2 else np.empty(0, bool)
    triples = np.maximum(count - 2, 1)
    n_triples = _distinct(triple[inside], owner[:-2][inside], n) if len(triple) else np.zeros(n, np.int64)
    lines = _total(raw == 0x0A, offsets) + 1
    longest = np.zeros(n)
    if len(starts):
        np.maximum.at(longest, owner, ends - starts)
    shares = [
        _total(capital, offsets) / letters,
        _total((raw >= 0x30) & (raw <= 0x39), offsets) / size,
        _total(_SYMBOL[raw], offsets) / size,
        _total(raw == 0x7C, offsets) / size,
        _total(same, bounds) / some,
        _distinct(hashes, owner, n) / some,
        np.where(count > 2, n_triples / triples, 1),
        _total(_SYMBOL[raw[ends - 1]], bounds) / some if len(starts) else np.zeros(n),
        letters / size,
    ]
    logs = [_total(ends - starts, bounds) / some, longest, size / lines, count, np.diff(offsets)]
    binned = [np.sqrt(np.clip(s, 0, 1)) * (_BINS - 1) for s in shares] + [1.5 * np.log2(1 + x) for x in logs]
    stat = np.clip(np.stack(binned, 1), 0, _BINS - 1).astype(np.int64) + np.arange(STATS) * _BINS + BUCKETS
    key = np.unique(owner * BUCKETS + (mix(hashes) % U64(BUCKETS)).astype(np.int64))
    word_owner = key // BUCKETS
    n_word = np.bincount(word_owner, minlength=n)
    value = (1 / np.sqrt(np.maximum(n_word, 1)))[word_owner]
    all_owner = np.concatenate([word_owner, np.repeat(np.arange(n), STATS)])
    order = np.argsort(all_owner, kind="stable")
    number = np.concatenate([key % BUCKETS, stat.reshape(-1)])[order]
    values = np.concatenate([value, np.full(n * STATS, 0.5)])[order]
    return number, values.astype(np.float32), np.concatenate([[0], np.cumsum(n_word + STATS)])


class Machine:
    """Parameters of the machine; ``v`` has a row for each feature."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def parts(self, number, value, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = value[:, None] * self.v[number]
        at = offsets[:-1]  # no text is without features: the statistics are always there
        sums = np.add.reduceat(x, at, axis=0)
        squares = np.add.reduceat(x * x, at, axis=0)
        linear = np.add.reduceat(value * self.w[number], at)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1), sums, x

    def score(self, column: pa.Array) -> np.ndarray:
        number, value, offsets = features(column)
        return 1 / (1 + np.exp(-np.clip(self.parts(number, value, offsets)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], sizes: dict[int, int], epochs: int = 12, rate: float = 0.1) -> Machine:
    """``rows``: label, feature numbers, values. ``sizes``: labelled rows of either label, for the weight of a row."""
    rng = np.random.default_rng(11)
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.01, (SIZE, FACTORS)).astype(np.float32))
    if not rows:
        machine.v[:] = 0
        return machine
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    own = {k: sum(r[0] == k for r in rows) for k in (0, 1)}
    weight = {k: sizes.get(k, own[k]) / max(1, own[k]) for k in (0, 1)}
    mean = sum(weight[r[0]] for r in rows) / len(rows)
    grad_w, grad_v, grad_b = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            batch = [rows[i] for i in order[k : k + 64]]
            offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in batch])])
            number, value = np.concatenate([r[1] for r in batch]), np.concatenate([r[2] for r in batch])
            logit, sums, x = machine.parts(number, value, offsets)
            label = np.array([r[0] for r in batch])
            error = (1 / (1 + np.exp(-logit)) - label) * np.array([weight[r[0]] / mean for r in batch]) / len(batch)
            each = np.repeat(error, np.diff(offsets))
            into = np.unique(number, return_inverse=True)
            d_w = np.bincount(into[1], each * value)
            around = np.repeat(sums, np.diff(offsets), axis=0) - x
            d_v = np.stack([np.bincount(into[1], each * value * around[:, f]) for f in range(FACTORS)], 1)
            at = into[0]
            d_w, d_v = d_w + 1e-6 * machine.w[at], d_v + 1e-5 * machine.v[at]
            grad_w[at] += d_w**2
            grad_v[at] += d_v**2
            grad_b += float(error.sum()) ** 2
            machine.w[at] -= rate * d_w / np.sqrt(grad_w[at])
            machine.v[at] -= 0.3 * rate * d_v / np.sqrt(grad_v[at])
            machine.bias -= rate * float(error.sum()) / np.sqrt(grad_b)
    return machine


def in_training(doc_id: Column) -> Column:
    return remainder(doc_id, 5) != 0


def train(docs: DataFrame, labels: DataFrame, keep: Callable[[Column], Column] = in_training, per_class: int = PER_CLASS) -> Machine:
    """Runs jobs."""
    sample, sizes = labelled_sample(docs, labels, "quality", keep, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(0)):
                number, value, offsets = features(batch.column(0).slice(i, j - i))
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(number, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value))],
                    ["label", "number", "value"],
                )

    rows = sample.mapInArrow(run, "label int, number array<int>, value array<float>").toArrow()
    listed = zip(rows["label"].to_pylist(), rows["number"], rows["value"])
    return fit([(y, a.values.to_numpy().astype(np.int64), b.values.to_numpy()) for y, a, b in listed], sizes)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                scores = machine.score(batch.column(1).slice(i, j - i))
                out = [batch.column(0).slice(i, j - i), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(at)):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(machine.score(part.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
