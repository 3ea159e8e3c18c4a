"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its 3- to 7-grams of UTF-8 bytes (with marks at its ends) and itself; each is a row of one hashed table
of embeddings, so a misspelling that training never saw shares most rows with the word it stems from. A *segment* of
``SEGMENT`` consecutive words is the average of its words' averages, and a linear softmax maps it to two classes. A text
scores as its most toxic segment: an average over a long text would drown a few words.

Embeddings and softmax are trained together by gradient steps on whole texts, whose logit is the soft maximum of their
segments'. Subwords of fewer than ``MIN_TEXTS`` texts are not learned. Training reads at most ``PER_CLASS`` labelled rows
of either label, all of their segments, and weighs a row by how many labelled rows it stands for, so that the balance of
the labels is that of the table at every size; scoring reads every word of every text. As the softmax is linear, the score of a subword is one number, so scoring
gathers from a table of scalars. Scoring is a map: nothing is shuffled.

lang, source, doc_id and labels are no inputs of a score. Null, empty and wordless texts score as a segment with no
words: by the bias alone. With no labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U64, Flat, chunks, flat, labelled_sample, mix, remainder, slice_hash, words

PER_CLASS = 2500
SEGMENT = 16
#: Texts that a subword must be in before training moves it.
MIN_TEXTS = 5
#: Of the averages, which are small; and the pull of embeddings to zero.
SCALE, DECAY = 20.0, 1e-6
#: For the start of the embeddings.
CHANCE, GAIN = 5.0, 0.5
BUCKETS, DIM = 1 << 19, 8
#: Distinct words whose subwords are listed at once, and about how many subwords of training texts.
WORDS, LISTED = 1 << 14, 1 << 21
THRESHOLD = 0.7


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword, and how many each word has; a word's subwords lie together. Taken in blocks of words."""
    parts = [_subwords(data, starts[i : i + WORDS], ends[i : i + WORDS]) for i in range(0, max(1, len(starts)), WORDS)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(starts)
    length = ends - starts + 2
    first = np.cumsum(length) - length
    owner = np.repeat(np.arange(n), length)
    place = np.arange(len(owner)) - first[owner]
    marked = data[np.clip(starts[owner] + place - 1, 0, max(0, len(data) - 1))].astype(U64) + U64(2)
    marked[first] = 0
    marked[first + length - 1] = 1
    left = length[owner] - place
    found, who, rolled = [mix(slice_hash(data, starts, ends))], [np.arange(n)], marked.copy()
    for size in range(2, 8):
        rolled[: len(rolled) - size + 1] = rolled[: len(rolled) - size + 1] * U64(259) + marked[size - 1 :]
        if size > 2:
            at = np.flatnonzero(left >= size)
            found.append(mix(rolled[at] + U64(size * 0x9E3779B97F4A7C15 % 2**64)))
            who.append(owner[at])
    who = np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return (np.concatenate(found)[order] % U64(BUCKETS)).astype(np.int32), np.bincount(who, minlength=n)


def split(column: pa.Array):
    """Words of a lowered column, distinct words, and segments: bounds of each text's segments and first word of each."""
    raw, offsets = flat(column)
    text = Flat(LOWER[raw], offsets)
    starts, ends, bounds = words(text, ALNUM)
    per = -(-np.diff(bounds) // SEGMENT)
    seg_bounds = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(per)), per)
    begins = bounds[:-1][owner] + (np.arange(len(owner)) - seg_bounds[:-1][owner]) * SEGMENT
    return text, starts, ends, seg_bounds, begins


class Model:
    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table, out, bias

    def scalars(self) -> Scorer:
        return Scorer(SCALE * (self.table @ (self.out[:, 1] - self.out[:, 0])), float(self.bias[1] - self.bias[0]))


class Scorer:
    """The model as one number for a subword."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def score(self, column: pa.Array) -> np.ndarray:
        text, starts, ends, seg_bounds, begins = split(column)
        best = np.full(len(seg_bounds) - 1, self.bias)
        if len(starts):
            _, at, back = np.unique(slice_hash(text.data, starts, ends), return_index=True, return_inverse=True)
            order = np.argsort(at)  # distinct words in the order of their places
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at))
            bucket, count = subwords(text.data, starts[at[order]], ends[at[order]])
            each = np.add.reduceat(self.weight[bucket], np.cumsum(count) - count, dtype=np.float64) / count
            word = each[rank[back]]
            size = np.diff(np.append(begins, len(starts)))
            segment = np.add.reduceat(word, begins) / size + self.bias
            some = np.flatnonzero(np.diff(seg_bounds))
            best[some] = np.maximum.reduceat(segment, seg_bounds[:-1][some])
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def fit(rows: list[tuple[int, list[str]]], sizes: dict[int, int] | None = None, epochs: int = 5, rate: float = 0.06) -> Model:
    """``rows``: label and segments of a text. ``sizes``: labelled rows of either label, for the weight of a row."""
    rng = np.random.default_rng(5)
    table = np.zeros((BUCKETS, DIM), np.float32)  # a subword that training never saw says nothing
    model = Model(table, np.zeros((DIM, 2), np.float32), np.zeros(2))
    own = {k: sum(r[0] == k for r in rows) for k in (0, 1)}
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0], r[1]))
    if not rows:
        return model
    each = {k: (sizes or own).get(k, own[k]) / max(1, own[k]) for k in (0, 1)}
    weight = np.array([each[r[0]] for r in rows])
    weight /= weight.mean()
    model.out[:] = np.array([[-0.5, 0.5]]) * rng.choice([-1, 1], (DIM, 1))
    model.bias[:] = 1, -1
    segments = [s for _, own in rows for s in own]
    per_doc = np.array([len(own) for _, own in rows])
    doc = np.repeat(np.arange(len(rows)), per_doc)
    label = np.array([r[0] for r in rows])
    text, starts, ends, _, _ = split(pa.array(segments, pa.string()))
    _, at, back = np.unique(slice_hash(text.data, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(at)
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    word = rank[back]
    bucket, count = subwords(text.data, starts[at[order]], ends[at[order]])
    place = np.cumsum(count) - count
    bounds = np.searchsorted(starts, np.append(0, np.cumsum([len(s.encode()) for s in segments])))
    first = np.cumsum(per_doc) - per_doc

    def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        stop = np.cumsum(size)
        return np.repeat(begin - (stop - size), size) + np.arange(stop[-1])

    # a subword of few texts would be learned by heart
    pair = np.unique(np.repeat(doc, np.diff(bounds)) * len(count) + word)
    own_word, own_doc = pair % len(count), pair // len(count)
    texts, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    listed = np.cumsum(np.bincount(own_doc, count[own_word], len(rows)).astype(np.int64))
    edges = np.searchsorted(own_doc, np.concatenate([[0], np.flatnonzero(np.diff(listed // LISTED)) + 1, [len(rows)]]))
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            n, w = count[own_word[a:b]], own_word[a:b]
            known = np.unique(np.repeat(own_doc[a:b], n) * BUCKETS + bucket[ranges(place[w], n)])
            texts += np.bincount(known % BUCKETS, minlength=BUCKETS)
            toxic += np.bincount(known % BUCKETS, label[known // BUCKETS], BUCKETS)
    common, mean = texts >= MIN_TEXTS, label.mean()
    # the start: how many deviations a subword's toxic texts lie over what chance gives it, beyond CHANCE of them
    over = np.where(common, (toxic - texts * mean) / np.sqrt(np.maximum(texts, 1) * mean * (1 - mean) + 1e-9), 0)
    start = GAIN * np.clip(over - CHANCE, 0, 20) / DIM
    model.table[:] = start[:, None] * np.sign(model.out[:, 1])
    seen, g_out, g_bias = np.full((BUCKETS, DIM), 1e-10, np.float32), np.full((DIM, 2), 1e-2), np.full(2, 1e-2)
    for _ in range(epochs):
        turn = rng.permutation(len(rows))
        for k in range(0, len(turn), 64):
            docs = turn[k : k + 64]
            some = ranges(first[docs], per_doc[docs])
            size = np.diff(bounds)[some]
            owner = np.repeat(np.arange(len(docs)), per_doc[docs])
            some, owner, size = some[size > 0], owner[size > 0], size[size > 0]
            if not len(some):
                continue
            own, where = np.unique(word[ranges(bounds[some], size)], return_inverse=True)
            n = count[own]
            grams = bucket[ranges(place[own], n)]
            vectors = np.add.reduceat(model.table[grams], np.cumsum(n) - n, axis=0) / n[:, None]
            hidden = np.add.reduceat(vectors[where], np.cumsum(size) - size, axis=0) / size[:, None]
            logit = SCALE * (hidden @ (model.out[:, 1] - model.out[:, 0])) + model.bias[1] - model.bias[0]
            # a text's logit is the soft maximum of its segments'
            top = np.full(len(docs), -np.inf)
            np.maximum.at(top, owner, logit)
            share = np.exp(logit - top[owner])
            total = np.bincount(owner, share, len(docs))
            whole = top + np.log(np.maximum(total, 1e-30))
            error = (1 / (1 + np.exp(-np.clip(whole, -30, 30))) - label[docs]) * weight[docs]
            each = (error / len(docs))[owner] * share / total[owner]
            step = np.stack([-each, each], 1)  # by class, as of a softmax of two
            d_out, d_bias, d_hidden = SCALE * hidden.T @ step, step.sum(0), SCALE * step @ model.out.T / size[:, None]
            spread = np.repeat(d_hidden, size, axis=0)
            d_word = np.stack([np.bincount(where, spread[:, f], len(n)) for f in range(DIM)], 1) / n[:, None]
            moved = np.repeat(d_word, n, axis=0)
            at_, into = np.unique(grams, return_inverse=True)
            d_table = np.stack([np.bincount(into, moved[:, f]) for f in range(DIM)], 1) + DECAY * model.table[at_]
            d_table[~common[at_]] = 0
            seen[at_] += d_table**2
            g_out += d_out**2
            g_bias += d_bias**2
            model.table[at_] -= rate * d_table / np.sqrt(seen[at_])
            model.out -= rate * d_out / np.sqrt(g_out)
            model.bias -= 10 * rate * d_bias / np.sqrt(g_bias)
    return model


def in_training(doc_id: Column) -> Column:
    return remainder(doc_id, 3) != 1


def train(docs: DataFrame, labels: DataFrame, keep: Callable[[Column], Column] = in_training, per_class: int = PER_CLASS) -> Model:
    """Runs jobs."""
    sample, sizes = labelled_sample(docs, labels, "toxic", keep, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(0)):
                text, starts, ends, seg_bounds, begins = split(batch.column(0).slice(i, j - i))
                last = np.append(begins[1:], len(starts)) - 1
                raw, out = text.data.tobytes(), []
                for a, b in zip(seg_bounds[:-1], seg_bounds[1:]):
                    out.append([raw[starts[begins[k]] : ends[last[k]]].decode("utf-8", "replace") for k in range(a, b)])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(out, pa.list_(pa.string()))], ["label", "segments"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        model = fit(rows, sizes)
        arrays = [pa.array([np.ascontiguousarray(a).tobytes()]) for a in (model.table, model.out, model.bias)]
        yield pa.RecordBatch.from_arrays(arrays, ["table", "out", "bias"])

    # the bounded sample is fitted in a task, which a lost executor only repeats; the driver gets the model alone
    segments = sample.mapInArrow(run, "label int, segments array<string>").coalesce(1)
    got = segments.mapInArrow(learn, "table binary, out binary, bias binary").first()
    if got is None:  # no task runs on a table without partitions
        return fit([])
    table, out = (np.frombuffer(b, np.float32).reshape(-1, n) for b, n in ((got.table, DIM), (got.out, 2)))
    return Model(table, out, np.frombuffer(got.bias, np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row."""
    scorer = model.scalars()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                scores = scorer.score(batch.column(1).slice(i, j - i))
                out = [batch.column(0).slice(i, j - i), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")
