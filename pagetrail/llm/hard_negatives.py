"""Hard negatives by Kronecker-packed integer products.

Components are scaled to integers. In a block, the components of several candidates are biased to be non-negative and put
side by side into fields of one wide integer, so that one multiplication by an anchor's component multiplies them all; the
sum over components then holds every candidate's product in its own field, exactly. Fields are as wide as the block's
largest possible product needs. While two or more fields, or one, fit the 53 bits that a double holds exactly, the wide
integers are doubles and the products a matrix product; beyond that they are Python integers of 16 fields.

Anchors are the rows whose vec_id is divisible by ``every``. All rows are dealt by hash into shards, anchors into parts, and
each (shard, part) is a group of bounded size: every anchor meets every row once in each of two passes. The first finds an
anchor's positives, the second, with their scores known, the negatives below them. A group returns a few rows for each
anchor, so a frequent label or vector makes no group larger.

Rows with a null vec_id, label or vector, or a null or non-finite (scaled) component, take no part. vec_id is the key: rows
that agree in it count once, and where they disagree, the one of smallest label, then smallest vector, counts. Shorter
vectors go on as zeros. Equal scores are ordered by vec_id. An empty table gives no rows, other columns are not read. A
score that does not fit a long raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Expected rows of a shard and anchors of a part.
ROWS, ANCHORS = 32768, 8192
#: Anchors multiplied at once.
TILE = 128
#: Bits of integers that a double holds exactly, and fields of a wide integer beyond that.
EXACT, WIDE = 53, 16


class Fields:
    """Candidates (rows of integers, as doubles) packed for products with anchors whose absolute components sum to at
    most ``reach``."""

    def __init__(self, rows: np.ndarray, reach: float):
        n, d = rows.shape
        low = min(0, int(rows.min(initial=0)))
        self.n, self.bias = n, -low
        #: no field's product lies beyond this on either side
        self.bound = int(reach) * (int(rows.max(initial=0)) + self.bias)
        self.width = (2 * self.bound + 1).bit_length()
        fits = self.width <= EXACT
        self.per = EXACT // self.width if fits else WIDE
        self.kind = np.float64 if fits else object
        self.size = -(-n // self.per)
        biased = np.zeros((self.size * self.per, d), self.kind)
        biased[:n] = self.integers(rows) + self.bias
        self.words = sum(biased[i * self.size : (i + 1) * self.size] * (1 << self.width * i) for i in range(self.per)).T

    def integers(self, x: np.ndarray) -> np.ndarray:
        if self.kind is np.float64:
            return x
        return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of all anchors with all candidates."""
        own = self.integers(anchors)
        # a constant in every field makes what was multiplied non-negative, so that fields do not borrow from each other
        total = own.dot(self.words) + sum(self.bound << self.width * i for i in range(self.per))
        total = total.astype(np.int64) if self.kind is np.float64 else total
        mask, shift = (1 << self.width) - 1, self.bias * own.sum(1) + self.bound
        shift = (shift.astype(np.int64) if self.kind is np.float64 else shift)[:, None]
        return np.concatenate([(total >> self.width * i & mask) - shift for i in range(self.per)], axis=1)[:, : self.n]


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, largest first, ties by position."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, continued by zeros up to ``width``."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _tiles(rows: pa.Table, anchors: pa.Table):
    """(positions of anchors, their scores with all of ``rows``) for groups of anchors."""
    width = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (rows.column("vec"), anchors.column("anchor_vec")))
    want = _matrix(anchors.column("anchor_vec"), width)
    packed = Fields(_matrix(rows.column("vec"), width), float(np.abs(want).sum(1).max(initial=0)))
    for k in range(0, len(want), TILE):
        at = np.arange(k, min(k + TILE, len(want)))
        yield at, packed.products(want[at])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, vec (integers as doubles) of the rows that take part."""
    # a double of 2^52 or more is an integer already
    whole = lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * F.lit(float(scale)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("vec"))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & good)
    rows = rows.select("vec_id", "label", F.transform("vec", whole).alias("vec"))
    one = F.min(F.struct("label", "vec")).alias("row")
    return rows.groupBy("vec_id").agg(one).select("vec_id", "row.label", "row.vec")


def mine(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors`` (vec_id, embedding, label).

    An anchor's positives are the ``positives`` rows of its label with the largest integer products, itself left out. A
    negative is a row of another label whose score is ``low`` to ``high`` percent of the positive's; the ``negatives``
    largest of them are given for each anchor and positive. Runs jobs.
    """
    table = cut(usable(vectors, scale))
    # under names of their own, since both sides of a group come from one table
    own = F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vec").alias("anchor_vec")
    asked = table.where(F.col("vec_id") % every == 0).select(*own)
    n, n_asked = table.count(), asked.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // ROWS), min(4 * cores, n // 1024))
    parts = max(1, -(-n_asked // ANCHORS))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")
    part = F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(parts)).alias("asking")
    counted = lambda size, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name)
    rows = table.select("*", shard, counted(parts, "part"))

    def passed(anchors: DataFrame, work, schema: str) -> DataFrame:
        dealt = anchors.select("*", part, counted(shards, "asked"))
        return rows.groupBy("shard", "part").cogroup(dealt.groupBy("asked", "asking")).applyInArrow(work, schema)

    names = ["anchor_id", "positive_score", "vec_id", "score"]
    schema = "anchor_id long, positive_score long, vec_id long, score long"

    def output(found: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 4)], names)

    def find_positives(own: pa.Table, anchors: pa.Table) -> pa.Table:
        if not own.num_rows or not anchors.num_rows:
            return output([])
        own, found = own.sort_by("vec_id"), []
        labels, asking = _column(own, "label"), _column(anchors, "anchor_label")
        for label in np.unique(asking).tolist():
            mates, some = own.filter(labels == label), anchors.filter(asking == label)
            ids, names_of = _column(mates, "vec_id"), _column(some, "anchor_id")
            if len(ids):
                for at, scores in _tiles(mates, some):
                    for i, row in zip(at.tolist(), scores):
                        best = first(row, positives + 1)
                        best = best[ids[best] != names_of[i]][:positives]
                        found += [(int(names_of[i]), None, int(ids[p]), int(row[p])) for p in best]
        return output(found)

    def find_negatives(own: pa.Table, anchors: pa.Table) -> pa.Table:
        if not own.num_rows or not anchors.num_rows:
            return output([])
        own, found = own.sort_by("vec_id"), []
        ids, labels = _column(own, "vec_id"), _column(own, "label")
        asking, names_of, wanted = _column(anchors, "anchor_label"), _column(anchors, "anchor_id"), anchors.column("wanted").to_pylist()
        for at, scores in _tiles(own, anchors):
            for i, row in zip(at.tolist(), scores):
                windows = [(p, -(-low * p // 100), high * p // 100) for p in wanted[i]]
                lowest, highest = min(w[1] for w in windows), max(w[2] for w in windows)
                near = np.flatnonzero((row >= lowest) & (row <= highest) & (labels != asking[i]))
                values = row[near]
                for score, least, most in windows:
                    inside = near[(values >= least) & (values <= most)]
                    found += [(int(names_of[i]), score, int(ids[p]), int(row[p])) for p in inside[first(row[inside], negatives)]]
        return output(found)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    pairs = passed(asked, find_positives, schema).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pairs = cut(pairs.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = pairs.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("wanted"))
    below = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    chosen = passed(asked.join(wanted, "anchor_id"), find_negatives, schema)
    chosen = chosen.withColumn("rank", F.row_number().over(below)).where(F.col("rank") <= negatives)
    joined = pairs.join(chosen, ["anchor_id", "positive_score"])
    return joined.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
