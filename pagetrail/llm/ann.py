"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is trained on a bounded sample (``SAMPLE`` vectors of lowest hash of their id): every node is split by k-means
into ``BRANCH`` children until a leaf stands for ``LEAF`` vectors of the whole table. Every vector is put into the leaf it
reaches by the nearest child at each level. A query walks the tree through a priority queue: the node of least distance
is opened, its children are queued, leaves come out in order. How many leaves a query visits is calibrated: on sample
queries against brute force over the sample it widens until ``RECALL`` of the neighbours lie in visited leaves.
The visits are made in rounds, ``FIRST`` leaves and then up to ``WIDEN`` times as many: the k-th distance that a query has
after a round bounds what the next may send, so rows sent grow with the rounds and not with the leaves visited.

Equal vectors are one *point* that carries its smallest ``k + 1`` ids: ties go to the smaller id, so a query needs no
more of them, and a vector that very many rows share is compared once. Points of a leaf are dealt to cells of about
``CELL`` points, and each visited (query, leaf) goes to all cells of it; a cell's task measures in double precision,
in blocks, and sends at most k rows for a query, none farther than the query's bound.

Vectors null, zero, or with null or non-finite components take no part; nor do those whose length is not the most common
one. Null ids take no part. Rows that repeat an id and its vector count once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE, BRANCH, LEAF, CELL = 20_000, 8, 100, 2000
RECALL, TEST_QUERIES = 0.98, 100
FIRST, WIDEN = 16, 64
OUT = "query_id long, vec_id long, score double"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _squares(x, centres).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, f], k) for f in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres, _squares(x, centres).argmin(1)


class Tree:
    """children[i]: node numbers, empty for a leaf; centres[i]: its centre. Node 0 is the root."""

    def __init__(self):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.visits = 1

    @classmethod
    def grow(cls, x: np.ndarray, leaf: float) -> Tree:
        """Splits until a leaf has at most ``leaf`` sample vectors."""
        tree, rng = cls(), np.random.default_rng(1)
        tree.add(x.mean(0))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            k = min(BRANCH, len(own) // 2)
            if len(own) <= max(leaf, 2) or k < 2:
                continue
            centres, part = k_means(x[own], k, rng)
            groups = [(c, own[part == i]) for i, c in enumerate(centres) if (part == i).any()]
            if len(groups) < 2:
                continue
            for centre, members in groups:
                child = tree.add(centre)
                tree.children[node].append(child)
                todo.append((child, members))
        return tree

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        return len(self.centres) - 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        node = np.zeros(len(x), np.int64)
        open_ = [0]
        while open_:
            at = open_.pop()
            kids = self.children[at]
            own = np.flatnonzero(node == at)
            if kids and len(own):
                node[own] = np.array(kids)[_squares(x[own], np.stack([self.centres[k] for k in kids])).argmin(1)]
                open_ += kids
        return node

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield node
                continue
            for d, k in zip(((np.stack([self.centres[k] for k in kids]) - q) ** 2).sum(1).tolist(), kids):
                heapq.heappush(queue, (d, k))

    def visited(self, q: np.ndarray, start: int, stop: int) -> list[int]:
        """Leaves ``start`` to ``stop`` of the walk."""
        return list(itertools.islice(self.walk(q), start, stop))

    def rounds(self) -> list[tuple[int, int]]:
        """Ranges of the walk that are visited together."""
        edges = [0, min(FIRST, self.visits)]
        while edges[-1] < self.visits:
            edges.append(min(edges[-1] * WIDEN, self.visits))
        return list(zip(edges, edges[1:]))

    def calibrate(self, x: np.ndarray, k: int, recall: float = RECALL) -> None:
        """Least number of leaves that holds ``recall`` of the k nearest sample vectors of sample queries."""
        leaf = self.place(x)
        step = max(1, len(x) // TEST_QUERIES)
        need = []
        for i in range(0, len(x), step):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            near = leaf[np.argsort(d, kind="stable")[: min(k, len(x) - 1)]]
            order = {n: r for r, n in enumerate(self.walk(x[i]), 1)}
            need += [order[n] for n in near.tolist()]
        need.sort()
        # the whole table is denser than the sample, so its neighbours lie nearer: this is the careful side
        self.visits = need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def points(vectors: DataFrame, k: int) -> DataFrame:
    """vec (array of doubles), ids (the k + 1 smallest, ascending) of the distinct vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & good & F.exists("vec", lambda v: v != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vec") == (lengths[0].n if lengths else 0)).withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)  # Spark keeps k + 1 in every task
    return few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``. Runs jobs."""
    spark = vectors.sparkSession
    table = cut(points(vectors, k))
    total = table.count()
    key = F.xxhash64(F.element_at("ids", 1))
    sample = [r.vec for r in table.orderBy(key, F.element_at("ids", 1)).limit(SAMPLE).select("vec").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array(sample)
    tree = Tree.grow(x, LEAF * len(x) / total)
    tree.calibrate(x, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.place(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], ["vec", "ids", "leaf"])

    placed = cut(table.select("vec", "ids").mapInArrow(place, "vec array<double>, ids array<long>, leaf long"))
    # a row for each leaf of the tree, which the sample bounds
    cells = {r.leaf: -(-r["count"] // CELL) for r in placed.groupBy("leaf").count().collect()}

    def dealer(start: int, stop: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    walked = tree.visited(np.array(batch.column(1)[i].as_py()), start, stop)
                    leaves = [(leaf, c) for leaf in walked for c in range(cells.get(leaf, 0))]
                    if leaves:
                        same = pa.array([i] * len(leaves))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([a for a, _ in leaves], pa.int64()),
                                pa.array([c for _, c in leaves], pa.int32()),
                                *[column.take(same) for column in batch.columns],
                            ],
                            ["leaf", "cell", "query_id", "vec", "bound"],
                        )

        return deal

    # queries by row of the input: a point keeps few ids, its queries may be many
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), vec.alias("vec")).distinct()
    asked = cut(asked.join(table.select("vec"), "vec", "left_semi").select("query_id", "vec"))
    sizes = F.create_map(*[F.lit(v) for pair in cells.items() for v in pair])
    cell = F.pmod(F.xxhash64(F.element_at("ids", 1)), sizes[F.col("leaf")]).cast("int")
    homed = placed.select("leaf", cell.alias("cell"), "vec", "ids")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        names, found = ["query_id", "vec_id", "score"], []
        if left.num_rows and right.num_rows:
            have, ids = _matrix(left.column("vec").combine_chunks()), left.column("ids").to_pylist()
            want, asking = _matrix(right.column("vec").combine_chunks()), right.column("query_id").to_pylist()
            bound = right.column("bound").to_numpy()
            count = min(k + 1, len(have))
            for a in range(0, len(want), 256):
                rough = _squares(want[a : a + 256], have)
                limit = np.partition(rough, count - 1, axis=1)[:, count - 1]
                limit = np.minimum(limit, bound[a : a + 256] ** 2)
                limit = limit * (1 + 1e-9) + 1e-12 * (want[a : a + 256] ** 2).sum(1)  # rounding may not lose a tie
                for i, row in enumerate(rough):
                    near = np.flatnonzero(row <= limit[i])
                    exact = np.sqrt(((have[near] - want[a + i]) ** 2).sum(1)).tolist()
                    own = sorted((d, v) for d, p in zip(exact, near.tolist()) for v in ids[p] if v != asking[a + i] and d <= bound[a + i])[:k]
                    found += [(asking[a + i], v, d) for d, v in own]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names)

    best, ranked = Window.partitionBy("query_id").orderBy("score", "vec_id"), None
    for start, stop in tree.rounds():
        if ranked is None:
            bounded = asked.withColumn("bound", F.lit(float("inf")))
        else:
            kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
            bounded = asked.join(kth, "query_id", "left").select("query_id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        dealt = bounded.mapInArrow(dealer(start, stop), "leaf long, cell int, query_id long, vec array<double>, bound double")
        found = homed.groupBy("leaf", "cell").cogroup(dealt.groupBy("leaf", "cell")).applyInArrow(measure, OUT)
        found = found if ranked is None else found.unionByName(ranked.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if stop < tree.visits:
            ranked = cut(ranked)
    return ranked.select("query_id", "rank", "vec_id", "score")
