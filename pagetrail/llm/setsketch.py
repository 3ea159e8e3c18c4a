"""MinHash near-duplicates by SetSketch registers: band, estimate jointly by likelihood, verify on full sets.

1. One pass over the texts gives per document the set of its shingles in 64-bit hashes: size, a 128-bit identity of
   the whole set (equal sets are one *node*, so exact copies collapse before anything is paired) and ``M`` registers.
   A register is the minimum of exponential variables of the elements, kept on a logarithmic scale of base ``BASE``
   and truncated to one byte. Registers of a union are the maxima of registers.
2. ``BANDS`` bands of ``ROWS`` registers; two sets of similarity 0.8 share none with a chance of (1 - 0.8^4)^32, less
   than one in ten million.
3. A pair's counts of greater, smaller and equal registers and the two known sizes give the likelihood of the
   similarity; pairs whose maximum lies ``MARGIN`` (over five standard errors) under the threshold go no further. The
   members of a bucket are compared in the task that holds it, or block by block; only a spanning forest of its likely pairs
   leaves the task, so rows grow with the members of a bucket, not with its pairs. Forests join into *clusters*, and every
   likely pair lies within one.
4. A cluster's full sets meet once, each set in one block, and the exact intersections give a spanning forest of its links.
   So near misses are told from links where the sets are, and no pair of them becomes a row. A cluster of several blocks
   that is not one component then has its nodes outside the largest component compared with all of its blocks; rows
   there grow with nodes outside times blocks, as any exact answer has to look at these pairs.

Rows: one per input row. Null or blank texts have an empty set and are linked with nothing; their component is their
own id. Rows that share a doc_id take the smallest id of their component as any other row. A null doc_id takes part in
links; ``component_id`` ignores it unless the whole component has no id (then it is null and the row is kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Flat, chunks, cut, flat, mix, slice_hash, words

M, BANDS, ROWS = 128, 32, 4
BASE, TOP = 1.15, 255
MARGIN = 0.2
#: Members of a bucket that are compared in one task; larger buckets go in pairs of blocks.
BLOCK_ROWS = 8192
#: Pairs whose registers are compared at once.
PAIRS = 20_000
#: Shingles of a cluster that one task holds, or twice as many where blocks meet.
BLOCK_ITEMS = 1 << 19

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, M, dtype=np.uint64) * U64(2) + U64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, M, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes."""
    raw, offsets = flat(column)
    text = Flat(LOWER[raw], offsets)
    starts, ends, bounds = words(text)
    hashes = slice_hash(text.data, starts, ends)
    n = len(hashes) - size + 1
    rolled = np.zeros(max(0, n), U64)
    for k in range(size if n > 0 else 0):
        rolled += hashes[k : k + n] * _PLACES[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # the whole sequence is one shingle; its length tells it from a full one
            out.append(mix((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def minima(items: np.ndarray) -> np.ndarray:
    low = np.full(M, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(items), 512):
        values = _FACTORS[:, None] * items[None, k : k + 512]
        values += _ADDENDS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """Minima of uniform numbers -> exponential variables -> truncated logarithms."""
    u = np.clip((low.astype(np.float64) + 1) / 2.0**64, 2.0**-64, 1 - 2.0**-53)
    level = np.floor(13 - np.log(-np.log1p(-u)) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint8)


def identity(items: np.ndarray) -> bytes:
    first = mix(items).sum(dtype=U64)
    second = mix(items ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(items))
    return np.array([first, second], ">u8").tobytes()


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, node (null: empty set), n_shingles, regs of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(i, j - i), size)
                lows = [minima(s) if len(s) else None for s in sets]
                regs = iter(registers(np.array(some)) if (some := [x for x in lows if x is not None]) else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([identity(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if x is None else next(regs).tobytes() for x in lows], pa.binary()),
                    ],
                    ["doc_id", "node", "n_shingles", "regs"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node binary, n_shingles long, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), M)


def bands(nodes: DataFrame) -> DataFrame:
    """band, node: a row per node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1)).reshape(batch.num_rows, BANDS, ROWS).astype(U64)
                key = (rows << (U64(8) * np.arange(ROWS, dtype=U64))).sum(axis=2)
                key = mix(key + (np.arange(BANDS, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
                take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(take)], ["band", "node"]
                )

    return nodes.select("node", "regs").mapInArrow(run, "band long, node binary")


def likely(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood for pairs: counts of registers where a's is greater and b's is greater,
    and the sizes of both sets."""
    a = n_a / (n_a + n_b)
    b = 1 - a
    scale = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def gain(j):
        p, q = chance(a - b * j), chance(b - a * j)
        tiny = 1e-12
        return more * np.log(p + tiny) + less * np.log(q + tiny) + (M - more - less) * np.log(np.clip(1 - p - q, tiny, 1))

    low, high = np.zeros(len(a)), np.minimum(a / b, b / a)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(24):  # the likelihood is concave in the similarity
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        up = gain(left) < gain(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def passes(more, less, n_a, n_b, threshold: float) -> np.ndarray:
    n_a, n_b = np.asarray(n_a, np.float64), np.asarray(n_b, np.float64)
    sizes = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    out = np.zeros(len(n_a), bool)
    k = np.flatnonzero(sizes)
    out[k] = likely(more[k], less[k], n_a[k], n_b[k]) >= threshold - MARGIN
    return out


def grown(group: np.ndarray, test) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of each group's graph; ``group`` ascends, ``test`` tells of pairs of rows whether they are edges.

    In a round each group sends out one row that its forest has reached, or one of the others if none is left, and tests it
    with the rows not yet reached; so a group gives fewer edges than it has rows.
    """
    away, reached = np.arange(len(group)), np.empty(0, np.int64)
    heads, found = [], []
    while len(away):
        own, first = np.unique(group[away], return_index=True)
        head = away[first].copy()
        reached = reached[np.isin(group[reached], own)]
        known, at = np.unique(group[reached], return_index=True)
        place = np.searchsorted(own, known)
        head[place] = reached[at]
        rest = np.ones(len(away), bool)
        rest[np.delete(first, place)] = False
        away, reached = away[rest], np.delete(reached, at)
        x = head[np.searchsorted(own, group[away])]
        ok = test(x, away)
        heads.append(x[ok])
        found.append(away[ok])
        reached = np.concatenate([reached, away[ok]])
        reached, away = reached[np.argsort(group[reached], kind="stable")], away[~ok]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *heads]), np.concatenate([none, *found])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (runs of rows with equal ``keys``), and the number of each row's group."""
    held: list[pa.Table] = []
    for batch in _ended(batches):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column(k).to_numpy() for k in keys], 1)
            steps = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            other = bool(held) and any(held[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys)
            if not len(steps) and not other:
                held.append(table)
                continue
            last = int(steps[-1]) if len(steps) else 0
            ready, held = [*held, table.slice(0, last)], [table.slice(last)]
        else:
            ready, held = held, []
        if ready and (table := pa.concat_tables(ready).combine_chunks()).num_rows:
            key = np.stack([table.column(k).to_numpy() for k in keys], 1)
            yield table, np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])


def _pairs(names: list[bytes], x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Pairs a < b of different nodes, each once."""
    pairs = sorted({tuple(sorted((names[i], names[k]))) for i, k in zip(x.tolist(), y.tolist()) if names[i] != names[k]})
    columns = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])


def likely_forest(multi: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b of one bucket whose joint estimate passes: of each bucket of ``multi`` (band, node, n) a spanning forest."""
    # a pair of greatest likelihood under the limit by so much more cannot reach it
    few = (threshold - MARGIN - 0.15) * M
    known = multi.withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).join(nodes.select("node", "regs", "n_shingles"), "node")
    dealt = in_blocks(known).repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["band", "p", "q"]):
            regs, sizes = _matrix(table.column("regs")), table.column("n_shingles").to_numpy()

            def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                out = np.zeros(len(x), bool)
                for k in range(0, len(x), PAIRS):
                    i, j = x[k : k + PAIRS], y[k : k + PAIRS]
                    near = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
                    some = np.flatnonzero(near)
                    some = some[(regs[i[some]] == regs[j[some]]).sum(1) >= few]
                    a, b = regs[i[some]], regs[j[some]]
                    ok = passes((a > b).sum(1), (a < b).sum(1), sizes[i[some]], sizes[j[some]], threshold)
                    out[k + some[ok]] = True
                return out

            yield _pairs(table.column("node").to_pylist(), *grown(group, test))

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (node, parts) with p, q instead of parts: dealt by node into ``parts`` blocks, and each block with each other one; a
    single block as it is."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    one = F.array(F.lit(0))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("own"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("parts") > 1, others).otherwise(one)))
    return rows.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("own", "other", "parts")


def sets_of(need: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, items: the full set of each node of ``need`` once. Only their texts are read into sets."""
    ids = nodes.join(need.select("node"), "node").select(F.col("doc_id").alias("need_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                sets = [s for s in shingle_sets(batch.column(1).slice(i, j - i), size) if len(s)]
                made = {identity(s): s for s in sets}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(made.keys(), pa.binary()),
                        pa.array([s.view(np.int64) for s in made.values()], pa.list_(pa.int64())),
                    ],
                    ["node", "items"],
                )

    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("need_id")), "left_semi")
    made = texts.mapInArrow(run, "node binary, items array<long>").join(need.select("node"), "node", "left_semi")
    return made.groupBy("node").agg(F.first("items").alias("items"))


def linked_forest(dealt: DataFrame, percent: int) -> DataFrame:
    """Links a, b by full sets of ``dealt`` (cluster, p, q, node, root, items): with the roots, which are joined already, they
    join all that any link within a group joins."""

    def links(names: list[bytes], roots: list[bytes], items: pa.Array) -> pa.RecordBatch:
        offsets = items.offsets.to_numpy().astype(np.int64)
        codes = np.unique(items.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)[1]
        offsets, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        root = np.unique(roots, return_inverse=True)[1]
        marks = np.zeros(int(codes.max()) + 1, bool)
        held, flat_codes, starts = np.arange(len(names)), codes, offsets  # rows whose codes lie in flat_codes
        away, reached, heads, found = held, [], [], []
        while len(away):
            if not reached:
                mates = root[away] == root[away[0]]
                reached, away = away[mates].tolist(), away[~mates]
            if 2 * len(away) <= len(held):
                held = away
                flat_codes = np.concatenate([codes[:0], *(codes[offsets[k] : offsets[k] + sizes[k]] for k in held.tolist())])
                starts = np.cumsum(sizes[held]) - sizes[held]
            if not len(away):
                break
            head = reached.pop()
            own = codes[offsets[head] : offsets[head] + sizes[head]]
            marks[own] = True
            common = np.add.reduceat(marks[flat_codes], starts, dtype=np.int64)[np.searchsorted(held, away)]
            marks[own] = False
            ok = 100 * common >= percent * (sizes[head] + sizes[away] - common)
            found += away[ok].tolist()
            heads += [head] * int(ok.sum())
            ok |= np.isin(root[away], root[away[ok]])
            reached += away[ok].tolist()
            away = away[~ok]
        return _pairs(names, np.array(heads, np.int64), np.array(found, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["cluster", "p", "q"]):
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for i, j in zip(edges, edges[1:]):
                part = table.slice(i, j - i)
                if j - i > 1:
                    yield links(*(part.column(k).to_pylist() for k in ("node", "root")), part.column("items").combine_chunks())

    rows = dealt.select("cluster", "p", "q", "node", "root", "items").repartition("cluster", "p", "q")
    return rows.sortWithinPartitions("cluster", "p", "q").mapInArrow(run, "a binary, b binary").distinct()


def verify(clusters: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Components by full sets, as ``components`` gives them, of the nodes in ``clusters`` (node, root). Links lie within clusters.

    A cluster is dealt into blocks of about ``BLOCK_ITEMS`` shingles, which are compared within themselves. Where a cluster of
    several blocks is not one component then, its nodes outside the largest one are compared with all of its nodes.
    """
    placed = clusters.withColumnRenamed("root", "lead").join(nodes.select("node", "n_shingles"), "node")
    total = placed.groupBy("lead").agg(F.ceil(F.sum("n_shingles") / BLOCK_ITEMS).cast("int").alias("parts"))
    placed = cut(placed.join(total, "lead").withColumn("cluster", F.xxhash64("lead")))
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    sets = cut(sets_of(placed, docs, nodes, size))
    alone = placed.withColumns({"p": part(F.col("parts")), "q": F.lit(0), "root": F.col("node")}).join(sets, "node")
    links = cut(linked_forest(alone, percent))
    comps = cut(components(links))
    large = placed.where("parts > 1")
    if large.isEmpty():
        return comps
    large = large.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = large.groupBy("cluster", "root").agg(F.sum("n_shingles").alias("held"))
    most = each.groupBy("cluster").agg(F.max(F.struct("held", "root")).alias("most"), F.sum("held").alias("all"))
    rest = F.ceil((F.col("all") - F.col("most.held")) / BLOCK_ITEMS).cast("int")
    most = most.select("cluster", F.col("most.root").alias("largest"), rest.alias("outer")).where("outer > 0")
    large = cut(large.join(most, "cluster"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = "cluster", "p", "q", "node", "root"
    inside = large.withColumn("p", upto("outer")).withColumn("q", part(F.col("parts"))).select(*columns)
    outside = large.where("root <> largest").withColumn("p", part(F.col("outer"))).withColumn("q", upto("parts")).select(*columns)
    more = cut(linked_forest(inside.union(outside).distinct().join(sets, "node"), percent))
    return comps if more.isEmpty() else cut(components(links.union(more)))


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node that links reach.

    Large and small stars in turn: every step hangs neighbours on the smallest one seen. The loop ends when a step
    changes nothing; its length grows with the logarithm of a component's size. Runs jobs.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()

    def lowest(e: DataFrame) -> DataFrame:
        return cut(e.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))

    was, now = None, state(edges)
    while now != was:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select("u", "v"))
        large = both.join(lowest(both), "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        large = cut(large.where("u <> v").distinct())
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        mins = lowest(down)
        small = down.join(mins, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        small = small.union(mins.select(F.col("x").alias("v"), F.col("m").alias("u")))
        edges = cut(small.where("u <> v").distinct())
        was, now = now, state(edges)
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, more columns ignored).

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word shingles. Runs jobs.
    """
    return grouped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), size, percent)


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_duplicates`` of docs (doc_id, text) by ids of any type that has an order. Where every row has an id of its own,
    one row of each component is kept."""
    threshold = percent / 100
    drawn = cut(sketch(docs, size))
    nodes = cut(
        drawn.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    )
    banded = bands(nodes)
    shared = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    likely_ones = cut(likely_forest(banded.join(shared, "band"), nodes, threshold))
    comps = verify(cut(components(likely_ones)), docs, nodes, size, percent)
    placed = nodes.join(comps, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = cut(placed.join(smallest, "root").select("node", "component_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = drawn.select("doc_id", "node", "n_shingles").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", kept)
