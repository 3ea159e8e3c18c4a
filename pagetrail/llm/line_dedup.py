"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

The index has three tables. ``refs`` holds each (key, doc_id) once and is exact. ``counts`` holds per key the number of
documents and the largest doc_id. ``filters`` holds per shard of keys a cuckoo filter of the keys that are *repeated*
(held by ``min_docs`` documents or more). Inserting documents adds references, and keys that reach ``min_docs`` enter
their filter; deleting documents takes their references away, and keys that fall below leave it. So a deletion brings
back exactly the state without those documents. Lines ask the filter first; only what it lets through meets the exact
table. A false positive of the filter costs a row in that join and changes nothing.

A key is the line with ASCII white space stripped at both ends and A-Z lowered, in a 128-bit hash; keys under
``min_chars`` code points are not indexed. A repeated key's lines go in every document but the largest doc_id that
holds it. Null and empty texts are one empty line. Rows that share a doc_id are one document when counting, and each
of them keeps or loses its own lines. Rows with a null doc_id count as one document, never the largest one unless no
other holds the key. Columns other than doc_id and text pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, fresh, mix

MIN_CHARS, MIN_DOCS = 40, 5
#: Repeated keys in a shard, on average.
SHARD_KEYS = 20_000
#: Parts that the rows of one shard are dealt to, so that a key in a third of all documents is not one task's.
SALTS = 32
WHITE = " \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The key of each line of ``text``, None where it is too short."""
    out = []
    for line in text.split("\n"):
        bare = line.strip(WHITE)
        out.append(xxhash.xxh3_128_digest(bare.encode().lower()) if len(bare) >= min_chars else None)
    return out


class Cuckoo:
    """Cuckoo filter of 16-bit fingerprints in buckets of four. 0 marks a free slot."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = len(table) - 1

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        size = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (cls.SLOTS * 0.85)))))
        while True:
            made = cls(np.zeros((size, cls.SLOTS), np.uint16))
            if all(made.insert(k) for k in keys):
                return made
            size *= 2

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        pair = np.frombuffer(b"".join(keys), "<u8").reshape(len(keys), 2)
        prints = (pair[:, 0] % U64(65535) + U64(1)).astype(np.uint16)
        first = (pair[:, 1] & U64(self.mask)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        jump = mix(np.atleast_1d(prints).astype(U64)) & U64(self.mask)
        return np.bitwise_xor(bucket, jump.astype(np.int64))

    def insert(self, key: bytes) -> bool:
        """False if the filter is too full; it must then be built anew, larger, from the exact table."""
        prints, first, second = self.places([key])
        mark, bucket = prints[0], int(first[0])
        for b in (bucket, int(second[0])):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self.other(bucket, mark)[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> None:
        """Takes one fingerprint of ``key`` out; the key must be in the filter."""
        prints, first, second = self.places([key])
        for b in (int(first[0]), int(second[0])):
            at = np.flatnonzero(self.table[b] == prints[0])
            if len(at):
                self.table[b, at[0]] = 0
                return

    def contains(self, keys: list[bytes]) -> np.ndarray:
        prints, first, second = self.places(keys)
        mark = prints[:, None]
        return (self.table[first] == mark).any(1) | (self.table[second] == mark).any(1)

    def __bytes__(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, "<u2").reshape(-1, cls.SLOTS).copy())


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame  # key, doc_id
    counts: DataFrame  # key, n_docs, top_doc
    filters: DataFrame  # shard, cells
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key, doc_id: each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {k for k in line_keys(text or "", min_chars) if k}
                keys += own
                at += [i] * len(own)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), batch.column(0).take(pa.array(at, pa.int32()))], ["key", "doc_id"]
                )

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "key binary, doc_id long").distinct()


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _by_shard(rows: DataFrame, filters: DataFrame, keys: tuple[str, ...], work: Callable, schema: str) -> DataFrame:
    """Sends ``rows`` to their shard's filter. ``work(filter or None, table of the shard's rows)`` gives tables; a
    shard's rows come in pieces. Filters sort before rows: ``turn`` is 0 for them."""
    both = filters.withColumn("turn", F.lit(0)).unionByName(rows.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            turn = batch.column("turn").to_numpy()
            cells = batch.column("cells")
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if numbers[i] != shard:
                    shard, held = numbers[i], None
                own = np.flatnonzero(turn[i:j] == 0)
                if len(own):
                    held = Cuckoo.load(cells[i + int(own[-1])].as_py())
                rest = batch.slice(i, j - i).filter(pa.array(turn[i:j] == 1))
                if rest.num_rows:
                    yield from work(held, rest)

    return dealt.mapInArrow(run, schema)


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """shard, cells: a filter for each shard of ``repeated`` (key) that has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = None, []
        for batch in batches:
            for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != shard and keys:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "cells": [bytes(Cuckoo.of(keys))]})
                    keys = []
                shard = s
                keys.append(k)
        if keys:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "cells": [bytes(Cuckoo.of(keys))]})

    numbered = repeated.select(shard_of(shards).alias("shard"), "key")
    return numbered.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(run, "shard int, cells binary")


def count_keys(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """Index of all ``docs``. Runs jobs."""
    refs = cut(references(docs, min_chars))
    counts = cut(count_keys(refs))
    repeated = counts.where(F.col("n_docs") >= min_docs)
    shards = 1 + repeated.count() // SHARD_KEYS
    return LineIndex(refs, counts, cut(build_filters(repeated.select("key"), shards)), shards, min_chars, min_docs)


def _moved(index: LineIndex, counts: DataFrame) -> LineIndex:
    """``index`` with ``counts``: keys that crossed ``min_docs`` enter or leave the filter of their shard."""
    limit = index.min_docs
    old = index.counts.where(F.col("n_docs") >= limit).select("key", F.lit(1).alias("was"))
    new = counts.where(F.col("n_docs") >= limit).select("key", F.lit(1).alias("now"))
    changed = old.join(new, "key", "full").where("was is null or now is null")
    changed = changed.select(shard_of(index.shards).alias("shard"), "key", F.col("now").isNotNull().alias("enters"))
    touched = cut(changed)
    apart = touched.select("shard").distinct()

    def work(held: Cuckoo | None, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, enters = rows.column("key").to_pylist(), rows.column("enters").to_pylist()
        held = held or Cuckoo.of([])
        for k, e in zip(keys, enters):
            if not e:
                held.delete(k)
        full = not all([held.insert(k) for k, e in zip(keys, enters) if e])
        cells = None if full else bytes(held)
        yield pa.RecordBatch.from_arrays(
            [rows.column("shard").slice(0, 1), pa.array([cells], pa.binary())], ["shard", "cells"]
        )

    # one row for a shard, so that all its changes are applied at once
    listed = touched.groupBy("shard").agg(F.collect_list(F.struct("key", "enters")).alias("changes"))

    def listed_work(held: Cuckoo | None, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(rows.num_rows):
            changes = rows.column("changes")[k].as_py()
            table = pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([rows.column("shard")[k].as_py()] * len(changes), pa.int32()),
                    "key": pa.array([c["key"] for c in changes], pa.binary()),
                    "enters": pa.array([c["enters"] for c in changes], pa.bool_()),
                }
            )
            yield from work(held, table)

    updated = cut(_by_shard(listed, index.filters, ("shard",), listed_work, "shard int, cells binary"))
    full = updated.where("cells is null").select("shard")
    again = new.select(shard_of(index.shards).alias("shard"), "key").join(full, "shard", "left_semi")
    filters = index.filters.join(apart, "shard", "left_anti").union(updated.where("cells is not null"))
    filters = cut(filters.union(build_filters(again.select("key"), index.shards)))
    return LineIndex(index.refs, counts, filters, index.shards, index.min_chars, limit)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """``index`` with ``docs`` added; documents it has already (same doc_id and key) change nothing. Runs jobs."""
    known = index.refs.select("key", F.col("doc_id").alias("known_id"))
    same = F.col("doc_id").eqNullSafe(F.col("known_id"))
    added = references(docs, index.min_chars).alias("a")
    added = cut(added.join(known.alias("k"), (F.col("a.key") == F.col("k.key")) & same, "left_anti"))
    delta = count_keys(added).select("key", F.col("n_docs").alias("more"), F.col("top_doc").alias("new_top"))
    total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
    counts = index.counts.join(delta, "key", "full")
    counts = cut(counts.select("key", total.alias("n_docs"), F.greatest("top_doc", "new_top").alias("top_doc")))
    moved = _moved(index, counts)
    return LineIndex(cut(index.refs.union(added)), counts, moved.filters, index.shards, index.min_chars, index.min_docs)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """``index`` without the documents of ``ids`` (doc_id). Runs jobs."""
    gone = ids.select(F.col("doc_id").alias("gone_id")).distinct()
    refs = cut(index.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"))
    counts = cut(count_keys(refs))
    moved = _moved(index, counts)
    return LineIndex(refs, counts, moved.filters, index.shards, index.min_chars, index.min_docs)


def dropped_keys(index: LineIndex) -> DataFrame:
    """doc_id, keys: what each indexed document loses; documents that lose nothing are absent."""

    def ask(held: Cuckoo | None, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if held is not None:
            maybe = held.contains(rows.column("key").to_pylist())
            yield rows.select(["key", "doc_id"]).filter(pa.array(maybe))

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = index.refs.select(shard_of(index.shards).alias("shard"), salt.alias("salt"), "key", "doc_id")
    spread = index.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    maybe = _by_shard(rows, spread, ("shard", "salt"), ask, "key binary, doc_id long").withColumn("salt", salt)
    repeated = index.counts.where(F.col("n_docs") >= index.min_docs).select("key", "top_doc")
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = maybe.join(repeated, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _with_keys(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, str]:
    name, other = fresh(docs, "llm_keys"), fresh(docs, "llm_lost_id")
    lost = lost.select(F.col("doc_id").alias(other), F.col("keys").alias(name)).hint("shuffle_hash")
    return docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col(other)), "left").drop(other), name


def _kept(text: str | None, lost: list[bytes] | None, min_chars: int) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    if not lost:
        return lines, len(lines)
    gone = set(lost)
    return [x for x, k in zip(lines, line_keys(text or "", min_chars)) if k not in gone], len(lines)


def drop_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with repeated lines gone from ``text`` (null: stays null); ``n_chars``, where it is there, follows."""
    joined, name = _with_keys(docs, dropped_keys(index))
    columns, min_chars = docs.columns, index.min_chars
    place = {c.lower(): i for i, c in enumerate(columns)}
    keys_at, text_at, chars_at = len(columns), place["text"], place.get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            lost = arrays[keys_at].to_pylist()
            texts = arrays[text_at].to_pylist()
            for i, own in enumerate(lost):
                if own:
                    texts[i] = "\n".join(_kept(texts[i], own, min_chars)[0])
            arrays[text_at] = pa.array(texts, arrays[text_at].type)
            if chars_at is not None:
                counts = arrays[chars_at].to_pylist()
                counts = [len(t) if own else n for t, own, n in zip(texts, lost, counts)]
                arrays[chars_at] = pa.array(counts, arrays[chars_at].type)
            yield pa.RecordBatch.from_arrays(arrays[: len(columns)], names=columns)

    return joined.select(*[joined[c] for c in columns], name).mapInArrow(run, docs.schema)


def digest(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined, name = _with_keys(docs, dropped_keys(index))
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_kept(t, k, min_chars) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for _, n in kept], pa.int64()),
                    pa.array([n - len(x) for x, n in kept], pa.int64()),
                    pa.array([hashlib.sha256("\n".join(x).encode()).hexdigest() for x, _ in kept], pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.select("doc_id", "text", name).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
