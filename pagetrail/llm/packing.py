"""Sum-of-squares packing of documents into sequences of at most ``size`` tokens.

A document's tokens and its end id are cut, where they are more than ``size``, into pieces of ``size`` tokens of which the
first may be shorter. Whole pieces are sequences of their own. The others are dealt by hash of the row into shards of
bounded expected size, and a shard is packed longest piece first: with n(g) sequences open at a gap of g tokens, a piece
goes to that fitting gap after which the sum of n(g)^2 over all gaps is smallest, so that open gaps stay spread over all
sizes and small pieces find one they fill. Equal sums go to the tightest gap. A sequence is opened only where no open one
fits, since as few as possible are wanted; of a shard of thousands of sequences one or two stay unfilled.

Null and empty texts are the end id alone. Rows with the same doc_id, or none, are documents of their own. Empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut
from .vocabulary import byte_level

#: Expected pieces of a shard.
SHARD = 16384

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """row (a number for each piece), doc_id, piece, start, length, ids_crc32, and the ids if asked for.

    Numbers of rows hold for one run of the plan; write the result before it is read twice.
    """
    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, end = byte_level(path), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4")
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                found, kept = [], []
                for doc, text in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                    flat = np.concatenate([coder.encode(text or "", special=True).astype("<u4"), end])
                    cuts = [0, *range(len(flat) % size or size, len(flat) + 1, size)] if len(flat) > size else [0, len(flat)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        found.append((number, doc, k, a, b - a, zlib.crc32(flat[a:b])))
                        number += 1
                        if ids:
                            kept.append(flat[a:b].view(np.int32))
                columns = zip((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), zip(*found))
                made = [pa.array(c, t) for t, c in columns] + ([pa.array(kept, pa.list_(pa.int32()))] if ids else [])
                yield pa.RecordBatch.from_arrays(made, names)

    schema = PIECES + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fill(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are placed in the given order."""
    count = np.zeros(size + 1, np.int64)  # of open sequences by gap; a full one is not counted
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, length in enumerate(lengths.tolist()):
        # from gap g to g - length, the sum of squares changes by 2 (n(g - length) - n(g)) + 2, or + 1 where it fills
        change = 2 * (count[: size + 1 - length] - count[length:]) + 2
        change[0] -= 1
        change[count[length:] == 0] = none
        left = int(change.argmin())
        gap = left + length
        if change[left] == none:
            gap, left, own = size, size - length, made
            made += 1
        else:
            own = open_[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = own, size - gap
        if left:
            open_[left].append(own)
            count[left] += 1
    return sequence, offset


def pack(found: DataFrame, size: int = 2048) -> DataFrame:
    """``found`` (as ``pieces`` gives it, written) with sequence_id and offset. Runs a job that counts."""
    short = found.where(F.col("length") < size)
    shards = max(1, -(-short.count() // SHARD))
    narrow = short.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        sequence, offset = fill(table.column("length").to_numpy(), size)
        shard = table.column("shard").to_numpy()
        return pa.table([table.column("row"), pa.array(2 * ((shard << 32) + sequence)), pa.array(offset)], ["row", "sequence_id", "offset"])

    placed = narrow.groupBy("shard").applyInArrow(run, "row long, sequence_id long, offset long")
    whole = found.where(F.col("length") == size).select("*", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(placed, "row").unionByName(whole).drop("row")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece of ``docs``. Runs jobs."""
    return pack(cut(pieces(docs, path, size, end_id, ids)), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of ``packed`` with ids: a sequence's pieces end to end."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return whole.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))
