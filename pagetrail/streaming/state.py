"""State per job on a stream, freed by event-time timers.

The watermark of a batch is an hour behind the newest event of the batches before it. Rows older than that are dropped; a
job's state goes once the watermark has passed its last event by an hour, so what is held follows the jobs that are alive.
Jobs are dealt out to shares by their hash. A call to Python costs milliseconds, so it is made for a share, not for a job:
a share's state holds its living jobs side by side, and its timer is the earliest of theirs. A share's rows of one batch meet
in one task, in Arrow batches that are folded one after the other; the batch is bounded by the source's
``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``, and a stream with more living jobs takes more shares.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TTL_SECONDS
from .events import COUNTED, LATEST, STALE_AFTER, STALE_SECONDS, measures

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups that :func:`drop_stale` deals a stream out to; a group holds no state.
SHARES = 64
#: Shares of the jobs of a stream.
STATS_SHARES, EXPIRY_SHARES = 512, 1024
NO_TIME = -(1 << 63)


def drop_stale(events: DataFrame) -> DataFrame:
    """Rows of a stream that are not older than the watermark of their batch; columns as they are."""
    share = F.pmod(F.xxhash64(*events.columns), F.lit(SHARES))
    marked = events.withWatermark("timestamp", STALE_AFTER).withColumns({"_share": share, "_at": F.unix_micros("timestamp")})
    names = events.columns

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        oldest = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            kept = frame.loc[frame["_at"] >= oldest, names]
            if len(kept):
                yield kept

    return marked.groupBy("_share").applyInPandasWithState(keep, events.schema, "none int", "append", GroupStateTimeout.NoTimeout)


def _dealt(rows: DataFrame, key: str, shares: int):
    return rows.withColumn("_share", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(shares)).cast("int")).groupBy("_share")


def live_stats(events: DataFrame, tie: str | None = None, shares: int = STATS_SHARES) -> DataFrame:
    """:func:`.events.live_stats` of a stream, in update mode: a row for each job that a batch tells something about.

    ``tie`` is a column of whole numbers. Late rows are dropped; a job's counters begin anew if it speaks again after its
    state was freed.
    """
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    rows = measures(events.withWatermark("timestamp", STALE_AFTER)).select(
        "job_id", "timestamp", F.unix_micros("timestamp").alias("_at"), F.coalesce(order, F.lit(NO_TIME)).alias("_tie"),
        *LATEST, *[F.col(c).cast("int").alias(c) for c in COUNTED], "finished",
    )
    output = "job_id string, " + ", ".join(f"{c} long" for c in (*LATEST, *COUNTED)) + ", finished boolean"
    held = "job_id array<string>, " + ", ".join(f"{c} array<long>, {c}_at array<long>, {c}_tie array<long>" for c in LATEST)
    held += ", " + ", ".join(f"{c} array<long>" for c in COUNTED) + ", finished array<boolean>, newest array<long>"
    n = len(LATEST)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        new = [0, NO_TIME, NO_TIME] * n + [0] * len(COUNTED) + [False, NO_TIME]
        # timers run after a batch's rows, so jobs that are due may still be there
        jobs = {job: told for job, *told in zip(*state.get) if told[-1] // 1000 + STALE_SECONDS * 1000 >= mark} if state.exists else {}
        seen = {}
        for frame in () if state.hasTimedOut else frames:
            frame = frame[frame["_at"] >= mark * 1000].sort_values(["_at", "_tie"])
            codes, names = pd.factorize(frame["job_id"].to_numpy(object), use_na_sentinel=False)
            names = [None if pd.isna(job) else job for job in names]
            olds = [jobs.setdefault(job, new.copy()) for job in names]
            seen.update(dict.fromkeys(names))
            at, tied = frame["_at"].to_numpy(), frame["_tie"].to_numpy()
            for i, name in enumerate(LATEST):
                last = np.full(len(names), -1)
                places = np.flatnonzero(frame[name].notna())
                np.maximum.at(last, codes[places], places)
                values = frame[name].to_numpy()
                for k in np.flatnonzero(last >= 0):
                    when = [int(at[last[k]]), int(tied[last[k]])]
                    if when >= olds[k][3 * i + 1 : 3 * i + 3]:
                        olds[k][3 * i : 3 * i + 3] = [int(values[last[k]]), *when]
            counts = [np.bincount(codes, frame[name].fillna(0), len(names)).astype(int).tolist() for name in COUNTED]
            ends = np.bincount(codes, frame["finished"], len(names)).tolist()
            newest = np.full(len(names), NO_TIME)
            np.maximum.at(newest, codes, at.astype(np.int64))
            for old, *more, end, late in zip(olds, *counts, ends, newest.tolist()):
                old[3 * n : -2] = [a + b for a, b in zip(old[3 * n : -2], more)]
                old[-2:] = [old[-2] or end > 0, max(old[-1], late)]
        if jobs:
            columns = [list(jobs), *map(list, zip(*jobs.values()))]
            state.update(tuple(columns))
            state.setTimeoutTimestamp(min(columns[-1]) // 1000 + STALE_SECONDS * 1000)
        elif state.exists:
            state.remove()
        if seen:
            told = zip(*(jobs[job] for job in seen))
            columns = [c for i, c in enumerate(told) if i >= 3 * n or i % 3 == 0][:-1]
            yield pd.DataFrame(dict(zip(["job_id", *LATEST, *COUNTED, "finished"], [list(seen), *columns])))

    return _dealt(rows, "job_id", shares).applyInPandasWithState(fold, output, held, "update", GroupStateTimeout.EventTimeTimeout)


def expirations(jobs: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = STALE_AFTER, shares: int = EXPIRY_SHARES) -> DataFrame:
    """(id, created_at) of jobs of a stream, each once, when event time has passed ``ttl_seconds`` since it was created.

    The stream's clock is its newest ``created_at`` less ``lateness``. Of repeated rows of a job the first creation counts.
    """
    rows = jobs.select("id", "created_at", F.unix_micros("created_at").alias("_at")).withWatermark("created_at", lateness)

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        waiting = {job: (created, due) for job, created, due in zip(*state.get)} if state.exists else {}
        came = {}
        for frame in () if state.hasTimedOut else frames:
            codes, names = pd.factorize(frame["id"].to_numpy(object), use_na_sentinel=False)
            first = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(first, codes, frame["_at"].to_numpy())
            for job, created in zip(names, first.tolist()):
                job = None if pd.isna(job) else job
                came[job] = min(created, came.get(job, created))
        gone = [job for job, (_, due) in waiting.items() if due < mark and job not in came]
        told = pd.DataFrame({"id": gone, "_at": [waiting.pop(job)[0] for job in gone]})
        for job, created in came.items():
            created = min(created, waiting[job][0]) if job in waiting else created
            # a job that is overdue when it arrives goes with the next batch
            waiting[job] = created, max(created // 1000 + ttl_seconds * 1000, mark + 1)
        if waiting:
            created, due = map(list, zip(*waiting.values()))
            state.update((list(waiting), created, due))
            state.setTimeoutTimestamp(min(due))
        elif state.exists:
            state.remove()
        if gone:
            yield told

    held = "id array<string>, created array<long>, due array<long>"
    gone = _dealt(rows, "id", shares).applyInPandasWithState(wait, "id string, _at long", held, "append", GroupStateTimeout.EventTimeTimeout)
    return gone.select("id", F.timestamp_micros("_at").alias("created_at"))
