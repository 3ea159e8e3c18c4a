"""The job table as a log against folding all updates at once, at every step of compactions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagetrail.operators.jobs import upsert_jobs
from pagetrail.sources.job_log import JobLog

SCHEMA = "id string, status string, progress string, result struct<n:int>, created_at timestamp, updated_at timestamp"


def updates(spark, seed, n=200, jobs=60):
    """Late rows, repeated jobs, unset fields; no two rows of a job at the same time."""
    rng = random.Random(seed)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [
        (f"j{rng.randrange(jobs)}", rng.choice([None, "", "running", "failed"]), rng.choice([None, "", f"p{k}"]), rng.choice([None, (k,)]), at(seed), at(s))
        for k, s in enumerate(rng.sample(range(seed, 10**6, 7), n))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def folded(batches):
    whole = batches[0]
    for more in batches[1:]:
        whole = whole.unionByName(more)
    return plain(upsert_jobs(whole.limit(0), whole))


def test_reads_are_the_same_at_every_step(spark, tmp_path):
    log, batches = JobLog(spark, str(tmp_path), buckets=8), [updates(spark, k) for k in range(5)]
    for k, rows in enumerate(batches):
        log.append(rows, k)
        assert plain(log.current()) == folded(batches[: k + 1])
        if k == 2:
            prepared = log.prepare()
            assert prepared.upto == 1 and plain(log.current()) == folded(batches[:3])
            log.commit(prepared)
            assert plain(log.current()) == folded(batches[:3])
        if k == 3:
            log.append(rows, k)  # a retry of the batch
            assert log.compact(3) and not log.compact(3)
    assert plain(log.current()) == folded(batches)
    assert log.compact(4) and plain(log.current()) == folded(batches)


def test_a_read_touches_base_and_open_deltas_only(spark, tmp_path):
    log = JobLog(spark, str(tmp_path), buckets=8)
    for k in range(4):
        log.append(updates(spark, k), k)
    log.compact(1)
    log.append(updates(spark, 9, n=1), 4)
    log.compact(2)
    log.prepare(4)
    read = log._base(log.manifest().parts, log._held(log._deltas().drop("batch"))).select(F.input_file_name().alias("f")).distinct().collect()
    read = {r.f.split(str(tmp_path))[1].split("/part-")[0] for r in read}
    assert read == {f"/base/version={p.version}/bucket={p.bucket}" for p in log.manifest().parts}
    dead = {g.removeprefix(str(tmp_path)) for g in log.garbage()}
    assert {"/delta/batch=0", "/delta/batch=1", "/delta/batch=2"} <= dead and not dead & read and "/delta/batch=3" not in dead
    plan = log.current()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "version=3" not in plan


def test_only_touched_buckets_are_written_anew(spark, tmp_path):
    log = JobLog(spark, str(tmp_path), buckets=32)
    log.append(updates(spark, 0), 0)
    log.compact(0)
    log.append(updates(spark, 1, n=1), 1)
    prepared = log.prepare(1)
    assert [v for _, v in prepared.parts].count(2) == 1 and len(prepared.parts) > 10


@pytest.mark.parametrize("compacted", [False, True])
def test_late_updates_count_per_field(spark, tmp_path, compacted):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    log = JobLog(spark, str(tmp_path))
    log.append(spark.createDataFrame([("a", "running", "", None, at(0), at(1)), ("a", None, "half", None, at(0), at(9))], SCHEMA), 0)
    if compacted:
        log.compact(0)
    log.append(spark.createDataFrame([("a", "failed", "old", None, None, at(5))], SCHEMA), 1)
    assert plain(log.current()) == [("a", "failed", "half", None, at(0), at(9))]
