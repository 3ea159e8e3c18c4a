"""State of streams: what is late goes, what is over is freed, and counters equal those of the batch."""

import pytest
from pyspark.sql import functions as F

from pagetrail.schemas import CRAWL_EVENT
from pagetrail.streaming import events as ev
from pagetrail.streaming import state

HOUR = 3600


def event(job, at, n, type_="progress", total=0, progress=None, tier=None):
    return (type_, job, None, None, progress, at, total, 0, None, tier, n)


def table(spark, rows):
    names = [*CRAWL_EVENT.fieldNames(), "n"]
    kinds = ["string", "string", "string", "int", "string", "long", "int", "int", "string", "string", "long"]
    df = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))
    return df.withColumn("timestamp", F.timestamp_seconds("timestamp"))


def stream(spark, folder, batches, fold, mode):
    """The rows that each batch gave, and how many states were held after it."""
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = []
    query = ev.update_query(fold(source), lambda df, k: out.append([r.asDict() for r in df.collect()]), f"{folder}/check", mode=mode)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return out, held


def test_state_is_freed_and_late_rows_go(spark, tmp_path):
    first = [event(f"j{k}", 10_000 + k, k, total=k + 1) for k in range(50)]
    second = [event("j0", 10_000 + 5 * HOUR, 100, "completed", total=9)]
    third = [
        event("j1", 10_001, 101, total=77),  # hours late
        event("j2", 10_000 + 5 * HOUR, 102, "error", total=0),  # speaks again after its state went
        event("k", 10_000 + 5 * HOUR, 103, "tier_switch", progress="Starting Tier 2: x", tier="html"),
    ]
    fourth = [event("k", 10_000 + 20 * HOUR, 104, progress="added 4 new URLs", tier="html")]
    out, held = stream(spark, tmp_path, [table(spark, b) for b in (first, second, third, fourth)], lambda s: state.live_stats(s, "n"), "update")
    assert held[0] == 50 and max(held) == 50 and held[-1] <= 1, held
    rows = [(r["job_id"], r["url_count"], r["html_count"], r["tiers_used"], r["error_count"], r["finished"]) for batch in out for r in batch]
    assert sorted(rows[:50]) == sorted((f"j{k}", k + 1, 0, 0, 0, False) for k in range(50))
    assert sorted(rows[50:]) == [("j0", 9, 0, 0, 0, True), ("j2", 0, 0, 0, 1, False), ("k", 0, 0, 1, 0, False), ("k", 0, 4, 1, 0, False)]


def test_stream_counters_equal_the_batch(spark, tmp_path):
    rows = []
    for n in range(400):
        kind = ["progress", "error", "tier_switch", "url_discovered", "completed"][n % 5 if n % 17 else 4]
        progress = [None, "Starting Tier 1", f"added {n} new URLs", "x"][n % 4]
        rows.append(event(f"j{n % 7}", 50_000 + (n * 37) % 900, n, kind, total=n % 6, progress=progress, tier=[None, "sitemap", "html", "headless"][n % 3 + (n % 2)]))
    whole = table(spark, rows)
    out, _ = stream(spark, tmp_path, [whole.where(F.col("n") % 4 == k) for k in range(4)], lambda s: state.live_stats(s, "n"), "update")
    last = {r["job_id"]: r for batch in out for r in batch}
    assert last == {r["job_id"]: r.asDict() for r in ev.live_stats(whole, ["n"]).collect()}


def test_stale_rows_of_a_stream(spark, tmp_path):
    batches = [[event("a", 100_000, 1), event("a", 90_000, 2)], [event("a", 100_000 - HOUR, 3), event("b", 100_000 - HOUR - 1, 4)], [event("c", 10**6, 5)]]
    out, held = stream(spark, tmp_path, [table(spark, b) for b in batches], state.drop_stale, "append")
    assert [sorted(r["n"] for r in batch) for batch in out if batch] == [[1, 2], [3], [5]]
    assert set(held) == {0}


@pytest.mark.parametrize("again", [False, True])
def test_jobs_of_a_stream_expire_once(spark, tmp_path, again):
    day = 24 * HOUR
    jobs = lambda rows: spark.createDataFrame(rows, "id string, at long").select("id", F.timestamp_seconds("at").alias("created_at"))
    batches = [jobs([("a", day), ("b", 2 * day)]), jobs([("c", 3 * day)] + ([("b", 2 * day + 5)] if again else [])), jobs([("d", 9 * day)])]
    out, held = stream(spark, tmp_path, batches, state.expirations, "append")
    gone = [(r["id"], int(r["created_at"].timestamp()) // day) for batch in out for r in batch]
    assert sorted(gone) == [("a", 1), ("b", 2), ("c", 3)] and held[-1] == 1


def test_jobs_of_a_share_are_folded_together(spark, tmp_path):
    """State rows, and so calls to Python, are bounded by the shares, however many jobs live; jobs of a share end one by one."""
    first = [event(f"j{k}", 10_000 + k, k, "error" if k % 3 else "tier_switch", total=k, progress="Starting Tier 1", tier="sitemap") for k in range(700)]
    first += [event(None, 10_000, 900, total=5)]
    second = [event(f"j{k}", 10_000 + 2 * HOUR, 1000 + k, total=k + 1) for k in range(0, 700, 2)]
    third = [event(f"j{k}", 10_000 + 4 * HOUR, 2000 + k, "completed") for k in range(0, 700, 2)]
    tables = [table(spark, b) for b in (first, second, third)]
    out, held = stream(spark, tmp_path, tables, lambda s: state.live_stats(s, "n"), "update")
    assert held[0] <= state.STATS_SHARES < 700
    # a job that was silent lost its state; the others speak on within the hour after the watermark
    for k, rows in enumerate([first, first + second]):
        want = {r["job_id"]: r.asDict() for r in ev.live_stats(table(spark, rows), ["n"]).collect()}
        got = {r["job_id"]: r for r in out[k]}
        assert set(got) == {r[1] for r in (first, second)[k]} and all(want[job] == got[job] for job in got)


def test_jobs_of_a_share_expire_one_by_one(spark, tmp_path):
    day = 24 * HOUR
    jobs = lambda rows: spark.createDataFrame(rows, "id string, at long").select("id", F.timestamp_seconds("at").alias("created_at"))
    many = [(f"j{k}", day + k * HOUR) for k in range(3000)]
    batches = [jobs(many[k : k + 1000] + many[k : k + 50]) for k in (1000, 2000)]
    batches = [jobs(many[:1000] + many[:50] + [(None, day)])] + batches + [jobs([("end", day + 3000 * HOUR)])]
    out, held = stream(spark, tmp_path, batches, state.expirations, "append")
    gone = sorted((r["id"] or "", int(r["created_at"].timestamp())) for batch in out for r in batch)
    # a day and the hour by which the clock is late have passed
    assert gone == sorted([(n, at) for n, at in many if at + 25 * HOUR < day + 3000 * HOUR] + [("", day)])
    assert max(held) < 1000
