"""The job table as a log: a base in key buckets, and deltas that a stream adds.

Below the table's folder lie

- ``delta/batch=<n>``: the updates of one micro-batch, owned by it, so that a retry replaces its own rows;
- ``base/version=<v>/bucket=<k>``: folded jobs, each field with the time it was set, so that folding in steps gives what
  folding all at once gives, late updates included;
- ``manifest``: one small file for each compaction, which names the newest version of every bucket and the last batch folded.

A read takes the newest manifest, the buckets it names and the deltas after it, nothing else. A compaction folds the open
deltas into those buckets that they touch and writes them anew beside the old; they count from the moment the manifest's one
file is there, so a reader sees the table either before or after, and a compaction that fails leaves only files that nobody
reads. One compaction runs at a time. ``garbage`` names what no manifest needs any more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "version long, upto long, parts array<struct<bucket: int, version: long>>"


class Prepared(NamedTuple):
    """A compaction whose files are written and not yet read by anyone."""

    version: int
    upto: int
    parts: list[tuple[int, int]]


class JobLog:
    """``key`` names a job, ``version`` when a row was written; the number of buckets is that of the first compaction."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, key: str = "id", version: str = "updated_at"):
        self.spark, self.path, self.buckets, self.key, self.version = spark, path.rstrip("/"), buckets, key, version

    def append(self, updates: DataFrame, batch_id: int) -> None:
        """The updates of one micro-batch; batch numbers ascend. The cost follows the batch, not the table."""
        updates.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch_id}")

    def manifest(self) -> Row:
        """The newest one; a table that was never compacted has version 0 and no base."""
        try:
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return found or Row(version=0, upto=-(1 << 62), parts=[])

    def current(self) -> DataFrame:
        """One row for each job: for each field the newest set value. Null or empty text means "not set"."""
        manifest, deltas = self.manifest(), self._deltas()
        held = self._held(deltas.where(F.col("batch") > manifest.upto).drop("batch"))
        return self._plain(self._merged(self._base(manifest.parts, held), held), deltas.drop("batch").columns)

    def prepare(self, upto: int | None = None) -> Prepared | None:
        """Writes the buckets that deltas up to batch ``upto`` change; None where there are none. By default all batches but
        the newest, which may not be complete."""
        manifest, deltas = self.manifest(), self._deltas()
        if upto is None:
            newest = deltas.select("batch").distinct().orderBy(F.desc("batch")).take(2)
            upto = newest[1].batch if len(newest) > 1 else manifest.upto
        held = self._held(deltas.where((F.col("batch") > manifest.upto) & (F.col("batch") <= upto)).drop("batch"))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r.bucket for r in held.select(bucket.alias("bucket")).distinct().collect()}  # at most all buckets
        if not touched:
            return None
        old = [(p.bucket, p.version) for p in manifest.parts]
        rows = self._merged(self._base([p for p in manifest.parts if p.bucket in touched], held), held)
        version = manifest.version + 1
        # partitions by bucket, of which AQE cuts large ones and joins small ones
        dealt = rows.withColumn("bucket", bucket).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={version}")
        return Prepared(version, upto, sorted([p for p in old if p[0] not in touched] + [(k, version) for k in touched]))

    def commit(self, prepared: Prepared) -> None:
        """One file, which appears as a whole: from then on readers use what was prepared."""
        row = self.spark.createDataFrame([tuple(prepared)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def compact(self, upto: int | None = None) -> bool:
        prepared = self.prepare(upto)
        if prepared:
            self.commit(prepared)
        return prepared is not None

    def garbage(self) -> list[str]:
        """Folders that the newest manifest does not need. Readers that began before it may still do."""
        manifest = self.manifest()
        batches = self._deltas().select("batch").distinct().where(F.col("batch") <= manifest.upto)
        gone = [f"{self.path}/delta/batch={r.batch}" for r in batches.orderBy("batch").collect()]
        live = {(p.bucket, p.version) for p in manifest.parts}
        if manifest.parts:
            every = self.spark.read.parquet(f"{self.path}/base").select("version", "bucket").distinct()
            dead = sorted((r.version, r.bucket) for r in every.collect() if (r.bucket, r.version) not in live)
            gone += [f"{self.path}/base/version={v}/bucket={k}" for v, k in dead]
        return gone

    def _deltas(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/delta").withColumn("batch", F.col("batch").cast("long"))

    def _base(self, parts: list, like: DataFrame) -> DataFrame | None:
        if not parts:
            return None
        paths = [f"{self.path}/base/version={p.version}/bucket={p.bucket}" for p in parts]
        return self.spark.read.schema(like.schema).parquet(*paths)

    def _held(self, rows: DataFrame) -> DataFrame:
        """Rows with each field as (value, at), null where it is not set."""

        def field(name: str, kind: str) -> Column:
            value = F.col(name)
            if name in (self.key, self.version, "created_at"):
                return value
            is_set = value.isNotNull() & (value != "") if kind == "string" else value.isNotNull()
            return F.when(is_set, F.struct(value.alias("value"), F.col(self.version).alias("at"))).alias(name)

        return rows.select(*[field(c, d) for c, d in rows.dtypes])

    def _merged(self, base: DataFrame | None, held: DataFrame) -> DataFrame:
        rows = held if base is None else base.unionByName(held)
        newest = [F.max_by(c, F.col(f"{c}.at")).alias(c) for c in rows.columns if c not in (self.key, self.version, "created_at")]
        created = [F.min("created_at").alias("created_at")] if "created_at" in rows.columns else []
        return rows.groupBy(self.key).agg(*newest, *created, F.max(self.version).alias(self.version)).select(*rows.columns)

    def _plain(self, merged: DataFrame, columns: list[str]) -> DataFrame:
        keep = (self.key, self.version, "created_at")
        return merged.select(*[F.col(c) if c in keep else F.col(f"{c}.value").alias(c) for c in columns])
