"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A page is much larger once parsed; smaller scan tasks keep Python workers small.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # Call-site tracking asks the JVM once more per Column; plans here have thousands.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "pagetrail", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut points: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pagetrail-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out over all cores when it is smaller than one wave of scan tasks.

    Meant in front of per-row work that costs far more than moving the row. A small file is
    one task however dear its rows are; a large input has tasks enough, and is never moved.
    """
    plan = getattr(df, "_jdf", None)
    if plan is None or df.isStreaming:
        return df
    spark = df.sparkSession
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    cores = spark.sparkContext.defaultParallelism
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < split * cores else df


def materialize(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Write ``df`` to the scratch folder and read it back: cuts the lineage at a place
    that outlives any executor. ``metrics`` are aggregate Columns taken along the way,
    so a loop learns its row counts without another job.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/pagetrail-{uuid.uuid4().hex}"
    observed = Observation()
    metrics = {"rows": F.count(F.lit(1)), **metrics}
    df.observe(observed, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), observed.get


class Buckets:
    """A table in the scratch folder whose rows lie in buckets of ``keys``, so that a join or an aggregate on them moves
    none of its rows. It grows by :meth:`append`; the catalog entry is named at random and :meth:`forget` removes it, while
    the files stay and :meth:`rows` reads them without it.
    """

    def __init__(self, spark: SparkSession, *keys: str, by: str | None = None):
        self.spark, self.keys, self.by = spark, keys, by
        self.name = f"pagetrail_{uuid.uuid4().hex}"
        self.path = f"{scratch_dir(spark).rstrip('/')}/{self.name}"
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.schema = None

    def append(self, df: DataFrame, **metrics) -> dict:
        """Adds the rows of ``df``, which are moved to their buckets; row count and ``metrics`` as in :func:`materialize`."""
        observed = Observation()
        metrics = {"rows": F.count(F.lit(1)), **metrics}
        counted = df.observe(observed, *[c.alias(k) for k, c in metrics.items()])
        # dealt out by the hash the buckets have, a task writes whole buckets
        writer = counted.repartition(self.n, *self.keys).write.mode("append").format("parquet").option("path", self.path)
        if self.by:
            writer = writer.partitionBy(self.by)
        writer.bucketBy(self.n, *self.keys).sortBy(*self.keys).saveAsTable(self.name)
        self.schema = df.schema
        return observed.get

    def table(self) -> DataFrame:
        """The rows so far, known to lie in buckets."""
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The rows so far, as plain files."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
