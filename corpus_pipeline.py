"""A training corpus from ``documents``: good text, lines once, near-duplicates once, no benchmark items, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each result as Parquet in
the shared folder and reads it again. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm import bpe, decontam, line_dedup, quality_fm, setsketch
from pagetrail.llm.common import cut, fresh


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    machine = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.keep_good(docs, machine)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only."""
    return line_dedup.drop_lines(docs, line_dedup.build(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays; texts without words are in no group.

    Rows are judged one by one, by their places in the files of ``docs``: of each group the row of smallest doc_id stays,
    rows without one come last, and of several rows with that doc_id the one of the smallest place stays. So rows that share
    a doc_id, or have none, go only as copies of a row that stays.
    """
    docs = stored(docs)
    file, row = fresh(docs, "llm_file"), fresh(docs, "llm_row")
    place = docs.metadataColumn("_metadata")
    keyed = docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))
    number = F.col("doc_id").cast("long")
    parts = number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"), F.col(file).alias("file"), F.col(row).alias("row")
    found = setsketch.grouped(keyed.select(F.struct(*parts).alias("doc_id"), F.col("text").cast("string")), size=5, percent=80)
    gone = cut(found.where("not kept").select(F.col("doc_id.file").alias(file), F.col("doc_id.row").alias(row)))
    return keyed.join(gone, [file, row], "left_anti").select(*(keyed[c] for c in docs.columns))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read from files as it is, so that rows have places there; else written first."""
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return docs if plan == "LogicalRelation" else cut(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontam.finders(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.keep_clean(docs, found)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", token_ids),
]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
