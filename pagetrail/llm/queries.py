"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, ann, bpe, decontam, hard_negatives, html_lines, licenses, line_dedup, packing, quality_fm, rans, setsketch, toxicity,
)

BYTE_BPE, WORD_BPE, BYTE_JSON, PIECES = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html_lines.extract(_table(spark, folder, "pages"))


def op2_latent_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return decontam.leaks(docs, decontam.finders(docs, _table(spark, folder, "benchmark")))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_cuckoo_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return line_dedup.digest(docs, line_dedup.build(docs))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op6_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), k=10, every=100)


def op7_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, folder, "documents"), size=4, percent=80)


def op8_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).drop("detections")


def op9_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = quality_fm.score(docs, quality_fm.train(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", (~quality_fm.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op10_rans_files(spark: SparkSession, folder: str) -> DataFrame:
    path = rans.write_documents(_table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return rans.read(spark, path)


def op11_packed_products(spark: SparkSession, folder: str) -> DataFrame:
    rows, label = _table(spark, folder, "embeddings"), F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(rows.withColumn("label", noisy), every=50, positives=5, negatives=3, low=50, high=95, scale=256)


def op12_exact_text_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return alignment.align_documents(docs, public_tokenizers.path(BYTE_JSON), public_tokenizers.path(PIECES))


def op13_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path(BYTE_JSON), size=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_blocks, op2_latent_leaks, op3_byte_bpe, op4_cuckoo_lines, op5_toxicity, op6_kmeans_tree, op7_setsketch,
        op8_license_rules, op9_quality_fm, op10_rans_files, op11_packed_products, op12_exact_text_alignment, op13_sum_of_squares,
    )
}

ORACLES = {
    "op4_cuckoo_lines": """
        WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (
            SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        often AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.top AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(gone::int) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r""",
    "op11_packed_products": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
            FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
            SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
            FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
                AND 100 * n.score BETWEEN 50 * positive_score AND 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 3""",
}
