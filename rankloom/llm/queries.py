"""Queries of the training-data operators, with SQL where SQL can say it over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import rows_of
from . import chunks, ledger, mixture, overlap, packing, spans, splits, top_n


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(rows_of(spark, sf_dir, "examples"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.class_links(rows_of(spark, sf_dir, "examples"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(rows_of(spark, sf_dir, "examples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunks.split_oversized(rows_of(spark, sf_dir, "examples"), "example_id", "doc")
    return pieces.where(F.col("piece_no") == 1).select("example_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_oversized(rows_of(spark, sf_dir, "examples"), "example_id", "doc")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rows_of(spark, sf_dir, "predictions").select("run_name", "query_id", "query", "score", "pred_id")
    blank = F.col("query_id").isNull() | F.col("query_id").rlike(r"(?U)^\s*$")
    p = p.withColumn("group_key", F.when(blank, F.col("query")).otherwise(F.col("query_id"))).drop("query_id", "query")
    return top_n.top_n(p, ["run_name", "group_key"], "score", ["pred_id"], 5)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("run_name", "group_key", "pos", "pred_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups_found(rows_of(spark, sf_dir, "examples"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(rows_of(spark, sf_dir, "examples"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.copies(rows_of(spark, sf_dir, "examples"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.records(rows_of(spark, sf_dir, "examples"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(rows_of(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(rows_of(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.Mixture(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "mix_target")).rows()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.Mixture(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "mix_target")).reached()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans.shared_spans(rows_of(spark, sf_dir, "documents"))
    return s.select("doc_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amount(rows_of(spark, sf_dir, "documents"))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.passages(rows_of(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p1_report, p3_found, p3_pieces, p4_found, p5_found, p5_splits, p6_found, p6_records, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_shared, p9_passages)}

SQL = {
    "p3_found": "SELECT example_id FROM examples WHERE length(doc) > 1200",
    "p4_found": r"""
        WITH k AS (
          SELECT run_name, pred_id, score,
                 CASE WHEN query_id IS NULL OR regexp_full_match(query_id, '[\s\p{Z}]*') THEN query ELSE query_id END AS group_key
          FROM predictions WHERE score IS NOT NULL AND isfinite(score)),
        r AS (SELECT run_name, group_key, pred_id,
                     row_number() OVER (PARTITION BY run_name, group_key ORDER BY score DESC, pred_id) AS pos FROM k)
        SELECT run_name, group_key, CAST(pos AS INTEGER) AS pos, pred_id FROM r WHERE pos <= 5""",
}
