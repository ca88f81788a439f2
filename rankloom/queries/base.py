"""Registration of named queries, and the views that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sanitize_score
from ..functions.text import group_key
from ..storage import rows_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


BLANK = r"regexp_full_match({0}, '[\s\p{{Z}}]*')"
#: Predictions in the form of the metrics.
PR = r"""pr AS (
  SELECT run_name, CASE WHEN query_id IS NULL OR regexp_full_match(query_id, '[\s\p{Z}]*') THEN query ELSE query_id END AS gk,
         query, doc_id, coalesce(label, 0.0) AS g,
         CASE WHEN score IS NULL OR isnan(score) THEN 0.0 WHEN isinf(score) THEN CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END ELSE score END AS s,
         pred_id AS sidx, retrieval_rank, retrieval_score, true_relevant_count
  FROM predictions)"""
RK = """rk AS (SELECT *, row_number() OVER (PARTITION BY run_name, gk ORDER BY s DESC, sidx) AS rk,
               row_number() OVER (PARTITION BY run_name, gk ORDER BY g DESC, sidx) AS irk, CASE WHEN g >= 0.7 THEN 1 ELSE 0 END AS rel FROM pr)"""


def dcg(k: int, rank: str = "rk") -> str:
    return f"sum(CASE WHEN {rank} <= {k} THEN g / log2({rank} + 1) ELSE 0 END)"


def ndcg(k: int, places: int = 6) -> str:
    return f"round(CASE WHEN {dcg(k, 'irk')} > 0 THEN {dcg(k)} / {dcg(k, 'irk')} ELSE 0.0 END, {places}) AS ndcg_{k}"


def per_query_sql(ks=(1, 3, 10), rs=(1, 3, 5), source: str = "rk", name: str = "pq", places: int = 6) -> str:
    """CTE of the per-query metrics over a ranked CTE."""
    recalls = ", ".join(f"round(coalesce(sum(CASE WHEN rk <= {k} THEN rel ELSE 0 END) / nullif(sum(rel), 0), 0.0), {places}) AS recall_{k}" for k in rs)
    return f"""{name}h AS (SELECT *, sum(rel) OVER (PARTITION BY run_name, gk ORDER BY rk) AS hits FROM {source}),
    {name} AS (SELECT run_name, gk, count(*) AS n, CAST(sum(rel) AS BIGINT) AS relevant,
      round(coalesce(sum(CASE WHEN rel = 1 THEN hits / rk END) / nullif(sum(rel), 0), 0.0), {places}) AS ap,
      round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rk END), 0.0), {places}) AS mrr,
      {', '.join(ndcg(k, places) for k in ks)}, {recalls}
      FROM {name}h GROUP BY run_name, gk)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rows_of(spark, sf_dir, "predictions")
    return p.select(
        "run_name",
        group_key(F.col("query_id"), F.col("query")).alias("gk"),
        "query",
        "doc_id",
        F.coalesce("label", F.lit(0.0)).alias("g"),
        sanitize_score(F.col("score")).alias("s"),
        F.col("pred_id").alias("sidx"),
        "retrieval_rank",
        "retrieval_score",
        "true_relevant_count",
    )


KEYS = ["run_name", "gk"]
EX = r"""ex AS (SELECT *, CASE WHEN query_id IS NULL OR regexp_full_match(query_id, '[\s\p{Z}]*') THEN query ELSE query_id END AS gk FROM examples)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rows_of(spark, sf_dir, "examples")
    return e.withColumn("gk", group_key(F.col("query_id"), F.col("query")))
