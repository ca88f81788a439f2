"""Packed id fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import unpack
from ..storage import rows_of
from .base import query


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each value packed in the id fields of ground truth and of dialogue questions."""
    gt = rows_of(spark, sf_dir, "gt_items").select(F.lit("raw_page_ids").alias("field_name"), F.col("gt_id").alias("row_id"), F.col("raw_page_ids").alias("value"))
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("evidence", "positive_doc_ids")])
    qa = rows_of(spark, sf_dir, "dialogue_qa").select(F.col("qa_id").alias("row_id"), F.explode(fields).alias("f"))
    packed = gt.unionByName(qa.select("f.field_name", "row_id", "f.value"))
    return unpack(packed, ["field_name", "row_id"], "value")
