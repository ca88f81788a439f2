"""The stateless part of the pipeline over a stream: records in, canonical examples out.

Ranking metrics need whole groups, so they run over what the stream has written, not within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import to_examples


def example_stream(spark: SparkSession, path: str, instruction: str = "") -> DataFrame:
    """Examples of JSON lines as they arrive in a folder; lines that aren't JSON objects are left out.

    source_index is a hash of the line here: a stream has no row numbers.
    """
    lines = spark.readStream.text(path).where(F.trim("value") != "").withColumn("record", F.try_parse_json("value"))
    lines = lines.where(F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))
    return to_examples(lines.select(F.xxhash64("value").alias("source_index"), "record"), instruction)


def write_examples(stream: DataFrame, path: str, checkpoint: str):
    """Append the examples of a stream to a Parquet table; runs what is there, then ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
