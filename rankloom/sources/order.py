"""The place of a row in its files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_or_shuffled

#: Bytes that one file may have, as a power of two.
_FILE_BITS = 41


def with_place(df: DataFrame, paths: str | Sequence[str], name: str = "source_index") -> DataFrame:
    """df as read from files, and in ``name`` a number that rises by file, then by row of the file.

    Files come in the order of the given paths, those of one folder or pattern by name.  Spark packs files into tasks
    by size, so a number by task wouldn't do.  Of a file that is cut into blocks, the number starts at the block's
    first byte; a block holds no more rows than bytes, and one that has a successor fills its task alone.
    """
    spark = df.sparkSession
    given = [paths] if isinstance(paths, str) else list(paths)
    if len(given) > 1:
        files = list(dict.fromkeys(f for p in given for f in sorted(spark.read.format("binaryFile").load(p).inputFiles())))
    else:
        files = sorted(df.inputFiles())
    files = [re.sub(r"^(\w+):/+", r"\1:/", f) for f in files]  # file:/ and file:/// are the same
    numbers = F.broadcast(spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _no long"))  # one row a file
    same = F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/")
    rows = df.select("*", same.alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
    place = F.shiftleft(F.col("_no"), _FILE_BITS) + F.col("_start") + F.col("_row")
    return rows.join(numbers, "_file").withColumn(name, place).drop("_no", "_start", "_row").withColumnRenamed("_file", "file")


def with_dense_index(df: DataFrame, place: str = "source_index", name: str = "index") -> DataFrame:
    """df with the number of each row, from 0 without gaps, in order of ``place``.

    Rows are numbered within stretches of 128 MB of their files, and moved by the counts of the stretches before.
    """
    rows = df.withColumn("_part", F.shiftright(place, 27))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(place)) - 1 + F.col("_before")
    return rows.join(small_or_shuffled(counts), "_part").withColumn(name, number).drop("_part", "_before")
