"""Distributed building blocks that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a prefix sum.  The table of bucket totals has at most this many rows for each group.
BUCKETS = 512


def key128(*cols: Column) -> Column:
    """128-bit key of values, as binary: nulls and borders between values count."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat(*parts)))


def bucket_of(*cols: Column, buckets: int = BUCKETS, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(buckets)).cast("int")


def with_offsets(df: DataFrame, groups: list[str], order: list[str], amount: Column, buckets: int = BUCKETS) -> DataFrame:
    """Add ``seq`` (0-based number of the row) and ``before`` (sum of amount over the earlier rows) within each group.

    The order is that of a hash bucket of the order columns, then of the columns.  No group is put into one task:
    each (group, bucket) is numbered by itself and moved by the totals of the earlier buckets, which are at most
    ``buckets`` rows a group.  Null amounts count as 0; the columns of order must tell the rows of a group apart.
    """
    df = df.withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0).cast("long")))
    df = df.withColumn("_bucket", bucket_of(*[F.col(c) for c in order], buckets=buckets, seed=7))
    totals = df.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(inside) - 1)
    df = df.withColumn("_run", F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_amount"))
    on = None
    names = {c: f"_t{i}" for i, c in enumerate([*groups, "_bucket"])}
    t = totals.withColumnsRenamed(names)
    for c, name in names.items():
        x = F.col(c).eqNullSafe(F.col(name))
        on = x if on is None else on & x
    df = df.join(t, on, "inner")
    df = df.withColumn("seq", F.col("_rn") + F.col("_n0")).withColumn("before", F.col("_run") + F.col("_s0"))
    return df.drop("_amount", "_bucket", "_rn", "_run", "_n0", "_s0", *names.values())


def join_counted(rows: DataFrame, unique: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row for each key and, in column n, how many rows have that key.

    Keys with at least a thousandth of ``total`` rows - at most a thousand keys, whatever the data - go to the rows
    by broadcast, so a key that holds a third of all rows stays spread as the rows are; the other keys are joined by
    shuffle.  Rows without a partner are kept if how is "left".
    """
    least = max(2, total // 1000)
    hot = F.broadcast(unique.where(F.col(n) >= least))
    cold = unique.where(F.col(n) < least)
    marked = rows.join(hot.select(key).withColumn("_hot", F.lit(True)), key, "left")
    a = marked.where(F.col("_hot")).drop("_hot").join(hot, key, "inner")
    b = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, key, how)
    return a.unionByName(b)
