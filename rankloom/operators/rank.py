"""Ranks and running sums in score order within groups, also where one group holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score bands of a group.  Each (group, band) is ordered by itself.
BANDS = 16


def band_column(df: DataFrame, score: str, bands: int = BANDS) -> Column:
    """Number of a row's score band, higher for higher scores; edges come from one fixed-size sketch over all rows."""
    if bands <= 1:
        return F.lit(0)
    got = df.agg(F.percentile_approx(score, [i / bands for i in range(1, bands)], 1000).alias("e")).first()["e"]
    band = F.lit(0)
    for e in sorted(set(got or [])):
        band = band + (F.col(score) >= F.lit(e)).cast("int")
    return band


def ranked(
    df: DataFrame, keys: Sequence[str], score: str, tie: str, sums: dict[str, Column] | None = None, bands: int = BANDS, norm: bool = False
) -> DataFrame:
    """Add rk (from 1, score downwards, then tie upwards), n (rows of the group), and for each sum its running value
    ``cum_x`` up to the row and ``tot_x`` of the group.

    With ``norm`` also norm, the min-max normalised score, with cum_norm and tot_norm.  Rows are shuffled once, by
    group and band; what earlier bands hold comes from totals of at most ``bands`` rows a group.  Rows of one group
    with the same score are in one band and are ordered in one task, which spills.
    """
    sums = dict(sums or {})
    own = df.withColumns({f"_v_{k}": c.cast("double") for k, c in sums.items()} | {"_band": band_column(df, score, bands)})
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum(F.col(score).cast("double")).alias("_s")]
    totals = own.groupBy(*keys, "_band").agg(*aggs, *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    group = Window.partitionBy(*keys)
    over = group.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    cols = {
        "_n0": F.coalesce(F.sum("_n").over(over), F.lit(0)),
        "n": F.sum("_n").over(group),
        "s_min": F.min("_lo").over(group),
        "s_max": F.max("_hi").over(group),
    }
    for k in sums:
        cols |= {f"_b_{k}": F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0.0)), f"tot_{k}": F.sum(f"_t_{k}").over(group)}
    totals = totals.withColumns(cols)
    if norm:
        span = F.col("s_max") - F.col("s_min") + F.lit(1e-8)
        part = F.when(F.col("s_max") == F.col("s_min"), F.lit(0.0)).otherwise((F.col("_s") - F.col("_n") * F.col("s_min")) / span)
        totals = totals.withColumn("_tn", part).withColumns({"_bn": F.coalesce(F.sum("_tn").over(over), F.lit(0.0)), "tot_norm": F.sum("_tn").over(group)})
    totals = totals.drop("_n", "_lo", "_hi", "_s", "_tn", *[f"_t_{k}" for k in sums])
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    totals = totals.withColumnsRenamed(names | {"_band": "_tband"})
    on = F.col("_band") == F.col("_tband")
    for k, t in names.items():
        on = on & F.col(k).eqNullSafe(F.col(t))
    rows = own.join(totals, on).drop("_tband", *names.values())
    w = Window.partitionBy(*keys, "_band").orderBy(F.desc(score), F.asc(tie))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    new = {"rk": F.row_number().over(w) + F.col("_n0")}
    for k in sums:
        new[f"cum_{k}"] = F.sum(f"_v_{k}").over(run) + F.col(f"_b_{k}")
    if norm:
        value = F.when(F.col("s_max") == F.col("s_min"), F.lit(0.0)).otherwise((F.col(score) - F.col("s_min")) / (F.col("s_max") - F.col("s_min") + F.lit(1e-8)))
        rows = rows.withColumn("norm", value)
        new["cum_norm"] = F.sum("norm").over(run) + F.col("_bn")
    drop = ["_band", "_n0", "_bn", *[f"_v_{k}" for k in sums], *[f"_b_{k}" for k in sums]]
    return rows.withColumns(new).drop(*drop)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, bands: int = 64) -> DataFrame:
    """Add the average rank of a value (from 1, ascending), ties sharing the mean of their places.

    The ranks follow from the counts of the distinct values, so a value that all rows share costs nothing; the
    distinct values of a group are ordered band by band.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_band", band_column(df, value, bands))
    totals = counts.groupBy(*keys, "_band").agg(F.sum("_c").alias("_t"))
    lower = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bands`` rows a group
    totals = totals.withColumn("_t0", F.coalesce(F.sum("_t").over(lower), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    counts = _null_safe(counts, totals, [*keys, "_band"]).withColumn(out, F.col("_b") + F.col("_t0") + (F.col("_c") + 1) / 2)
    return _null_safe(df, counts.select(*keys, value, out), [*keys, value])


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by keys that may be null, each key once in the result."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        x = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = x if on is None else on & x
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])
