"""Top N rows within every group by descending score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, small_or_shuffled


def band_edges(df: DataFrame, score: str, bands: int, accuracy: int = 2000) -> list[float]:
    """Descending lower edges of the bands of the score but for the last, each with 0.4 of the rows that are left.

    The edges only steer how much is read in which band; any edges give the same result.  The sketch behind them
    sees every row and has a fixed size.  An empty table has no edges.
    """
    if bands < 2:
        return []
    got = df.agg(F.percentile_approx(score, [0.6**i for i in range(1, bands)], accuracy).alias("e")).first()["e"]
    return sorted(set(got or []), reverse=True)


def top_n(df: DataFrame, group: list[str], score: str, tie: list[Column | str], n: int, bands: int = 4) -> DataFrame:
    """The n rows of every group with the highest score, with ``pos`` from 1; ties go by ``tie`` upwards.

    Rows whose score is null, NaN or infinite are left out.  A null group value is a group like any other.  ``tie``
    should tell rows apart; repeated rows that it can't tell apart are interchangeable.  Further columns pass through;
    a column named ``pos`` in df is replaced.  An empty table gives an empty result.

    Bands of the score are taken from the top, one after the other.  Groups that have n rows already leave by an
    anti-join before anything of the band is shuffled.  The others bring one row with how many they have into the
    ranking of the band, which is exact, so ties at the boundary go by ``tie``.  The partial group limit of Spark's
    window operator keeps few rows of a group in each task before the shuffle, so that neither a large group nor a
    band of ties in the millions is gathered.
    """
    s = F.col(score)
    finite = df.drop("pos").where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))))
    names = [f"_g{i}" for i in range(len(group))]
    rows = finite.select("*", *[F.col(g).alias(x) for g, x in zip(group, names)], F.lit(None).cast("long").alias("_have"))
    edges = band_edges(finite, score, bands)
    rank = Window.partitionBy(*names).orderBy(
        F.col("_have").desc_nulls_last(), F.desc(score), *[F.col(t).asc_nulls_last() if isinstance(t, str) else t for t in tie]
    )
    found, have = [], None
    for high, low in zip([None, *edges], [*edges, None]):
        band = rows
        if low is not None:
            band = band.where(s >= F.lit(low))
        if high is not None:
            band = band.where(s < F.lit(high))
        if have is not None:
            full = small_or_shuffled(have.where(F.col("_have") >= n).drop("_have").withColumnsRenamed({x: f"{x}f" for x in names}))
            same = F.lit(True)
            for x in names:
                same = same & F.col(x).eqNullSafe(F.col(f"{x}f"))
            band = band.join(full, same, "left_anti").unionByName(have.where(F.col("_have") < n), allowMissingColumns=True)
        ranked = band.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n + 1)
        already = F.coalesce(F.max("_have").over(Window.partitionBy(*names)), F.lit(0))
        marked = F.max(F.col("_have").isNotNull().cast("int")).over(Window.partitionBy(*names))
        ranked = ranked.withColumn("pos", (F.col("_rank") - marked + already).cast("int"))
        found.append(materialize(ranked.where(F.col("_have").isNull() & (F.col("pos") <= n)).drop("_have", "_rank"), "band"))
        if low is not None:
            now = found[-1].groupBy(*names).agg(F.max("pos").cast("long").alias("_have"))
            have = now if have is None else have.unionByName(now).groupBy(*names).agg(F.max("_have").alias("_have"))
            have = materialize(have, "filled")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop(*names)
