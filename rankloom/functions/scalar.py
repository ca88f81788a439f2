"""Column functions for labels, scores and small formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    """c within lo and hi; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"), F.lit(default))


def as_int(c: Column, default: int = 0) -> Column:
    """Integer of a string that is one; of a number its whole part."""
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def coerce_label(labels: Column, raw_label: Column, label: Column, score: Column, has_labels: Column, has_raw: Column, has_label: Column) -> Column:
    """struct(raw, label) of a record, or null: the first field that is present decides, also if its value is null.

    A lone ``label`` within [0, 1] is normalised already; everything else is on the scale to 10.
    """
    value = F.when(has_labels, labels).when(has_raw, raw_label).when(has_label, label).otherwise(score).try_cast("double")
    own = ~has_labels & ~has_raw & has_label & (value >= 0) & (value <= 1)
    got = F.when(own, F.struct((value * 10).alias("raw"), value.alias("label"))).otherwise(
        F.struct(value.alias("raw"), clip(value / 10, 0.0, 1.0).alias("label"))
    )
    return F.when(value.isNotNull() & ~F.isnan(value), got)


def subset_raw_label(labels: Column, raw_label: Column, label: Column) -> Column:
    """Raw label for subset sampling: no lower bound, a lone label up to 1 is multiplied, negatives too."""
    lone = label.try_cast("double")
    return F.coalesce(labels.try_cast("double"), raw_label.try_cast("double"), F.when(lone <= 1.0, lone * 10).otherwise(lone), F.lit(0.0))


def normalized_label(labels: Column, raw_label: Column, label: Column) -> Column:
    """Normalised label for diagnosis: a lone label within [0, 1] as it is, others divided by 10 and clipped."""
    lone = label.try_cast("double")
    big = F.coalesce(labels.try_cast("double"), raw_label.try_cast("double"))
    lone = F.when((lone >= 0) & (lone <= 1), lone).otherwise(clip(lone / 10, 0.0, 1.0))
    return F.coalesce(clip(big / 10, 0.0, 1.0), lone, F.lit(0.0))


def sanitize_score(c: Column) -> Column:
    """Null and NaN become 0, infinities 1 or 0."""
    inf = F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == inf, 1.0).when(c == -inf, 0.0).otherwise(c)


def sigmoid(c: Column) -> Column:
    """Stable for large magnitudes of either sign."""
    x = clip(c, -709.0, 709.0)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = clip(c, eps, 1 - eps)
    return F.log(p / (1 - p))


def yes_no_score(yes: Column, no: Column, floor: float = -10.0) -> Column:
    """Probability of yes from two log probabilities; a missing one counts as the floor."""
    return sigmoid(clip(F.coalesce(yes, F.lit(floor)) - F.coalesce(no, F.lit(floor)), -80.0, 80.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def lexical_score(query_words: Column, doc_words: Column) -> Column:
    """Deterministic scorer: the part of the query's words in the doc, with a small bonus for long docs."""
    overlap = F.size(F.array_intersect(query_words, doc_words)) / F.greatest(F.size(query_words), F.lit(1))
    bonus = F.least(F.lit(0.15), F.log1p(F.size(doc_words)) / 100)
    return F.when((F.size(query_words) == 0) | (F.size(doc_words) == 0), 0.0).otherwise(F.least(overlap + bonus, F.lit(1.0)))


def l2_normalize(v: Column) -> Column:
    """Vector of length 1 (double); a zero vector stays."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
