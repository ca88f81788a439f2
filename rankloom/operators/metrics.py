"""Pointwise, ranking, dynamic-cutoff and business metrics over grouped predictions.

Rows have the group keys, label ``g`` (normalised), score ``s`` (finite) and ``sidx``, the place in the input that
breaks ties.  Sums run in any order, so results are rounded where they are shown.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import id_scores, join_ids
from ..functions.scalar import clip, f1, logit, ratio
from ..storage import materialize
from .rank import _null_safe, average_rank, ranked

#: Defaults of the metrics: normalised threshold, cutoffs, betas.
THRESHOLD, NDCG_KS, RECALL_KS = 0.7, (1, 3, 10), (1, 3, 5)
BETAS = (0.2, 0.3, 0.5, 0.7, 1.0)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _shown(exact: bool):
    return (lambda c: c) if exact else r6


def pointwise(df: DataFrame, label: str = "g", score: str = "s") -> DataFrame:
    """One row: n, mse, bce, pearson, spearman.  Fewer than two rows or a constant side give a correlation of 0."""
    p = clip(F.col(score), 1e-7, 1 - 1e-7)
    g = F.col(label)
    ranks = average_rank(average_rank(df.select(label, score), [], score, "_rs"), [], label, "_rl")

    def corr(x: str, y: str) -> Column:
        vx, vy = F.var_pop(x), F.var_pop(y)
        ok = (F.count(F.lit(1)) >= 2) & (F.stddev_pop(score) > 0) & (F.stddev_pop(label) > 0)
        return F.when(ok, F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy))).otherwise(0.0)

    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.coalesce(F.avg((F.col(score) - g) * (F.col(score) - g)), F.lit(0.0))).alias("mse"),
        r6(F.coalesce(-F.avg(g * F.log(p) + (1 - g) * F.log(1 - p)), F.lit(0.0))).alias("bce"),
        r6(corr(score, label)).alias("pearson"),
        r6(corr("_rs", "_rl")).alias("spearman"),
    )


def _discount(k: int) -> list[float]:
    return [0.0, *[sum(1 / math.log2(i + 1) for i in range(1, j + 1)) for j in range(1, k + 1)]]


def ideal_dcg(df: DataFrame, keys: Sequence[str], ks: Sequence[int], label: str = "g") -> DataFrame:
    """keys with idcg_k: the best DCG the labels of a group allow, from the counts of its distinct labels.

    Only the ``max(ks)`` highest distinct labels of a group can matter, so the window keeps no more of them.
    """
    most = max(ks)
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_c"))
    down = Window.partitionBy(*keys).orderBy(F.desc(label))
    counts = counts.withColumn("_i", F.row_number().over(down)).where(F.col("_i") <= most)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = F.array(*[F.lit(x) for x in _discount(most)])

    def upto(c: Column, k: int) -> Column:
        return F.element_at(table, (F.least(c, F.lit(k)) + 1).cast("int"))

    parts = [F.sum(F.col(label) * (upto(F.col("_before") + F.col("_c"), k) - upto(F.col("_before"), k))).alias(f"idcg_{k}") for k in ks]
    return counts.groupBy(*keys).agg(*parts)


def per_query(
    df: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD, ndcg_ks: Sequence[int] = NDCG_KS, recall_ks: Sequence[int] = RECALL_KS,
    exact: bool = False,
) -> DataFrame:
    """One row a group: n, relevant, ap, mrr, ndcg_k, recall_k; zeros where a group has no relevant row or no gain.

    Figures are rounded to six places unless they are to be exact, for means over them.
    """
    r6 = _shown(exact)
    rel = (F.col("g") >= threshold).cast("int")
    rows = ranked(df.select(*keys, "g", "s", "sidx"), keys, "s", "sidx", {"rel": rel})
    rows = rows.withColumn("_rel", rel)
    hit = F.col("_rel") == 1
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_rel").alias("relevant"), F.sum(F.when(hit, F.col("cum_rel") / F.col("rk"))).alias("_ap"), F.min(F.when(hit, F.col("rk"))).alias("_first")]
    aggs += [F.sum(F.when(F.col("rk") <= k, F.col("g") / F.log2(F.col("rk") + 1))).alias(f"_dcg_{k}") for k in ndcg_ks]
    aggs += [F.sum(F.when(F.col("rk") <= k, F.col("_rel")).otherwise(0)).alias(f"_in_{k}") for k in recall_ks]
    got = _null_safe(rows.groupBy(*keys).agg(*aggs), ideal_dcg(df, keys, ndcg_ks), keys)
    return got.select(
        *keys,
        "n",
        "relevant",
        r6(ratio(F.col("_ap"), F.col("relevant"))).alias("ap"),
        r6(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        *[r6(F.when(F.col(f"idcg_{k}") > 0, F.col(f"_dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0)).alias(f"ndcg_{k}") for k in ndcg_ks],
        *[r6(ratio(F.col(f"_in_{k}"), F.col("relevant"))).alias(f"recall_{k}") for k in recall_ks],
    )


def macro(pq: DataFrame, by: Sequence[str], ndcg_ks: Sequence[int] = NDCG_KS, recall_ks: Sequence[int] = RECALL_KS) -> DataFrame:
    """Means over the groups of per_query."""
    names = ["ap", "mrr", *[f"ndcg_{k}" for k in ndcg_ks], *[f"recall_{k}" for k in recall_ks]]
    means = [r6(F.coalesce(F.avg(c), F.lit(0.0))).alias("map" if c == "ap" else c) for c in names]
    return pq.groupBy(*by).agg(F.count(F.lit(1)).alias("num_queries"), F.sum("n").alias("num_examples"), *means)


def inverted(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Macro metrics of the negated score, to spot a score with the wrong sign."""
    m = macro(per_query(df.withColumn("s", -F.col("s")), keys, exact=True), by)
    return m.withColumnsRenamed({c: f"inverted_{c}" for c in m.columns if c not in (*by, "num_queries", "num_examples")})


def with_cutoffs(df: DataFrame, keys: Sequence[str], betas: Sequence[float] = BETAS, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows with their rank, running sums and the columns to carry, and for each group and beta best_k and
    its value.  The rows are written once, as what follows reads them several times.

    The running sums are made once; the betas multiply the candidates of the argmax only in the aggregation.  The
    expected value is rounded to nine places, and its first maximum decides.
    """
    rows = ranked(df, keys, "s", "sidx", norm=True)
    rows = materialize(rows.select(*keys, *carry, "rk", "cum_norm", "tot_norm"), "ranked")
    return rows, _cuts(rows, keys, betas)


def _cuts(rows: DataFrame, keys: Sequence[str], betas: Sequence[float]) -> DataFrame:
    best = []
    for i, beta in enumerate(betas):
        b2 = beta * beta
        ef = F.round((1 + b2) * F.col("cum_norm") / (F.lit(b2) * F.col("tot_norm") + F.col("rk")), 9)
        best.append(F.min_by(F.struct(F.lit(beta).alias("beta"), F.col("rk").cast("long").alias("best_k"), ef.alias("expected_fbeta")), F.struct(-ef, F.col("rk"))).alias(f"_b{i}"))
    cuts = rows.groupBy(*keys).agg(*best).select(*keys, F.explode(F.array(*[f"_b{i}" for i in range(len(betas))])).alias("_b"))
    return cuts.select(*keys, "_b.beta", "_b.best_k", "_b.expected_fbeta")


def dynamic_beta(df: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD, betas: Sequence[float] = BETAS, exact: bool = False) -> DataFrame:
    """One row a group and beta: best_k, expected_fbeta, true_count, candidate_relevant_count, the cut at the number of
    relevant ids (ideal_*), hit_count, precision, recall, f1.

    df has doc_id and true_relevant_count as well.  Hits are distinct ids, selected rows are rows; where the true count
    is missing or 0 the relevant ids in the list count.
    """
    r6 = _shown(exact)
    rows, cuts = with_cutoffs(df.withColumn("_rel", (F.col("g") >= threshold).cast("int")), keys, betas, ["doc_id", "_rel", "true_relevant_count"])
    ids = rows.groupBy(*keys, "doc_id").agg(F.min("rk").alias("first"), F.max("_rel").alias("rel"))
    first = materialize(ids.where("rel = 1").drop("rel"), "first-ranks")  # where each relevant id stands first, as whichever row
    group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_candidates"), F.max("true_relevant_count").alias("_t"))
    ids = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    group = _left(group, ids, keys).withColumn("candidate_relevant_count", F.coalesce("_r", F.lit(0).cast("long")))
    group = group.withColumn("true_count", F.when(F.coalesce("_t", F.lit(0)) > 0, F.col("_t")).otherwise(F.col("candidate_relevant_count")))
    group = group.drop("_t", "_r")
    wide = _null_safe(cuts, group, keys)
    hits = _null_safe(first, wide.select(*keys, "beta", "best_k", F.col("candidate_relevant_count").alias("ideal_k")), keys)
    hits = hits.groupBy(*keys, "beta").agg(
        F.sum((F.col("first") <= F.col("best_k")).cast("long")).alias("_h"), F.sum((F.col("first") <= F.col("ideal_k")).cast("long")).alias("_ih")
    )
    out = _left(wide, hits, [*keys, "beta"]).fillna(0, ["_h", "_ih"])
    p, r = ratio(F.col("_h"), F.col("best_k")), ratio(F.col("_h"), F.col("true_count"))
    ip, ir = ratio(F.col("_ih"), F.col("candidate_relevant_count")), ratio(F.col("_ih"), F.col("true_count"))
    return out.select(
        *keys, "beta", "num_candidates", "true_count", "candidate_relevant_count", "best_k", r6(F.col("expected_fbeta")).alias("expected_fbeta"),
        F.col("_h").alias("hit_count"), r6(p).alias("precision"), r6(r).alias("recall"), r6(f1(p, r)).alias("f1"),
        F.col("_ih").alias("ideal_hit_count"), r6(ip).alias("ideal_precision"), r6(ir).alias("ideal_recall"), r6(f1(ip, ir)).alias("ideal_f1"),
    )


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        x = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = x if on is None else on & x
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def beta_summary(per: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro and micro figures of dynamic_beta for each beta."""
    sel, true, hit = (F.sum(c) for c in ("best_k", "true_count", "hit_count"))
    mp, mr = ratio(hit, sel), ratio(hit, true)
    return per.groupBy(*by, "beta").agg(
        F.count(F.lit(1)).alias("num_queries"),
        r6(F.avg("candidate_relevant_count")).alias("avg_ideal_top_k"),
        r6(F.avg("best_k")).alias("avg_best_k"),
        r6(F.avg("expected_fbeta")).alias("avg_expected_fbeta"),
        r6(F.avg("precision")).alias("avg_precision"),
        r6(F.avg("recall")).alias("avg_recall"),
        r6(F.avg("f1")).alias("avg_f1"),
        r6(mp).alias("micro_precision"),
        r6(mr).alias("micro_recall"),
        r6(f1(mp, mr)).alias("micro_f1"),
        sel.alias("total_selected"),
        true.alias("total_true"),
        hit.alias("total_hits"),
    )


#: The figures of each beta that stand in the row of overall figures.
BETA_FIGURES = (
    "avg_ideal_top_k", "avg_best_k", "avg_expected_fbeta", "avg_precision", "avg_recall", "avg_f1", "micro_precision", "micro_recall", "micro_f1",
)


def beta_flat(summary: DataFrame, by: Sequence[str], betas: Sequence[float] = BETAS, names: Sequence[str] = BETA_FIGURES) -> DataFrame:
    """One row with beta_0_3_avg_f1 and the like."""
    aggs = [F.max(F.when(F.col("beta") == b, F.col(n))).alias(f"beta_{str(b).replace('.', '_')}_{n}") for b in betas for n in names]
    return summary.groupBy(*by).agg(*aggs)


def ideal_summary(per: DataFrame, by: Sequence[str]) -> DataFrame:
    """Figures of the cut at the number of relevant ids, macro and micro, and the recall of the candidates.

    per is dynamic_beta, exact; as the cut doesn't depend on beta, one of the betas is read.
    """
    one = per.where(F.col("beta") == per.agg(F.min("beta")).first()[0]) if "beta" in per.columns else per
    ideal, true, hit = (F.sum(c) for c in ("candidate_relevant_count", "true_count", "ideal_hit_count"))
    mp, mr = ratio(hit, ideal), ratio(hit, true)
    return one.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_queries"),
        r6(F.avg("candidate_relevant_count")).alias("avg_ideal_top_k"),
        r6(ratio(ideal, true)).alias("candidate_recall"),
        r6(F.avg("ideal_precision")).alias("ideal_precision"),
        r6(F.avg("ideal_recall")).alias("ideal_recall"),
        r6(F.avg("ideal_f1")).alias("ideal_f1"),
        r6(mp).alias("micro_ideal_precision"),
        r6(mr).alias("micro_ideal_recall"),
        r6(f1(mp, mr)).alias("micro_ideal_f1"),
    )


def stored_order_beta(
    df: DataFrame, keys: Sequence[str], counts: DataFrame | None = None, betas: Sequence[float] = BETAS, exact: bool = False, ids: bool = False
) -> DataFrame:
    """Dynamic cutoffs of predictions in the order they were stored in, one row a group and beta.

    df has doc_id, s, is_relevant, and rank and source_rank, which may be null; the order is rank, then the score
    downwards, then source_rank, nulls last.  counts has the keys and true_count; groups that it lacks count the
    relevant ids among their predictions.  With ``ids`` the lists of selected ids, of ids with scores, and of hits are
    added: they hold best_k ids, so they are for reports.
    """
    r6 = _shown(exact)
    far = F.lit(10**9).cast("long")
    span = df.groupBy(*keys).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    norm = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise((F.col("s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-8)))
    rows = _null_safe(df, span, keys).withColumns(
        {"_norm": norm, "_order": -F.coalesce(F.col("rank").cast("long"), far).cast("double"), "_tie": F.struct(-F.col("s"), F.coalesce(F.col("source_rank").cast("long"), far))}
    )
    rows = ranked(rows.drop("_lo", "_hi"), keys, "_order", "_tie", {"norm": F.col("_norm")})
    rows = materialize(rows.select(*keys, "doc_id", "s", "is_relevant", "rk", "cum_norm", "tot_norm"), "ranked")
    cuts = _cuts(rows, keys, betas)
    first = rows.where("is_relevant").groupBy(*keys, "doc_id").agg(F.min("rk").alias("first"))
    group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_count"))
    group = _left(group, first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys).withColumn("recalled_relevant_count", F.coalesce("_r", F.lit(0).cast("long"))).drop("_r")
    if counts is None:
        group = group.withColumn("true_count", F.col("recalled_relevant_count"))
    else:
        group = _left(group, counts.select(*keys, F.col("true_count").alias("_t")), keys)
        group = group.withColumn("true_count", F.coalesce("_t", "recalled_relevant_count")).drop("_t")
    wide = _null_safe(cuts, group, keys)
    hits = _null_safe(first, wide.select(*keys, "beta", "best_k"), keys).groupBy(*keys, "beta").agg(F.sum((F.col("first") <= F.col("best_k")).cast("long")).alias("_h"))
    out = _left(wide, hits, [*keys, "beta"]).fillna(0, ["_h"])
    p, r = ratio(F.col("_h"), F.col("best_k")), ratio(F.col("_h"), F.col("true_count"))
    shown = []
    if ids:
        chosen = _null_safe(rows.select(*keys, "rk", "doc_id", "s", "is_relevant"), cuts.select(*keys, "beta", "best_k"), keys).where(F.col("rk") <= F.col("best_k"))
        lists = chosen.groupBy(*keys, "beta").agg(F.array_sort(F.collect_list(F.struct("rk", "doc_id", "s", "is_relevant"))).alias("_l"))
        out = _left(out, lists, [*keys, "beta"])
        of = lambda rows: F.transform(rows, lambda x: x["doc_id"])
        shown = [
            join_ids(of(F.col("_l"))).alias("selected_ids"),
            id_scores(of(F.col("_l")), F.transform("_l", lambda x: x["s"])).alias("selected_id_scores"),
            join_ids(of(F.filter("_l", lambda x: x["is_relevant"]))).alias("hit_ids"),
        ]
    return out.select(
        *keys, "beta", "true_count", "candidate_count", "recalled_relevant_count", "best_k", r6(F.col("expected_fbeta")).alias("expected_fbeta"), *shown,
        F.col("_h").alias("hit_count"), r6(p).alias("precision"), r6(r).alias("recall"), r6(f1(p, r)).alias("f1"),
    )


def stored_order_summary(per: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro and micro figures of stored_order_beta, exact, for each beta."""
    sel, true, hit = (F.sum(c) for c in ("best_k", "true_count", "hit_count"))
    mp, mr = ratio(hit, sel), ratio(hit, true)
    means = {"avg_selected_count": "best_k", "avg_expected_fbeta": "expected_fbeta", "avg_precision": "precision", "avg_recall": "recall", "avg_f1": "f1"}
    return per.groupBy(*by, "beta").agg(
        F.count(F.lit(1)).alias("num_queries"), *[r6(F.avg(c)).alias(n) for n, c in means.items()], r6(mp).alias("micro_precision"), r6(mr).alias("micro_recall"),
        r6(f1(mp, mr)).alias("micro_f1"), sel.alias("total_selected"), true.alias("total_true_ids"), hit.alias("total_hits"),
    )


def business(gt: DataFrame, preds: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), beta: float = 0.3, exact: bool = False) -> DataFrame:
    """One row a ground-truth query: counts, hits at the number of its ids, best-k and top-k figures.

    gt has query and doc_ids; preds has query, doc_id, s, sidx.  Queries without predictions count with zeros.  Hits are
    distinct ids, precision is over the rows selected.
    """
    r6 = _shown(exact)
    keys = ["query"]
    scored = preds.join(gt.select("query"), "query", "left_semi")
    rows, cuts = with_cutoffs(scored, keys, [beta], ["doc_id"])
    truth = gt.select("query", F.explode("doc_ids").alias("doc_id")).distinct()
    first = rows.groupBy("query", "doc_id").agg(F.min("rk").alias("first")).join(truth, ["query", "doc_id"], "left_semi")
    base = gt.select("query", F.size("doc_ids").alias("label_count"))
    size = rows.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"))
    base = base.join(size, "query", "left").join(cuts.drop("beta"), "query", "left").fillna(0, ["candidates", "best_k"]).fillna(0.0, ["expected_fbeta"])
    hits = base.select("query", "label_count", "best_k").join(first, "query")
    hits = hits.groupBy("query").agg(
        F.sum((F.col("first") <= F.col("label_count")).cast("long")).alias("hits"),
        F.sum((F.col("first") <= F.col("best_k")).cast("long")).alias("best_hits"),
        F.min("first").alias("_first"),
        *[F.sum((F.col("first") <= k).cast("long")).alias(f"_h{k}") for k in ks],
    )
    out = base.join(hits, "query", "left").fillna(0, ["hits", "best_hits", *[f"_h{k}" for k in ks]])
    n = F.col("label_count")
    bp, br = ratio(F.col("best_hits"), F.col("best_k")), ratio(F.col("best_hits"), n)
    cols = [
        "query", n.cast("long").alias("label_count"), "candidates", "hits", r6(ratio(F.col("hits"), n)).alias("accuracy"), "best_k",
        r6(F.col("expected_fbeta")).alias("expected_fbeta"), r6(bp).alias("best_precision"), r6(br).alias("best_recall"),
        r6(f1(bp, br)).alias("best_f1"), (F.col("best_hits") > 0).cast("double").alias("best_hit_rate"),
        r6(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
    ]
    for k in ks:
        h = F.col(f"_h{k}")
        p, r = ratio(h, F.least(F.col("candidates"), F.lit(k))), ratio(h, n)
        cols += [r6(p).alias(f"precision_{k}"), r6(r).alias(f"recall_{k}"), r6(f1(p, r)).alias(f"f1_{k}"), (h > 0).cast("double").alias(f"hit_rate_{k}")]
    return out.select(*cols)


def business_ids(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """(query, top_ids, top_id_scores, hit_ids, missed_ids) of each ground-truth query, ids joined in order.

    The top are as many rows as the query has ids; hits are those of the top that are right, in their order, misses
    the ids of the ground truth that aren't in the top, in its order.  The lists are no longer than the ground truth's.
    """
    size = gt.select("query", F.size("doc_ids").alias("_n"))
    top = ranked(preds.join(size, "query"), ["query"], "s", "sidx").where(F.col("rk") <= F.col("_n"))
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rk", "doc_id", "s"))).alias("_l"))
    got = gt.join(lists, "query", "left").withColumn("_ids", F.coalesce(F.transform("_l", lambda x: x["doc_id"]), F.array().cast("array<string>")))
    return got.select(
        "query",
        join_ids(F.col("_ids")).alias("top_ids"),
        F.coalesce(id_scores(F.col("_ids"), F.transform("_l", lambda x: x["s"])), F.lit("")).alias("top_id_scores"),
        join_ids(F.filter("_ids", lambda x: F.array_contains(F.col("doc_ids"), x))).alias("hit_ids"),
        join_ids(F.array_except("doc_ids", "_ids")).alias("missed_ids"),
    )


def business_summary(per: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Means over all ground-truth queries, and the micro accuracy."""
    names = ["accuracy", "best_k", "expected_fbeta", "best_precision", "best_recall", "best_f1", "best_hit_rate", "mrr"]
    names += [f"{m}_{k}" for k in ks for m in ("precision", "recall", "f1", "hit_rate")]
    return per.agg(
        F.count(F.lit(1)).alias("num_gt_queries"),
        F.sum((F.col("candidates") > 0).cast("long")).alias("num_scored_queries"),
        F.sum("candidates").alias("num_scored_pairs"),
        F.sum("label_count").alias("total_gt_docs"),
        F.sum("hits").alias("total_hits"),
        r6(ratio(F.sum("hits"), F.sum("label_count"))).alias("micro_accuracy"),
        *[r6(F.coalesce(F.avg(c), F.lit(0.0))).alias(f"avg_{c}") for c in names],
    )


def listwise_loss(df: DataFrame, keys: Sequence[str], teacher: str = "g", score: str = "s", t_teacher: float = 1.0, t_model: float = 1.0) -> DataFrame:
    """One row a group: kl of the teacher's softmax against the model's, and cross_entropy.

    With softmaxes t and q, sum t ln t - sum t ln q needs only sums over the group, shifted by its maxima; no window.
    """
    x, y = F.col(teacher) / t_teacher, logit(F.col(score)) / t_model
    rows = df.select(*keys, x.alias("_x"), y.alias("_y"))
    # both are bounded (labels, and logits of clipped scores), so a fixed shift keeps the exponentials in range
    e = F.exp(F.col("_x"))
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e).alias("_zt"),
        F.sum(F.exp("_y")).alias("_zq"),
        F.sum(e * F.col("_x")).alias("_tx"),
        F.sum(e * F.col("_y")).alias("_ty"),
    )
    cross = F.log("_zq") - F.col("_ty") / F.col("_zt")
    own = F.col("_tx") / F.col("_zt") - F.log("_zt")
    return got.select(*keys, "n", r6(own + cross).alias("kl"), r6(cross).alias("cross_entropy"))
