"""Enrichment of predictions, query summaries, bad cases, diagnosis, and comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..functions.text import turn_doc
from .metrics import THRESHOLD, _left, ideal_dcg, macro, per_query, r6
from .rank import _null_safe, ranked

BAD_K, BAD_NDCG, BAD_RANK = 10, 0.5, 10


def enrich(preds: DataFrame, meta: DataFrame, group: str, keys: Sequence[str], fill: Sequence[str], order: str, ident: str) -> DataFrame:
    """Fill null or empty fields of predictions from metadata rows matched by (group, key).

    The keys are tried in order; of several metadata rows with one key the first by ``order`` counts.  Adds ``matched``.
    """
    filled = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys]
    table = meta.withColumn("_key", F.explode(F.filter(F.array(*filled), lambda x: x.isNotNull())))
    table = table.groupBy(group, "_key").agg(F.min_by(F.struct(*fill), order).alias("_m"))
    tries = preds.select(ident, group, F.posexplode(F.array(*filled)).alias("_try", "_key")).where(F.col("_key").isNotNull())
    best = tries.join(table, [group, "_key"]).groupBy(ident).agg(F.min_by("_m", "_try").alias("_m"))
    got = preds.join(best, ident, "left")
    cols = []
    for c in preds.columns:
        cols.append(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).cast(preds.schema[c].dataType), F.col(f"_m.{c}")).alias(c) if c in fill else F.col(c))
    extra = [F.col(f"_m.{c}").alias(c) for c in fill if c not in preds.columns]
    return got.select(*cols, *extra, F.col("_m").isNotNull().alias("matched"))


def merge_last(preds: DataFrame, source: DataFrame, on: Sequence[str], fill: Sequence[str], order: str) -> DataFrame:
    """Fill null fields of predictions from the last source row with the same keys."""
    last = source.groupBy(*on).agg(F.max_by(F.struct(*fill), order).alias("_m"))
    got = _left(preds, last, on)
    return got.select(*[F.coalesce(F.col(c), F.col(f"_m.{c}")).alias(c) if c in fill else F.col(c) for c in preds.columns], F.col("_m").isNotNull().alias("matched"))


def true_counts(df: DataFrame, keys: Sequence[str], names: Sequence[str], order: str) -> DataFrame:
    """(keys, true_count): the first of several columns that isn't 0, of the last row."""
    value = F.coalesce(*[F.nullif(F.col(c).try_cast("long"), F.lit(0)) for c in names], F.lit(0).cast("long"))
    return df.groupBy(*keys).agg(F.max_by(value, order).alias("true_count"))


def query_summary(df: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD, ks: Sequence[int] = (1, 3, 5, 10), top: int = 3) -> DataFrame:
    """One row a group, with its figures, its best row and the bad-case reasons.

    The recall's denominator is the true count from the qrels.  A list of positive ranks and the top rows are made
    from aggregates over the ranks asked for, so the size of a group doesn't matter for them.
    """
    rel = (F.col("g") >= threshold).cast("int")
    cols = [*keys, "doc_id", "g", "s", "sidx", "true_relevant_count"]
    rows = ranked(df.select(*cols), keys, "s", "sidx", {"rel": rel}).withColumn("_rel", rel)
    hit = F.col("_rel") == 1
    first = F.col("rk") == 1
    shown = F.struct(F.col("rk").cast("int").alias("rank"), "doc_id", F.round("s", 6).alias("score"), F.col("g").alias("label"), hit.alias("is_relevant"))
    aggs = [
        F.count(F.lit(1)).alias("num_candidates"), F.sum("_rel").alias("candidate_relevant_count"), F.max("true_relevant_count").alias("_t"),
        F.sum(F.when(hit, F.col("cum_rel") / F.col("rk"))).alias("_ap"), F.coalesce(F.min(F.when(hit, F.col("rk"))), F.lit(0)).alias("best_positive_rank"),
        F.max(F.when(first, F.col("doc_id"))).alias("top1_doc_id"), F.max(F.when(first, F.col("s"))).alias("_s1"), F.max(F.when(first, F.col("g"))).alias("top1_label"),
        F.array_sort(F.collect_list(F.when(F.col("rk") <= top, shown))).alias("top_docs"),
    ]
    for k in ks:
        aggs.append(F.sum(F.when(F.col("rk") <= k, F.col("g") / F.log2(F.col("rk") + 1))).alias(f"_d{k}"))
        aggs.append(F.sum(F.when(F.col("rk") <= k, F.col("_rel")).otherwise(0)).alias(f"_h{k}"))
    got = _null_safe(rows.groupBy(*keys).agg(*aggs), ideal_dcg(df, keys, ks), keys)
    c = F.col("candidate_relevant_count")
    got = got.withColumn("true_relevant_count", F.when(F.coalesce("_t", F.lit(0)) > 0, F.col("_t")).otherwise(c))
    t, best = F.col("true_relevant_count"), F.col("best_positive_rank")
    got = got.select(
        *keys, "num_candidates", "true_relevant_count", "candidate_relevant_count", r6(ratio(c, t)).alias("candidate_recall"), r6(ratio(F.col("_ap"), c)).alias("ap"),
        r6(F.when(best > 0, 1 / best).otherwise(0.0)).alias("mrr"),
        *[r6(F.when(F.col(f"idcg_{k}") > 0, F.col(f"_d{k}") / F.col(f"idcg_{k}")).otherwise(0.0)).alias(f"ndcg_{k}") for k in ks],
        *[r6(ratio(F.col(f"_h{k}"), t)).alias(f"recall_{k}") for k in ks],
        "best_positive_rank", "top1_doc_id", r6(F.col("_s1")).alias("top1_score"), "top1_label", ((c == 0) & (t > 0)).alias("first_stage_miss"), "top_docs",
    )
    return got.withColumn("bad_reasons", bad_reasons()).withColumn("is_bad_case", F.col("bad_reasons") != "")


def bad_reasons(k: int = BAD_K, ndcg: float = BAD_NDCG, rank: int = BAD_RANK) -> Column:
    """Why a query is a bad case, in fixed order; empty if it is none."""
    best = F.col("best_positive_rank")
    return F.concat_ws(
        ",",
        F.when(F.col("first_stage_miss"), "first_stage_miss"),
        F.when(F.col(f"ndcg_{k}") < ndcg, f"ndcg@{k}<{ndcg:g}"),
        F.when((best == 0) | (best > rank), f"best_positive_rank>{rank}"),
    )


def bad_cases(summary: DataFrame, n: int | None = None) -> DataFrame:
    """Bad cases, the first-stage misses first, then by NDCG, MRR and rank; n makes it a report of the worst."""
    out = summary.where("is_bad_case").orderBy(F.desc("first_stage_miss"), "ndcg_10", "mrr", F.desc("best_positive_rank"), *[c for c in summary.columns[:2]])
    return out.limit(n) if n else out


def category_summary(summary: DataFrame, category: str) -> DataFrame:
    """Figures by category; a query without a positive counts with rank 0 in mean and median."""
    means = ["candidate_recall", "ap", "mrr", "ndcg_1", "ndcg_3", "ndcg_5", "ndcg_10", "recall_1", "recall_3", "recall_5", "recall_10"]
    flag = lambda c: r6(F.avg(F.col(c).cast("double")))
    return summary.groupBy(category).agg(
        F.count(F.lit(1)).alias("num_queries"),
        F.sum(F.col("is_bad_case").cast("long")).alias("bad_cases"),
        flag("is_bad_case").alias("bad_rate"),
        flag("first_stage_miss").alias("miss_rate"),
        r6(F.avg("best_positive_rank")).alias("mean_best_rank"),
        F.median("best_positive_rank").alias("median_best_rank"),
        *[r6(F.avg(c)).alias(f"mean_{c}") for c in means],
    )


def candidate_diagnostics(df: DataFrame, keys: Sequence[str], by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Candidate lists without a model: labels, groups without positives, first-stage misses, micro recall, share of groups with any gain."""
    rel = (F.col("g") >= threshold).cast("long")
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(rel).alias("c"), F.max("true_relevant_count").alias("t"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    per = per.withColumn("t", F.when(F.coalesce("t", F.lit(0)) > 0, F.col("t")).otherwise(F.col("c")))
    return per.groupBy(*by).agg(
        F.sum("n").alias("num_pairs"), F.count(F.lit(1)).alias("num_queries"), F.min("lo").alias("label_min"), F.max("hi").alias("label_max"), F.sum("c").alias("positive_pairs"),
        F.sum((F.col("c") == 0).cast("long")).alias("groups_without_positive"), F.sum(((F.col("c") == 0) & (F.col("t") > 0)).cast("long")).alias("first_stage_misses"),
        F.sum("t").alias("total_true"), r6(ratio(F.sum("c"), F.sum("t"))).alias("candidate_recall"), r6(F.avg((F.col("hi") > 0).cast("double"))).alias("oracle_ndcg"),
    )


def prediction_diagnostics(df: DataFrame, keys: Sequence[str], by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Figures of the score, of the negated score, and of the retrieval order, with the gap of the mean scores."""
    model = macro(per_query(df, keys, threshold, exact=True), by).select(*by, F.col("ndcg_10").alias("model_ndcg_10"), F.col("mrr").alias("model_mrr"), F.col("map").alias("model_map"))
    inv = macro(per_query(df.withColumn("s", -F.col("s")), keys, threshold, exact=True), by).select(*by, F.col("ndcg_10").alias("inverted_ndcg_10"), F.col("mrr").alias("inverted_mrr"))
    base = F.coalesce(F.col("retrieval_score"), -F.col("retrieval_rank").cast("double"), F.lit(0.0))
    ret = macro(per_query(df.withColumn("s", base), keys, threshold, exact=True), by).select(*by, F.col("ndcg_10").alias("retrieval_ndcg_10"), F.col("mrr").alias("retrieval_mrr"))
    pos = F.col("g") >= threshold
    means = df.groupBy(*by).agg(F.coalesce(F.avg(F.when(pos, F.col("s"))), F.lit(0.0)).alias("p"), F.coalesce(F.avg(F.when(~pos, F.col("s"))), F.lit(0.0)).alias("q"))
    means = means.select(*by, r6(F.col("p")).alias("positive_score_mean"), r6(F.col("q")).alias("negative_score_mean"), r6(F.col("p") - F.col("q")).alias("score_gap"))
    out = model
    for more in (inv, ret, means):
        out = _null_safe(out, more, by)
    return out


def suggestions() -> Column:
    """Hints from the columns of the two diagnostics."""
    rules = [
        F.when(F.col("candidate_recall") < 0.5, "candidate recall is low"),
        F.when(F.col("groups_without_positive") > 0, "some groups have no positive candidate"),
        F.when(F.col("label_max") <= 0.1, "raw labels look normalised already"),
        F.when(F.col("inverted_ndcg_10") > F.col("model_ndcg_10"), "inverted scores rank better"),
        F.when(F.col("score_gap") < 0, "positives have lower scores than negatives"),
    ]
    return F.concat_ws("; ", *rules)


def compare(a: DataFrame, b: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Two runs' query summaries side by side: deltas, and whether the rank of the first positive improved."""
    pick = lambda d, x: d.select(key, *[F.col(c).alias(f"{x}_{c}") for c in (f"ndcg_{k}", "mrr", "ap", "best_positive_rank")])
    j = pick(a, "better").join(pick(b, "worse"), key)
    br, wr = F.col("better_best_positive_rank"), F.col("worse_best_positive_rank")
    return j.select(
        "*",
        r6(F.col(f"better_ndcg_{k}") - F.col(f"worse_ndcg_{k}")).alias("delta_ndcg"),
        r6(F.col("better_mrr") - F.col("worse_mrr")).alias("delta_mrr"),
        r6(F.col("better_ap") - F.col("worse_ap")).alias("delta_ap"),
        ((br > 0) & ((wr == 0) | (br < wr))).alias("rank_improved"),
    )


def better_cases(cmp: DataFrame, min_delta: float = 0.2, worse_max: float = 0.5, need_rank: bool = False, k: int = 10) -> DataFrame:
    out = cmp.where(F.col("delta_ndcg") >= min_delta)
    if worse_max <= 1:
        out = out.where(F.col(f"worse_ndcg_{k}") <= worse_max)
    return out.where("rank_improved") if need_rank else out


def comparison_summary(a: DataFrame, b: DataFrame, cmp: DataFrame, key: str) -> DataFrame:
    """One row: shared groups, groups of one run only, mean deltas, improved and worse groups."""
    only = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full_outer")
    only = only.agg(F.sum(F.col("_b").isNull().cast("long")).alias("only_better"), F.sum(F.col("_a").isNull().cast("long")).alias("only_worse"))
    got = cmp.agg(
        F.count(F.lit(1)).alias("shared"), r6(F.avg("delta_ndcg")).alias("mean_delta_ndcg"), r6(F.avg("delta_mrr")).alias("mean_delta_mrr"),
        F.sum((F.col("delta_ndcg") > 0).cast("long")).alias("improved"), F.sum((F.col("delta_ndcg") < 0).cast("long")).alias("worse"),
        F.sum(F.col("rank_improved").cast("long")).alias("rank_improved"),
    )
    return got.crossJoin(F.broadcast(only))  # one row each


def best_checkpoint(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The step with the highest NDCG@3, the lower loss on a tie."""
    return history.groupBy(*by).agg(F.max_by("step", F.struct("ndcg_3", -F.col("bce"))).alias("best_step"))


def widen(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of rows with different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_parts(run: Column) -> tuple[Column, Column]:
    """(dataset, model) of a run name, cut at its first double underscore."""
    at = F.instr(run, "__")
    return F.when(at > 0, F.left(run, at - 1)).otherwise(run), F.when(at > 0, F.substring(run, at + 2, F.length(run))).otherwise(F.lit(""))


def dialogue_docs(turns: DataFrame) -> DataFrame:
    """(sample_id, doc_id, session_no, turn_no, doc) of every different turn that says something.

    A turn's id is dia_id, or session:turn_no; sessions are ordered by their number.  Of repeated turns with one id
    the last by turn_id counts.
    """
    tid = F.coalesce(F.nullif(F.trim("dia_id"), F.lit("")), F.concat("session", F.lit(":"), F.col("turn_no").cast("string")))
    rows = turns.where(F.coalesce(F.trim("said"), F.lit("")) != "").withColumn("tid", tid)
    got = rows.groupBy("sample_id", "tid").agg(F.max_by(F.struct("session", "session_time", "turn_no", "speaker", "said"), "turn_id").alias("t"))
    no = F.regexp_extract("t.session", r"^session_(\d+)$", 1).try_cast("int")
    doc = turn_doc(F.col("t.session"), F.col("t.session_time"), F.col("t.speaker"), F.col("t.said"))
    return got.select("sample_id", F.concat("sample_id", F.lit("::"), "tid").alias("doc_id"), "tid", no.alias("session_no"), F.col("t.turn_no").alias("turn_no"), doc.alias("doc"))


def evidence_docs(items: DataFrame, qa: DataFrame, docs: DataFrame) -> DataFrame:
    """(qa_id, sample_id, n_evidence, positives, skip_reason) of every question.

    items has qa_id, pos, item (evidence ids in order); ids that point at no turn are dropped, distinct positives
    counted.  The reason is the first of: no question, no evidence, nothing resolved; else empty.
    """
    it = items.join(qa.select("qa_id", "sample_id"), "qa_id")
    hit = it.join(docs.select("sample_id", F.col("tid").alias("item"), "doc_id"), ["sample_id", "item"])
    n = it.groupBy("qa_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    p = hit.groupBy("qa_id").agg(F.count_distinct("doc_id").alias("positives"))
    out = qa.select("qa_id", "sample_id", "question").join(n, "qa_id", "left").join(p, "qa_id", "left").fillna(0, ["n_evidence", "positives"])
    reason = F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no_question").when(F.col("n_evidence") == 0, "no_evidence").when(F.col("positives") == 0, "unresolved").otherwise("")
    return out.select("qa_id", "sample_id", "n_evidence", "positives", reason.alias("skip_reason"))
