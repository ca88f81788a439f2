"""Query summaries, categories, bad cases, diagnosis, run comparison, enrichment, run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import metrics as M
from ..storage import rows_of
from .base import KEYS, PR, RK, per_query_sql, predictions, query

_RANKED = f"{PR}, {RK}"


def _summary_sql(places: int = 6) -> str:
    nd = ", ".join(
        f"round(CASE WHEN sum(CASE WHEN irk <= {k} THEN g / log2(irk + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rk <= {k} THEN g / log2(rk + 1) ELSE 0 END) / sum(CASE WHEN irk <= {k} THEN g / log2(irk + 1) ELSE 0 END) ELSE 0.0 END, {places}) AS ndcg_{k}"
        for k in (1, 3, 5, 10)
    )
    hs = ", ".join(f"sum(CASE WHEN rk <= {k} THEN rel ELSE 0 END) AS h{k}" for k in (1, 3, 5, 10))
    rc = ", ".join(f"round(coalesce(h{k} / nullif(t, 0), 0.0), {places}) AS recall_{k}" for k in (1, 3, 5, 10))
    return f"""{_RANKED}, hh AS (SELECT *, sum(rel) OVER (PARTITION BY run_name, gk ORDER BY rk) AS hits FROM rk),
    s0 AS (SELECT run_name, gk, count(*) AS num_candidates, CAST(sum(rel) AS BIGINT) AS c, max(true_relevant_count) AS t0, sum(CASE WHEN rel = 1 THEN hits / rk END) AS aps,
      coalesce(min(CASE WHEN rel = 1 THEN rk END), 0) AS best_positive_rank, max(CASE WHEN rk = 1 THEN doc_id END) AS top1_doc_id, round(max(CASE WHEN rk = 1 THEN s END), 6) AS top1_score,
      max(CASE WHEN rk = 1 THEN g END) AS top1_label, {nd}, {hs} FROM hh GROUP BY run_name, gk),
    s1 AS (SELECT *, CASE WHEN coalesce(t0, 0) > 0 THEN t0 ELSE c END AS t FROM s0),
    s2 AS (SELECT run_name, gk, num_candidates, t AS true_relevant_count, c AS candidate_relevant_count, round(coalesce(c / nullif(t, 0), 0.0), {places}) AS candidate_recall,
      round(coalesce(aps / nullif(c, 0), 0.0), {places}) AS ap, round(CASE WHEN best_positive_rank > 0 THEN 1.0 / best_positive_rank ELSE 0.0 END, {places}) AS mrr,
      ndcg_1, ndcg_3, ndcg_5, ndcg_10, {rc}, best_positive_rank, top1_doc_id, top1_score, top1_label, (c = 0 AND t > 0) AS first_stage_miss FROM s1),
    qs AS (SELECT *, bad_reasons <> '' AS is_bad_case FROM (SELECT *, concat_ws(',', CASE WHEN first_stage_miss THEN 'first_stage_miss' END, CASE WHEN ndcg_10 < 0.5 THEN 'ndcg@10<0.5' END,
      CASE WHEN best_positive_rank = 0 OR best_positive_rank > 10 THEN 'best_positive_rank>10' END) AS bad_reasons FROM s2))"""


def _summary(spark, sf_dir):
    return A.query_summary(predictions(spark, sf_dir), KEYS)


@query(f"WITH {_summary_sql()} SELECT * FROM qs")
def query_summary(spark, sf_dir):
    return _summary(spark, sf_dir).drop("top_docs")


@query(f"WITH {_summary_sql()} SELECT run_name, gk, ndcg_10, mrr, best_positive_rank, bad_reasons FROM qs WHERE is_bad_case")
def bad_cases(spark, sf_dir):
    return A.bad_cases(_summary(spark, sf_dir)).select("run_name", "gk", "ndcg_10", "mrr", "best_positive_rank", "bad_reasons")


_MEANS = ["candidate_recall", "ap", "mrr", "ndcg_1", "ndcg_3", "ndcg_5", "ndcg_10", "recall_1", "recall_3", "recall_5", "recall_10"]
# six-place figures of single queries are averaged at four places, where their rounding can't tip the mean
_CAT = f"""SELECT category, count(*) AS num_queries, CAST(sum(is_bad_case::INT) AS BIGINT) AS bad_cases, round(avg(is_bad_case::INT), 6) AS bad_rate, round(avg(first_stage_miss::INT), 6) AS miss_rate,
    round(avg(best_positive_rank), 6) AS mean_best_rank, median(best_positive_rank) AS median_best_rank, {', '.join(f'round(avg({c}), 4) AS mean_{c}' for c in _MEANS)}"""


@query(f"WITH {_summary_sql()} {_CAT} FROM (SELECT *, split_part(run_name, '__', 1) AS category FROM qs) GROUP BY category")
def category_summary(spark, sf_dir):
    s = _summary(spark, sf_dir).drop("top_docs").withColumn("category", A.run_parts(F.col("run_name"))[0])
    got = A.category_summary(s, "category")
    return got.select(*[F.round(c, 4).alias(c) if c.startswith("mean_") and c != "mean_best_rank" else F.col(c) for c in got.columns])


@query(f"""WITH {_summary_sql()} SELECT count(*) AS num_queries, CAST(sum(is_bad_case::INT) AS BIGINT) AS bad_cases, CAST(sum(first_stage_miss::INT) AS BIGINT) AS misses,
           CAST(sum(num_candidates) AS BIGINT) AS num_pairs, round(sum(candidate_relevant_count) / sum(true_relevant_count), 6) AS micro_recall, round(avg(ndcg_10), 4) AS ndcg_10 FROM qs""")
def overall_summary(spark, sf_dir):
    n = lambda c: F.sum(F.col(c).cast("long"))
    return _summary(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("num_queries"), n("is_bad_case").alias("bad_cases"), n("first_stage_miss").alias("misses"), n("num_candidates").alias("num_pairs"),
        F.round(n("candidate_relevant_count") / n("true_relevant_count"), 6).alias("micro_recall"), F.round(F.avg("ndcg_10"), 4).alias("ndcg_10"),
    )


@query(f"WITH {_RANKED} SELECT run_name, gk, CAST(rk AS INTEGER) AS rank, doc_id, round(s, 6) AS score, g AS label, g >= 0.7 AS is_relevant FROM rk WHERE rk <= 3")
def top_docs_nested(spark, sf_dir):
    """The nested top rows of each group, taken apart again."""
    return _summary(spark, sf_dir).select("run_name", "gk", F.explode("top_docs").alias("t")).select("run_name", "gk", "t.*")


@query(f"""WITH {PR}, p AS (SELECT run_name, gk, count(*) AS n, sum(CASE WHEN g >= 0.7 THEN 1 ELSE 0 END) AS c, max(true_relevant_count) AS t, min(g) AS lo, max(g) AS hi FROM pr GROUP BY run_name, gk),
           q AS (SELECT *, CASE WHEN coalesce(t, 0) > 0 THEN t ELSE c END AS tt FROM p)
           SELECT run_name, CAST(sum(n) AS BIGINT) AS num_pairs, count(*) AS num_queries, min(lo) AS label_min, max(hi) AS label_max, CAST(sum(c) AS BIGINT) AS positive_pairs,
             count(*) FILTER (c = 0) AS groups_without_positive, count(*) FILTER (c = 0 AND tt > 0) AS first_stage_misses, CAST(sum(tt) AS BIGINT) AS total_true,
             round(coalesce(sum(c) / nullif(sum(tt), 0), 0.0), 6) AS candidate_recall, round(avg(CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END), 6) AS oracle_ndcg FROM q GROUP BY run_name""")
def candidate_diagnostics(spark, sf_dir):
    return A.candidate_diagnostics(predictions(spark, sf_dir), KEYS, ["run_name"])


def _variant(prefix: str, score: str) -> str:
    ranked = RK.replace("rk AS (SELECT *", f"{prefix}k AS (SELECT *", 1).replace("ORDER BY s DESC, sidx", f"ORDER BY {score} DESC, sidx")
    return f"{ranked}, {per_query_sql(source=prefix + 'k', name=prefix, places=15)}"


_DIAG = f"""{PR}, {_variant('m', 's')}, {_variant('v', '(-s)')}, {_variant('t', 'coalesce(retrieval_score, -retrieval_rank, 0.0)')},
    me AS (SELECT run_name, coalesce(avg(CASE WHEN g >= 0.7 THEN s END), 0.0) AS p, coalesce(avg(CASE WHEN g < 0.7 THEN s END), 0.0) AS q FROM pr GROUP BY run_name),
    di AS (SELECT run_name, round(x.a, 6) AS model_ndcg_10, round(x.b, 6) AS model_mrr, round(x.c, 6) AS model_map, round(y.a, 6) AS inverted_ndcg_10, round(y.b, 6) AS inverted_mrr,
      round(z.a, 6) AS retrieval_ndcg_10, round(z.b, 6) AS retrieval_mrr, round(p, 6) AS positive_score_mean, round(q, 6) AS negative_score_mean, round(p - q, 6) AS score_gap
      FROM (SELECT run_name, avg(ndcg_10) AS a, avg(mrr) AS b, avg(ap) AS c FROM m GROUP BY 1) x JOIN (SELECT run_name, avg(ndcg_10) AS a, avg(mrr) AS b FROM v GROUP BY 1) y USING (run_name)
      JOIN (SELECT run_name, avg(ndcg_10) AS a, avg(mrr) AS b FROM t GROUP BY 1) z USING (run_name) JOIN me USING (run_name))"""


@query(f"WITH {_DIAG} SELECT * FROM di")
def prediction_diagnostics(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return A.prediction_diagnostics(p, KEYS, ["run_name"])


@query(f"""WITH {_DIAG}, p0 AS (SELECT run_name, gk, sum(CASE WHEN g >= 0.7 THEN 1 ELSE 0 END) AS c, max(true_relevant_count) AS t, max(g) AS hi FROM pr GROUP BY run_name, gk),
           cd AS (SELECT run_name, round(coalesce(sum(c) / nullif(sum(CASE WHEN coalesce(t, 0) > 0 THEN t ELSE c END), 0), 0.0), 6) AS recall, count(*) FILTER (c = 0) AS without, max(hi) AS hi FROM p0 GROUP BY run_name)
           SELECT run_name, concat_ws('; ', CASE WHEN recall < 0.5 THEN 'candidate recall is low' END, CASE WHEN without > 0 THEN 'some groups have no positive candidate' END,
             CASE WHEN hi <= 0.1 THEN 'raw labels look normalised already' END, CASE WHEN inverted_ndcg_10 > model_ndcg_10 THEN 'inverted scores rank better' END,
             CASE WHEN score_gap < 0 THEN 'positives have lower scores than negatives' END) AS suggestions FROM cd JOIN di USING (run_name)""")
def diagnosis_suggestions(spark, sf_dir):
    """Hints from both diagnostics, one row a run."""
    p = predictions(spark, sf_dir)
    both = A.candidate_diagnostics(p, KEYS, ["run_name"]).join(A.prediction_diagnostics(p, KEYS, ["run_name"]), "run_name")
    return both.select("run_name", A.suggestions().alias("suggestions"))


#: The models that the comparisons take as the better and the worse one.
BETTER, WORSE = "lora_a", "base"


def _two_runs(spark, sf_dir, better: str = BETTER, worse: str = WORSE):
    """Runs of two models of all datasets, compared by dataset and group; rows without a group have none to meet."""
    s = _summary(spark, sf_dir).drop("top_docs").where("gk is not null")
    dataset, model = A.run_parts(F.col("run_name"))
    s = s.withColumn("key", F.concat(dataset, F.lit("|"), F.col("gk"))).withColumn("model", model)
    return s.where(F.col("model") == better), s.where(F.col("model") == worse)


_CMP = f"""{_summary_sql()}, rn AS (SELECT *, split_part(run_name, '__', 1) || '|' || gk AS key, split_part(run_name, '__', 2) AS model FROM qs WHERE gk IS NOT NULL),
    a AS (SELECT * FROM rn WHERE model = '{BETTER}'), b AS (SELECT * FROM rn WHERE model = '{WORSE}'),
    cp AS (SELECT key, a.ndcg_10 AS better_ndcg_10, a.mrr AS better_mrr, a.ap AS better_ap, a.best_positive_rank AS better_best_positive_rank,
      b.ndcg_10 AS worse_ndcg_10, b.mrr AS worse_mrr, b.ap AS worse_ap, b.best_positive_rank AS worse_best_positive_rank, round(a.ndcg_10 - b.ndcg_10, 6) AS delta_ndcg,
      round(a.mrr - b.mrr, 6) AS delta_mrr, round(a.ap - b.ap, 6) AS delta_ap,
      (a.best_positive_rank > 0 AND (b.best_positive_rank = 0 OR a.best_positive_rank < b.best_positive_rank)) AS rank_improved FROM a JOIN b USING (key))"""


@query(f"WITH {_CMP} SELECT * FROM cp")
def compare_runs(spark, sf_dir):
    return A.compare(*_two_runs(spark, sf_dir), "key")


@query(f"WITH {_CMP} SELECT key, delta_ndcg, rank_improved FROM cp WHERE delta_ndcg >= 0.2 AND worse_ndcg_10 <= 0.5")
def better_cases(spark, sf_dir):
    return A.better_cases(A.compare(*_two_runs(spark, sf_dir), "key")).select("key", "delta_ndcg", "rank_improved")


@query(f"""WITH {_CMP} SELECT count(*) AS shared, round(avg(delta_ndcg), 6) AS mean_delta_ndcg, round(avg(delta_mrr), 6) AS mean_delta_mrr, count(*) FILTER (delta_ndcg > 0) AS improved,
           count(*) FILTER (delta_ndcg < 0) AS worse, count(*) FILTER (rank_improved) AS rank_improved, (SELECT count(*) FROM a ANTI JOIN b USING (key)) AS only_better,
           (SELECT count(*) FROM b ANTI JOIN a USING (key)) AS only_worse FROM cp""")
def comparison_summary(spark, sf_dir):
    a, b = _two_runs(spark, sf_dir)
    return A.comparison_summary(a, b, A.compare(a, b, "key"), "key")


@query("""WITH m AS (SELECT query, doc_id, example_id, reason, dataset FROM examples WHERE query IS NOT NULL),
          d AS (SELECT query, doc_id AS k, arg_min({'reason': reason, 'dataset': dataset}, example_id) AS m FROM m WHERE coalesce(doc_id, '') <> '' GROUP BY ALL)
          SELECT pred_id, d.m.reason AS reason, d.m.dataset AS dataset, d.m IS NOT NULL AS matched FROM predictions p LEFT JOIN d ON d.query = p.query AND d.k = p.doc_id""")
def enrich_predictions(spark, sf_dir):
    """Fields of the first example with the same query and doc id, for each prediction."""
    meta = rows_of(spark, sf_dir, "examples").where("query is not null").select("query", "doc_id", "example_id", "reason", "dataset")
    p = rows_of(spark, sf_dir, "predictions").select("pred_id", "query", "doc_id")
    return A.enrich(p, meta, "query", ["doc_id"], ["reason", "dataset"], "example_id", "pred_id").select("pred_id", "reason", "dataset", "matched")


@query("""WITH l AS (SELECT query, doc_id, arg_max({'a': labels}, example_id).a AS labels FROM examples GROUP BY ALL)
          SELECT pred_id, coalesce(p.label, l.labels) AS label, l.query IS NOT NULL OR l.doc_id IS NOT NULL AS matched FROM predictions p
          LEFT JOIN l ON l.query IS NOT DISTINCT FROM p.query AND l.doc_id IS NOT DISTINCT FROM p.doc_id""")
def merge_candidates(spark, sf_dir):
    """Null labels of predictions from the last example with the same query and doc id."""
    p = rows_of(spark, sf_dir, "predictions").select("pred_id", "query", "doc_id", "label")
    src = rows_of(spark, sf_dir, "examples").select("query", "doc_id", F.col("labels").alias("label"), "example_id")
    return A.merge_last(p, src, ["query", "doc_id"], ["label"], "example_id").select("pred_id", "label", "matched")


@query(f"""WITH {PR} SELECT run_name, gk, coalesce(nullif(arg_max(coalesce(true_relevant_count, 0), sidx), 0), 0) AS true_count FROM pr GROUP BY run_name, gk""")
def true_count_lookup(spark, sf_dir):
    return A.true_counts(predictions(spark, sf_dir), KEYS, ["true_relevant_count"], "sidx")


@query(f"""WITH {PR}, {RK}, {per_query_sql(places=15)}, mt AS (SELECT run_name, round(avg(ndcg_3), 6) AS ndcg_3, round(avg(mrr), 6) AS mrr FROM pq GROUP BY run_name),
           cn AS (SELECT run_name, count(*) AS num_pairs FROM pr GROUP BY run_name)
           SELECT split_part(run_name, '__', 1) AS dataset, split_part(run_name, '__', 2) AS model, ndcg_3, mrr, NULL::BIGINT AS num_pairs FROM mt
           UNION ALL SELECT split_part(run_name, '__', 1), split_part(run_name, '__', 2), NULL, NULL, num_pairs FROM cn""")
def run_summary_widen(spark, sf_dir):
    """Two tables of run figures with different columns, one under the other."""
    p = predictions(spark, sf_dir)
    m = M.macro(M.per_query(p, KEYS, exact=True), ["run_name"]).select("run_name", "ndcg_3", "mrr")
    n = p.groupBy("run_name").agg(F.count(F.lit(1)).alias("num_pairs"))
    dataset, model = A.run_parts(F.col("run_name"))
    return A.widen([m, n]).select(dataset.alias("dataset"), model.alias("model"), "ndcg_3", "mrr", "num_pairs")


@query(f"""WITH {PR}, {RK}, {per_query_sql(places=15)}, mt AS (SELECT run_name, round(avg(ndcg_3), 6) AS n3 FROM pq GROUP BY run_name),
           bc AS (SELECT run_name, round(-avg(g * ln(p) + (1 - g) * ln(1 - p)), 6) AS bce FROM (SELECT *, least(greatest(s, 1e-7), 1 - 1e-7) AS p FROM pr) GROUP BY run_name)
           SELECT dataset, best_step FROM (SELECT split_part(run_name, '__', 1) AS dataset, run_name AS best_step,
             row_number() OVER (PARTITION BY split_part(run_name, '__', 1) ORDER BY n3 DESC, bce, run_name DESC) AS z FROM mt JOIN bc USING (run_name)) WHERE z = 1""")
def best_checkpoint(spark, sf_dir):
    """The best run of each dataset by NDCG@3, the lower cross entropy on a tie."""
    p = predictions(spark, sf_dir)
    m = M.macro(M.per_query(p, KEYS, exact=True), ["run_name"]).select("run_name", "ndcg_3")
    q = F.least(F.greatest("s", F.lit(1e-7)), F.lit(1 - 1e-7))
    b = p.groupBy("run_name").agg(F.round(-F.avg(F.col("g") * F.log(q) + (1 - F.col("g")) * F.log(1 - q)), 6).alias("bce"))
    h = m.join(b, "run_name").select(A.run_parts(F.col("run_name"))[0].alias("dataset"), F.col("run_name").alias("step"), "ndcg_3", "bce")
    return A.best_checkpoint(h, ["dataset"])
