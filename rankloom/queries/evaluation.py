"""Ranking, pointwise, dynamic-cutoff and business metrics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import split_ids
from ..operators import metrics as M
from ..operators.rank import average_rank, ranked
from ..storage import rows_of
from .base import KEYS, PR, RK, per_query_sql, predictions, query

_PQ = "run_name, gk, n, relevant, ap, mrr, ndcg_1, ndcg_3, ndcg_10, recall_1, recall_3, recall_5"
_NAMES = ("mrr", "ndcg_1", "ndcg_3", "ndcg_10", "recall_1", "recall_3", "recall_5")
_MACRO = "run_name, count(*) AS num_queries, CAST(sum(n) AS BIGINT) AS num_examples, round(avg(ap), 6) AS {0}map, " + ", ".join(f"round(avg({c}), 6) AS {{0}}{c}" for c in _NAMES)


@query(f"WITH {PR}, {RK} SELECT run_name, gk, sidx, rk AS rank_by_score, irk AS rank_by_label FROM rk")
def rank_rows(spark, sf_dir):
    p = predictions(spark, sf_dir).select(*KEYS, "sidx", "s", "g")
    by_score = ranked(p, KEYS, "s", "sidx").select(*KEYS, "sidx", "g", F.col("rk").alias("rank_by_score"))
    return ranked(by_score, KEYS, "g", "sidx").select(*KEYS, "sidx", "rank_by_score", F.col("rk").alias("rank_by_label"))


@query(f"""WITH {PR} SELECT run_name, sidx, round(rank() OVER (PARTITION BY run_name ORDER BY s)
           + (count(*) OVER (PARTITION BY run_name, s) - 1) / 2.0, 1) AS avg_rank FROM pr""")
def average_ranks(spark, sf_dir):
    p = predictions(spark, sf_dir).select("run_name", "sidx", "s")
    return average_rank(p, ["run_name"], "s", "avg_rank").select("run_name", "sidx", F.round("avg_rank", 1).alias("avg_rank"))


@query(f"""WITH {PR}, t AS (SELECT g, s, least(greatest(s, 1e-7), 1 - 1e-7) AS p,
             rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rl FROM pr)
           SELECT count(*) AS n, round(avg((s - g) * (s - g)), 6) AS mse, round(-avg(g * ln(p) + (1 - g) * ln(1 - p)), 6) AS bce,
             round(corr(s, g), 6) AS pearson, round(corr(rs, rl), 6) AS spearman FROM t""")
def pointwise_metrics(spark, sf_dir):
    return M.pointwise(predictions(spark, sf_dir))


@query(f"WITH {PR}, {RK}, {per_query_sql()} SELECT {_PQ} FROM pq")
def per_query_metrics(spark, sf_dir):
    return M.per_query(predictions(spark, sf_dir), KEYS)


@query(f"WITH {PR}, {RK}, {per_query_sql(places=15)} SELECT {_MACRO.format('')} FROM pq GROUP BY run_name")
def macro_metrics(spark, sf_dir):
    return M.macro(M.per_query(predictions(spark, sf_dir), KEYS, exact=True), ["run_name"])


@query(f"""WITH {PR.replace("pr AS (", "pr0 AS (")}, pr AS (SELECT * REPLACE (-s AS s) FROM pr0), {RK}, {per_query_sql(places=15)}
           SELECT {_MACRO.format('inverted_')} FROM pq GROUP BY run_name""")
def inverted_metrics(spark, sf_dir):
    return M.inverted(predictions(spark, sf_dir), KEYS, ["run_name"])


_CUTS = """mm AS (SELECT *, CASE WHEN max(s) OVER w = min(s) OVER w THEN 0.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-8) END AS norm
      FROM rk WINDOW w AS (PARTITION BY {k})),
    cc AS (SELECT *, sum(norm) OVER (PARTITION BY {k} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS cn, sum(norm) OVER (PARTITION BY {k}) AS tn FROM mm),
    bt AS (SELECT unnest([{betas}])::DOUBLE AS beta),
    ef AS (SELECT cc.*, beta, round((1 + beta * beta) * cn / (beta * beta * tn + rk), 9) AS efb FROM cc, bt),
    cut AS (SELECT {k}, beta, rk AS best_k, round(efb, 6) AS expected_fbeta FROM
      (SELECT *, row_number() OVER (PARTITION BY {k}, beta ORDER BY efb DESC, rk) AS z FROM ef) WHERE z = 1)"""
_BETA = f"""{PR}, {RK}, {_CUTS.format(k='run_name, gk', betas='0.2, 0.3, 0.5, 0.7, 1.0')},
    ids AS (SELECT run_name, gk, doc_id, min(rk) AS first FROM rk GROUP BY ALL HAVING max(rel) = 1),
    ng AS (SELECT run_name, gk, count(*) AS num_candidates, max(true_relevant_count) AS t FROM rk GROUP BY ALL),
    nr AS (SELECT run_name, gk, count(*) AS c FROM ids GROUP BY ALL),
    gr AS (SELECT ng.run_name, ng.gk, num_candidates, coalesce(c, 0) AS candidate_relevant_count, CASE WHEN coalesce(t, 0) > 0 THEN t ELSE coalesce(c, 0) END AS true_count
      FROM ng LEFT JOIN nr ON ng.run_name = nr.run_name AND ng.gk IS NOT DISTINCT FROM nr.gk),
    ht AS (SELECT cut.run_name, cut.gk, beta, best_k, expected_fbeta, num_candidates, true_count, candidate_relevant_count,
      (SELECT count(*) FROM ids i WHERE i.run_name = cut.run_name AND i.gk IS NOT DISTINCT FROM cut.gk AND first <= best_k) AS h,
      (SELECT count(*) FROM ids i WHERE i.run_name = cut.run_name AND i.gk IS NOT DISTINCT FROM cut.gk AND first <= candidate_relevant_count) AS ih
      FROM cut JOIN gr ON cut.run_name = gr.run_name AND cut.gk IS NOT DISTINCT FROM gr.gk),
    pc AS (SELECT *, coalesce(h / nullif(best_k, 0), 0.0) AS p, coalesce(h / nullif(true_count, 0), 0.0) AS r,
      coalesce(ih / nullif(candidate_relevant_count, 0), 0.0) AS ip, coalesce(ih / nullif(true_count, 0), 0.0) AS ir FROM ht),
    db AS (SELECT run_name, gk, beta, num_candidates, true_count, candidate_relevant_count, best_k, expected_fbeta, h AS hit_count, round(p, 6) AS precision,
      round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, ih AS ideal_hit_count, round(ip, 6) AS ideal_precision,
      round(ir, 6) AS ideal_recall, round(CASE WHEN ip + ir = 0 THEN 0.0 ELSE 2 * ip * ir / (ip + ir) END, 6) AS ideal_f1 FROM pc)"""


def _exact(sql: str) -> str:
    """The same CTEs with figures that aren't rounded, but for the nine places that decide the best cut."""
    return re.sub(r", 6\)", ", 15)", sql)


@query(f"WITH {_BETA} SELECT * FROM db")
def dynamic_beta(spark, sf_dir):
    return M.dynamic_beta(predictions(spark, sf_dir), KEYS)


_BS = """bs AS (SELECT run_name, beta, count(*) AS num_queries, round(avg(candidate_relevant_count), 6) AS avg_ideal_top_k, round(avg(best_k), 6) AS avg_best_k,
      round(avg(expected_fbeta), 6) AS avg_expected_fbeta, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(f1), 6) AS avg_f1,
      coalesce(sum(hit_count) / nullif(sum(best_k), 0), 0.0) AS mp, coalesce(sum(hit_count) / nullif(sum(true_count), 0), 0.0) AS mr,
      CAST(sum(best_k) AS BIGINT) AS total_selected, CAST(sum(true_count) AS BIGINT) AS total_true, CAST(sum(hit_count) AS BIGINT) AS total_hits FROM db GROUP BY run_name, beta),
    bf AS (SELECT * EXCLUDE (mp, mr), round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall,
      round(CASE WHEN mp + mr = 0 THEN 0.0 ELSE 2 * mp * mr / (mp + mr) END, 6) AS micro_f1 FROM bs)"""


@query(f"WITH {_exact(_BETA)}, {_BS} SELECT * FROM bf")
def beta_summary(spark, sf_dir):
    return M.beta_summary(M.dynamic_beta(predictions(spark, sf_dir), KEYS, exact=True), ["run_name"])


_FLAT = ", ".join(f"max(CASE WHEN beta = {b} THEN {n} END) AS beta_{str(b).replace('.', '_')}_{n}" for b in M.BETAS for n in M.BETA_FIGURES)


@query(f"WITH {_exact(_BETA)}, {_BS} SELECT run_name, {_FLAT} FROM bf GROUP BY run_name")
def beta_flat(spark, sf_dir):
    return M.beta_flat(M.beta_summary(M.dynamic_beta(predictions(spark, sf_dir), KEYS, exact=True), ["run_name"]), ["run_name"])


@query(f"""WITH {_exact(_BETA)}, o AS (SELECT * FROM db WHERE beta = 0.2::DOUBLE),
           m AS (SELECT run_name, count(*) AS num_queries, round(avg(candidate_relevant_count), 6) AS avg_ideal_top_k, round(coalesce(sum(candidate_relevant_count) / nullif(sum(true_count), 0), 0.0), 6) AS candidate_recall,
             round(avg(ideal_precision), 6) AS ideal_precision, round(avg(ideal_recall), 6) AS ideal_recall, round(avg(ideal_f1), 6) AS ideal_f1,
             coalesce(sum(ideal_hit_count) / nullif(sum(candidate_relevant_count), 0), 0.0) AS mp, coalesce(sum(ideal_hit_count) / nullif(sum(true_count), 0), 0.0) AS mr FROM o GROUP BY run_name)
           SELECT * EXCLUDE (mp, mr), round(mp, 6) AS micro_ideal_precision, round(mr, 6) AS micro_ideal_recall, round(CASE WHEN mp + mr = 0 THEN 0.0 ELSE 2 * mp * mr / (mp + mr) END, 6) AS micro_ideal_f1 FROM m""")
def ideal_k_summary(spark, sf_dir):
    return M.ideal_summary(M.dynamic_beta(predictions(spark, sf_dir), KEYS, exact=True), ["run_name"])


def _stored(spark, sf_dir):
    """Predictions as a run stored them: the retrieval's rank, the score, the place in the file."""
    p = predictions(spark, sf_dir)
    return p.select(*KEYS, "doc_id", "s", (F.col("g") >= M.THRESHOLD).alias("is_relevant"), F.col("retrieval_rank").alias("rank"), F.col("sidx").alias("source_rank"), "true_relevant_count")


def _stored_beta(spark, sf_dir, **options):
    p = _stored(spark, sf_dir)
    counts = p.groupBy(*KEYS).agg(F.max("true_relevant_count").alias("true_count")).where("true_count > 0")
    return M.stored_order_beta(p.drop("true_relevant_count"), KEYS, counts, **options)


_SO = f"""{PR}, rk AS (SELECT *, row_number() OVER (PARTITION BY run_name, gk ORDER BY coalesce(retrieval_rank, 1000000000), s DESC, sidx) AS rk, g >= 0.7 AS rel FROM pr),
    {_CUTS.format(k='run_name, gk', betas='0.2, 0.3, 0.5, 0.7, 1.0')},
    ids AS (SELECT run_name, gk, doc_id, min(rk) AS first FROM rk WHERE rel GROUP BY ALL),
    nr AS (SELECT run_name, gk, count(*) AS c FROM ids GROUP BY ALL),
    gr AS (SELECT n.*, coalesce(c, 0) AS recalled_relevant_count, CASE WHEN t > 0 THEN t ELSE coalesce(c, 0) END AS true_count
      FROM (SELECT run_name, gk, count(*) AS candidate_count, max(true_relevant_count) AS t FROM rk GROUP BY ALL) n LEFT JOIN nr ON n.run_name = nr.run_name AND n.gk IS NOT DISTINCT FROM nr.gk),
    hc AS (SELECT cut.run_name, cut.gk, beta, count(*) AS h FROM cut JOIN ids i ON i.run_name = cut.run_name AND i.gk IS NOT DISTINCT FROM cut.gk AND first <= best_k GROUP BY ALL),
    pc AS (SELECT cut.run_name, cut.gk, cut.beta, true_count, candidate_count, recalled_relevant_count, best_k, expected_fbeta, coalesce(h, 0) AS hit_count,
      coalesce(h / nullif(best_k, 0), 0.0) AS p, coalesce(h / nullif(true_count, 0), 0.0) AS r FROM cut JOIN gr ON cut.run_name = gr.run_name AND cut.gk IS NOT DISTINCT FROM gr.gk
      LEFT JOIN hc ON hc.run_name = cut.run_name AND hc.gk IS NOT DISTINCT FROM cut.gk AND hc.beta = cut.beta),
    db AS (SELECT * EXCLUDE (p, r), round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pc)"""


@query(f"WITH {_SO} SELECT * FROM db")
def beta_matrix_per_query(spark, sf_dir):
    return _stored_beta(spark, sf_dir)


@query(f"""WITH {_exact(_SO)}, m AS (SELECT run_name, beta, count(*) AS num_queries, round(avg(best_k), 6) AS avg_selected_count, round(avg(expected_fbeta), 6) AS avg_expected_fbeta,
             round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(f1), 6) AS avg_f1, coalesce(sum(hit_count) / nullif(sum(best_k), 0), 0.0) AS mp,
             coalesce(sum(hit_count) / nullif(sum(true_count), 0), 0.0) AS mr, CAST(sum(best_k) AS BIGINT) AS total_selected, CAST(sum(true_count) AS BIGINT) AS total_true_ids, CAST(sum(hit_count) AS BIGINT) AS total_hits
             FROM db GROUP BY run_name, beta)
           SELECT * EXCLUDE (mp, mr), round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(CASE WHEN mp + mr = 0 THEN 0.0 ELSE 2 * mp * mr / (mp + mr) END, 6) AS micro_f1 FROM m""")
def beta_matrix_runs(spark, sf_dir):
    return M.stored_order_summary(_stored_beta(spark, sf_dir, exact=True), ["run_name"])


def ground_truth(spark, sf_dir):
    """One row a query: ordered distinct ids of all its rows, raw cells joined."""
    gt = rows_of(spark, sf_dir, "gt_items").where("query is not null and trim(query) != ''")
    rows = gt.select("query", F.struct("gt_id", F.coalesce(F.trim("raw_page_ids"), F.lit("")).alias("raw"), split_ids(F.col("raw_page_ids")).alias("ids")).alias("r"))
    got = rows.groupBy("query").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    ids = F.array_distinct(F.flatten(F.transform("rs", lambda r: r["ids"])))
    raw = F.array_join(F.filter(F.transform("rs", lambda r: r["raw"]), lambda x: x != ""), "，")
    return got.select("query", raw.alias("raw_page_ids"), ids.alias("doc_ids")).where(F.size("doc_ids") > 0)


_GT = r"""sp AS (SELECT query, gt_id, coalesce(trim(raw_page_ids, ' '), '') AS raw, x.i AS i, regexp_replace(x.v, '^[ \x{3000}]+|[ \x{3000}]+$', '', 'g') AS id
      FROM gt_items, LATERAL (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT regexp_split_to_array(coalesce(raw_page_ids, ''), '[,，、;；\n\r\t]+') AS l)) x
      WHERE query IS NOT NULL AND trim(query, ' ') <> ''),
    f AS (SELECT query, id, min(gt_id * 1000000 + i) AS o FROM sp WHERE id <> '' GROUP BY query, id),
    gt AS (SELECT query, list(id ORDER BY o) AS doc_ids FROM f GROUP BY query),
    rw AS (SELECT query, string_agg(CASE WHEN raw <> '' THEN raw END, '，' ORDER BY gt_id) AS raw_page_ids FROM (SELECT DISTINCT query, gt_id, raw FROM sp) GROUP BY query)"""


@query(f"WITH {_GT} SELECT query, raw_page_ids, array_to_string(doc_ids, '|') AS doc_ids, CAST(len(doc_ids) AS INTEGER) AS label_count FROM gt JOIN rw USING (query)")
def ground_truth_merge(spark, sf_dir):
    gt = ground_truth(spark, sf_dir)
    return gt.select("query", "raw_page_ids", F.array_join("doc_ids", "|").alias("doc_ids"), F.size("doc_ids").alias("label_count"))


def _business_inputs(spark, sf_dir):
    """Recall lists stand-in: relevant doc ids of the examples as ground truth, predictions of the same query as recall."""
    e = rows_of(spark, sf_dir, "examples").where("query is not null and trim(query) != '' and doc_id is not null and labels >= 7")
    gt = e.groupBy("query").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    preds = predictions(spark, sf_dir).where("query is not null").select("query", "doc_id", "s", "sidx")
    return gt, preds


_BIN = f"""{PR}, tr AS (SELECT DISTINCT query, doc_id FROM examples WHERE query IS NOT NULL AND trim(query, ' ') <> '' AND doc_id IS NOT NULL AND labels >= 7),
    lc AS (SELECT query, count(*) AS label_count FROM tr GROUP BY query),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, sidx) AS rk FROM (SELECT query, doc_id, s, sidx FROM pr WHERE query IN (SELECT query FROM lc))),
    {_CUTS.format(k='query', betas='0.3')},
    fi AS (SELECT r.query, r.doc_id, min(rk) AS first FROM rk r JOIN tr USING (query, doc_id) GROUP BY ALL),
    sz AS (SELECT query, count(*) AS candidates FROM rk GROUP BY query),
    b0 AS (SELECT lc.query, label_count, coalesce(candidates, 0) AS candidates, coalesce(best_k, 0) AS best_k, coalesce(expected_fbeta, 0.0) AS expected_fbeta
      FROM lc LEFT JOIN sz USING (query) LEFT JOIN cut USING (query)),
    b1 AS (SELECT b0.*, count(first) FILTER (first <= label_count) AS hits, count(first) FILTER (first <= best_k) AS best_hits, min(first) AS ff,
      {', '.join(f'count(first) FILTER (first <= {k}) AS h{k}' for k in (1, 3, 5, 10))} FROM b0 LEFT JOIN fi USING (query) GROUP BY ALL),
    b2 AS (SELECT *, coalesce(best_hits / nullif(best_k, 0), 0.0) AS bp, best_hits / label_count AS br,
      {', '.join(f'coalesce(h{k} / nullif(least(candidates, {k}), 0), 0.0) AS p{k}, h{k} / label_count AS r{k}' for k in (1, 3, 5, 10))} FROM b1),
    bm AS (SELECT query, label_count, candidates, hits, round(hits / label_count, 6) AS accuracy, best_k, expected_fbeta, round(bp, 6) AS best_precision, round(br, 6) AS best_recall,
      round(CASE WHEN bp + br = 0 THEN 0.0 ELSE 2 * bp * br / (bp + br) END, 6) AS best_f1, CASE WHEN best_hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS best_hit_rate,
      round(coalesce(1.0 / ff, 0.0), 6) AS mrr,
      {', '.join(f'round(p{k}, 6) AS precision_{k}, round(r{k}, 6) AS recall_{k}, round(CASE WHEN p{k} + r{k} = 0 THEN 0.0 ELSE 2 * p{k} * r{k} / (p{k} + r{k}) END, 6) AS f1_{k}, CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_{k}' for k in (1, 3, 5, 10))}
      FROM b2)"""


@query(f"WITH {_BIN} SELECT * FROM bm")
def business_metrics(spark, sf_dir):
    return M.business(*_business_inputs(spark, sf_dir))


@query(f"""WITH {_BIN}, g AS (SELECT query, list(doc_id ORDER BY doc_id) AS ids FROM tr GROUP BY query),
           t AS (SELECT rk.query, list(doc_id ORDER BY rk) AS ids, string_agg(doc_id || ':' || printf('%.6f', s), '，' ORDER BY rk) AS sc FROM rk JOIN lc USING (query) WHERE rk <= label_count GROUP BY rk.query)
           SELECT g.query, coalesce(array_to_string(t.ids, '，'), '') AS top_ids, coalesce(sc, '') AS top_id_scores,
             coalesce(array_to_string(list_filter(t.ids, lambda x: list_contains(g.ids, x)), '，'), '') AS hit_ids,
             array_to_string(list_filter(g.ids, lambda x: NOT list_contains(coalesce(t.ids, []), x)), '，') AS missed_ids FROM g LEFT JOIN t ON g.query = t.query""")
def business_ids(spark, sf_dir):
    gt, preds = _business_inputs(spark, sf_dir)
    return M.business_ids(gt, preds)


_BNAMES = ["accuracy", "best_k", "expected_fbeta", "best_precision", "best_recall", "best_f1", "best_hit_rate", "mrr"]
_BNAMES += [f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("precision", "recall", "f1", "hit_rate")]


@query(f"""WITH {_exact(_BIN)} SELECT count(*) AS num_gt_queries, count(*) FILTER (candidates > 0) AS num_scored_queries, CAST(sum(candidates) AS BIGINT) AS num_scored_pairs,
           CAST(sum(label_count) AS BIGINT) AS total_gt_docs, CAST(sum(hits) AS BIGINT) AS total_hits, round(sum(hits) / sum(label_count), 6) AS micro_accuracy,
           {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in _BNAMES)} FROM bm""")
def business_summary(spark, sf_dir):
    return M.business_summary(M.business(*_business_inputs(spark, sf_dir), exact=True))


@query("""WITH q AS (SELECT DISTINCT query FROM gt_items WHERE query IS NOT NULL), r AS (SELECT DISTINCT query FROM predictions WHERE query IS NOT NULL)
          SELECT (SELECT count(*) FROM q JOIN r USING (query)) AS shared, (SELECT count(*) FROM q ANTI JOIN r USING (query)) AS only_truth,
                 (SELECT count(*) FROM r ANTI JOIN q USING (query)) AS only_recall""")
def recall_join_counts(spark, sf_dir):
    q = rows_of(spark, sf_dir, "gt_items").select("query", F.lit(1).alias("a")).where("query is not null").distinct()
    r = rows_of(spark, sf_dir, "predictions").select("query", F.lit(1).alias("b")).where("query is not null").distinct()
    j = q.join(r, "query", "full_outer")
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), n(F.col("b").isNull()).alias("only_truth"), n(F.col("a").isNull()).alias("only_recall"))


@query(f"""WITH {PR}, z AS (SELECT run_name, gk, exp(g) AS e, g, ln(least(greatest(s, 1e-6), 1 - 1e-6) / (1 - least(greatest(s, 1e-6), 1 - 1e-6))) AS y FROM pr),
           a AS (SELECT run_name, gk, count(*) AS n, sum(e) AS zt, sum(exp(y)) AS zq, sum(e * g) AS tx, sum(e * y) AS ty FROM z GROUP BY run_name, gk)
           SELECT run_name, gk, n, round(tx / zt - ln(zt) + ln(zq) - ty / zt, 6) AS kl, round(ln(zq) - ty / zt, 6) AS cross_entropy FROM a""")
def listwise_loss(spark, sf_dir):
    return M.listwise_loss(predictions(spark, sf_dir), KEYS)


