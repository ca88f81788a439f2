import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scalar as S
from rankloom.operators import analysis as A
from rankloom.operators import metrics as M
from rankloom.operators.rank import average_rank, ranked


def frame(spark, groups):
    """groups: name -> list of (score, label)."""
    rows = [(k, float(s), float(g), i, f"d{i}", 0) for k, xs in groups.items() for i, (s, g) in enumerate(xs)]
    return spark.createDataFrame(rows, "k string, s double, g double, sidx long, doc_id string, true_relevant_count long")


def one(df):
    return df.first().asDict()


def test_ties_go_by_input_order(spark):
    r = one(M.per_query(frame(spark, {"a": [(0.5, 0), (0.5, 1)]}), ["k"]))
    assert (r["mrr"], r["ap"], r["ndcg_1"], r["ndcg_3"]) == (0.5, 0.5, 0.0, 0.63093)


def test_no_positives(spark):
    r = one(M.per_query(frame(spark, {"a": [(0.5, 0), (0.4, 0)]}), ["k"]))
    assert [r[c] for c in ("ap", "mrr", "ndcg_1", "ndcg_3", "ndcg_10", "recall_1", "recall_3", "recall_5")] == [0.0] * 8


def test_constant_scores(spark):
    df = frame(spark, {"a": [(0.3, 1), (0.3, 0), (0.3, 1)]})
    rows = M.dynamic_beta(df, ["k"]).collect()
    assert {r["best_k"] for r in rows} == {1} and {r["expected_fbeta"] for r in rows} == {0.0}
    p = one(M.pointwise(df))
    assert p["pearson"] == 0.0 and p["spearman"] == 0.0


def test_perfect_and_reversed(spark):
    xs = [(1 - i / 10, 1.0 if i < 3 else 0.0) for i in range(8)]
    df = frame(spark, {"a": xs})
    assert one(M.per_query(df, ["k"]))["ndcg_10"] == 1.0
    inv = one(M.inverted(df, ["k"], ["k"]))
    back = one(M.per_query(frame(spark, {"a": [(-s, g) for s, g in xs]}), ["k"]))
    assert inv["inverted_ndcg_10"] == back["ndcg_10"] and inv["inverted_mrr"] == back["mrr"]


def reference(xs, threshold=0.7):
    """Plain-Python figures of one group."""
    order = sorted(range(len(xs)), key=lambda i: (-xs[i][0], i))
    g = [xs[i][1] for i in order]
    rel = [x >= threshold for x in g]
    dcg = lambda v, k: sum(x / math.log2(i + 2) for i, x in enumerate(v[:k]))
    best = sorted(g, reverse=True)
    hits, ap = 0, 0.0
    for i, x in enumerate(rel):
        if x:
            hits += 1
            ap += hits / (i + 1)
    out = {"n": len(xs), "relevant": hits, "ap": ap / hits if hits else 0.0, "mrr": 1 / (rel.index(True) + 1) if hits else 0.0}
    out |= {f"ndcg_{k}": dcg(g, k) / dcg(best, k) if dcg(best, k) > 0 else 0.0 for k in (1, 3, 10)}
    return out | {f"recall_{k}": sum(rel[:k]) / hits if hits else 0.0 for k in (1, 3, 5)}


def test_against_plain_python_with_a_hot_group(spark):
    rnd = random.Random(5)
    groups = {f"q{i}": [(round(rnd.random(), 1), rnd.choice([0, 0, 0.35, 0.7, 1])) for _ in range(rnd.randint(1, 20))] for i in range(40)}
    groups["hot"] = [(round(rnd.random(), 3), rnd.choice([0, 0, 0.35, 0.7, 1])) for _ in range(3000)]
    got = {r["k"]: r.asDict() for r in M.per_query(frame(spark, groups), ["k"]).collect()}
    for k, xs in groups.items():
        for name, v in reference(xs).items():
            assert got[k][name] == pytest.approx(v, abs=2e-6), (k, name)


def test_bands_change_nothing(spark):
    rnd = random.Random(6)
    df = frame(spark, {"a": [(rnd.choice([0.1, 0.2, 0.9]), rnd.random()) for _ in range(200)], "b": [(0.5, 1)] * 50})
    runs = [sorted(map(tuple, ranked(df, ["k"], "s", "sidx", {"g": F.col("g")}, bands=b).select("k", "sidx", "rk", F.round("cum_g", 9)).collect())) for b in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (2.0,)], "v double")
    assert sorted(map(tuple, average_rank(df, [], "v", "r").collect())) == [(1.0, 1.0), (2.0, 3.0), (2.0, 3.0), (2.0, 3.0), (3.0, 5.0)]


def test_business_counts_queries_without_predictions(spark):
    gt = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c"])], "query string, doc_ids array<string>")
    preds = spark.createDataFrame([("q1", "a", 0.9, 1), ("q1", "a", 0.8, 2), ("q1", "x", 0.1, 3), ("zz", "a", 0.5, 1)], "query string, doc_id string, s double, sidx long")
    rows = {r["query"]: r.asDict() for r in M.business(gt, preds).collect()}
    assert rows["q2"]["candidates"] == 0 and rows["q2"]["mrr"] == 0.0 and rows["q2"]["precision_1"] == 0.0
    # the same relevant id twice in the first two places: one hit, precision over the rows
    assert rows["q1"]["hits"] == 1 and rows["q1"]["accuracy"] == 0.5 and rows["q1"]["precision_3"] == pytest.approx(1 / 3, abs=1e-6)
    s = one(M.business_summary(M.business(gt, preds, exact=True)))
    assert (s["num_gt_queries"], s["num_scored_queries"], s["avg_accuracy"]) == (2, 1, 0.25)


def test_listwise_loss(spark):
    xs = [(0.9, 1.0), (0.2, 0.35), (0.4, 0.0)]
    t = [math.exp(g) for _, g in xs]
    q = [s / (1 - s) for s, _ in xs]
    t, q = [x / sum(t) for x in t], [x / sum(q) for x in q]
    kl = sum(a * (math.log(a) - math.log(b)) for a, b in zip(t, q))
    assert one(M.listwise_loss(frame(spark, {"a": xs}), ["k"]))["kl"] == pytest.approx(kl, abs=1e-6)


def test_empty_tables(spark):
    df = frame(spark, {"a": [(1, 1)]}).limit(0)
    assert M.per_query(df, ["k"]).count() == 0 and M.dynamic_beta(df, ["k"]).count() == 0
    assert one(M.macro(M.per_query(df, ["k"]), []))["map"] == 0.0
    assert one(M.pointwise(df))["bce"] == 0.0


def test_bad_case_reasons(spark):
    df = frame(spark, {"a": [(0.5, 0.0)]}).withColumn("true_relevant_count", F.lit(2).cast("long"))
    r = one(A.query_summary(df, ["k"]))
    assert r["bad_reasons"] == "first_stage_miss,ndcg@10<0.5,best_positive_rank>10" and r["first_stage_miss"]


def test_scores(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.25,)], "x double")
    assert [r[0] for r in df.select(S.sanitize_score(F.col("x"))).collect()] == [0.0, 1.0, 0.0, 0.0, 0.25]
    row = spark.range(1).select(S.sigmoid(F.lit(-1000.0)), S.sigmoid(F.lit(0.0)), S.sigmoid(F.lit(1000.0)), S.yes_no_score(F.lit(-0.1), F.lit(-2.1)), S.yes_no_score(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()
    assert row[0] < 1e-300 and row[1] == 0.5 and row[2] == 1.0 and row[3] > 0.8 and row[4] == 0.5


def test_enrichment_first_and_merge_last(spark):
    p = spark.createDataFrame([(1, "g", "d", None), (2, "g", "e", "own"), (3, "h", "d", "")], "pid long, grp string, doc_id string, note string")
    m = spark.createDataFrame([("g", "d", 1, "first"), ("g", "d", 2, "last"), ("g", "e", 3, "other")], "grp string, doc_id string, i long, note string")
    first = {r["pid"]: (r["note"], r["matched"]) for r in A.enrich(p, m, "grp", ["doc_id"], ["note"], "i", "pid").collect()}
    assert first == {1: ("first", True), 2: ("own", True), 3: (None, False)}
    last = {r["pid"]: r["note"] for r in A.merge_last(p, m, ["grp", "doc_id"], ["note"], "i").collect()}
    assert last[1] == "last" and last[2] == "own"
