import pytest
from pyspark.sql import functions as F

from rankloom.operators import sampling as P
from rankloom.operators.retrieval import bm25, labelled


@pytest.mark.parametrize(("n", "sizes"), [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (25, (21, 2, 2))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.concat(F.lit("g"), "id").alias("k"))
    got = {r["split"]: r["num_groups"] for r in P.split_info(P.group_split(df, "k")).collect()}
    assert tuple(got.get(s, 0) for s in ("train", "dev", "test")) == sizes


def test_sample_includes_the_crossing_group(spark):
    df = spark.createDataFrame([(k, i) for k in "abc" for i in range(4)], "k string, i int")
    got = P.sample_groups(df, "k", 5)
    assert got.count() == 8 and got.select("k").distinct().count() == 2
    assert P.sample_groups(df, "k", 1000).count() == 12 and P.sample_groups(df.limit(0), "k", 5).count() == 0


def test_cap_keeps_relevant(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("a", 3, True)], "k string, r int, rel boolean")
    assert sorted(r["r"] for r in P.cap_groups(df, "k", 1, [F.col("r")], F.col("rel")).collect()) == [1, 3]


def test_first_groups(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4), ("c", 5)], "k string, i int")
    assert sorted(r["i"] for r in P.first_groups(df, "k", 3, "i").collect()) == [1, 2, 3, 4]


def test_modal_value_first_seen(spark):
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(["b", "a", "a", "b", None, " "])], "k string, v string, i int")
    assert P.modal_value(df, "k", "v", "i").collect()[0]["v"] == "b"


def test_lpt(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "k string, n long")
    load = P.lpt_shards(df, "k", "n", 2).groupBy("shard").agg(F.sum("n").alias("n"))
    assert sorted(r["n"] for r in load.collect()) == [7, 8]


def test_lpt_query_has_eight_shards(spark, tmp_path):
    from rankloom.queries.sampling import lpt_shards

    spark.createDataFrame([(f"o{i}",) for i in range(40)], "origin_id string").write.parquet(str(tmp_path / "documents.parquet"))
    load = lpt_shards(spark, str(tmp_path)).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert sorted((r["shard"], r["n"]) for r in load) == [(i, 5) for i in range(8)]


def test_packed_batches():
    assert list(P.packed_batches([4, 4, 4], 2, 8)) == [[0, 1], [2]]
    assert list(P.packed_batches([4, 4, 4], 3, 0)) == [[0, 1, 2]]
    assert list(P.packed_batches([99], 3, 8)) == [[0]] and list(P.packed_batches([], 3, 8)) == []


def test_negatives(spark):
    q = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    docs = spark.range(12).select(F.concat(F.lit("d"), "id").alias("doc_id"))
    pos = spark.createDataFrame([("q1", f"d{i}") for i in range(8)], "qid string, doc_id string")
    got = P.random_negatives(q, pos, docs, 3).collect()
    mine = {(r["qid"], r["doc_id"]) for r in got}
    assert len(mine) == 6 and not any(d in {f"d{i}" for i in range(8)} for k, d in mine if k == "q1")
    few = P.random_negatives(q, pos, docs, 50).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in few} == {"q1": 4, "q2": 12}


def test_assignment_priority(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "c", None)], "source_index long, group_key string, query string")
    assigned = spark.createDataFrame([("a", "test"), ("a", "dev"), ("y", "test"), (None, "dev")], "key string, split string")
    got = {r["source_index"]: r["split"] for r in P.split_from_assignment(rows, assigned).collect()}
    assert got == {1: "dev", 2: "test", 3: "train", 4: "train"}


def test_bm25_without_overlap_and_missed_positives(spark):
    corpus = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "beta"), (2, "unseen"), (3, None)], "qid long, query string")
    got = bm25(corpus, "text", q, "query", 5)
    assert sorted((r["qid"], r["doc_id"], r["rank"]) for r in got.collect()) == [(1, 1, 2), (1, 2, 1)]
    pos = spark.createDataFrame([(1, 1), (1, 4)], "qid long, doc_id long")
    rows = {r["doc_id"]: r for r in labelled(got, pos, "bm25", "bm25", ensure=True).collect()}
    assert rows[4]["retrieval_rank"] == 3 and rows[4]["retrieval_score"] == 0.0 and rows[4]["reason"] == "bm25_missed_positive_added"
    assert rows[1]["labels"] == 10.0 and rows[2]["labels"] == 0.0 and rows[1]["true_relevant_count"] == 2
