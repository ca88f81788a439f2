import json

import pytest

from rankloom.operators import sampling
from rankloom.sources import records as R
from rankloom.sources import tables
from rankloom.sources.order import with_dense_index


def lines(path, tag, n, pad=0):
    path.write_text("".join(json.dumps({"id": f"{tag}{i}", "pad": "x" * pad}) + "\n" for i in range(n)), encoding="utf-8")
    return str(path)


def ids(df):
    return [r[0] for r in df.orderBy("source_index").selectExpr("variant_get(record, '$.id', 'string')").collect()]


def test_order_of_files_and_lines(spark, tmp_path):
    """The small file comes first, though Spark reads the large one first; a file of several blocks stays in order."""
    a, b = lines(tmp_path / "a.jsonl", "a", 2), lines(tmp_path / "b.jsonl", "b", 3, 4000)
    assert ids(R.read_json_lines(spark, str(tmp_path))) == ["a0", "a1", "b0", "b1", "b2"]
    assert ids(R.read_json_lines(spark, [b, a])) == ["b0", "b1", "b2", "a0", "a1"]
    c = lines(tmp_path / "c.jsonl", "c", 300, 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = R.read_json_lines(spark, [c, a])
        assert got.rdd.getNumPartitions() > 3 and ids(got) == [*(f"c{i}" for i in range(300)), "a0", "a1"]
        dense = with_dense_index(got).orderBy("index").select("index", "source_index").collect()
        assert [r["index"] for r in dense] == list(range(302)) and dense == sorted(dense, key=lambda r: r["source_index"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_splits_of_documents_and_lines(spark, tmp_path):
    rows = [{"id": f"d{i}", "text": "t"} for i in range(3)]
    (tmp_path / "corpus.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "corpus-1.json").write_text(json.dumps({"x": {"id": "e0"}, "y": 5, "z": {"id": "e1"}}))
    tail = lines(tmp_path / "corpus.jsonl", "l", 2)
    got = tables.read_split(spark, [str(tmp_path / "corpus.json"), str(tmp_path / "corpus-1.json"), tail])
    assert ids(got) == ["d0", "d1", "d2", "e0", "e1", "l0", "l1"]
    with pytest.raises(ValueError, match="csv"):
        tables.read_split(spark, ["corpus.csv"])


def test_zero_is_an_id_as_text_only(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("qid\tpid\tscore\n0\t0\t1\nq\t0\t2\n\td\t1\n")
    got = tables.read_qrels(spark, str(tmp_path / "q.tsv")).orderBy("source_index").collect()
    assert [(r["qid"], r["doc_id"], r["score"]) for r in got] == [("0", "0", 1.0), ("q", "0", 2.0)]
    spark.createDataFrame([(0, "0", 1.0), (7, "0", 1.0)], "qid long, doc_id string, score double").write.parquet(str(tmp_path / "q.parquet"))
    assert [(r["qid"], r["doc_id"]) for r in tables.read_qrels(spark, str(tmp_path / "q.parquet")).collect()] == [("7", "0")]
    recs = spark.createDataFrame([('{"a": 0, "b": "0"}',), ('{"a": "  ", "b": false, "c": 0.0, "d": "x"}',)], "t string").selectExpr("parse_json(t) record")
    assert [r[0] for r in recs.select(R.first_filled("record", ("a", "b", "c", "d"))).collect()] == ["0", "x"]


def test_split_by_row_number(spark, tmp_path):
    rows = spark.createDataFrame([(10 * i, i, f"g{i}", f"q{i}") for i in range(5)], "source_index long, index long, group_key string, query string")
    (tmp_path / "s.json").write_text('{"dev": [1, 2], "test": ["g4", "q2"]}')
    got = sampling.split_from_assignment(rows, R.read_assignment(spark, str(tmp_path / "s.json")))
    assert {r["source_index"]: r["split"] for r in got.collect()} == {0: "train", 10: "dev", 20: "dev", 30: "train", 40: "test"}


def test_capped_groups_keep_what_they_must(spark):
    df = spark.range(40).selectExpr("id", "id % 2 g", "id >= 36 must")
    from pyspark.sql import functions as F

    got = sampling.cap_groups(df, "g", 3, [F.col("id")], F.col("must"))
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4, 5, 36, 37, 38, 39]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
