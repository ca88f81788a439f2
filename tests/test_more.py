import pytest
from pyspark.sql import functions as F

from rankloom.functions import ids
from rankloom.functions import text as X
from rankloom.plans import pipelines
from rankloom.sources import discovery


@pytest.mark.parametrize(
    ("value", "got"),
    [
        (None, []), ("", []), ("a, b,,c", ["a", "b", "c"]), ('["a", ["b", {"doc_id": "c"}]]', ["a", "b", "c"]), ('{"x": 1, "y": 0, "z": 0.5, "w": "high", "v": "0"}', ["x", "z", "w"]),
        ('{"id": null, "x": 1}', []), ("[broken", ["[broken"]), ("[1, 2.5, null]", ["1", "2.5"]), ("a;b", ["a;b"]),
    ],
)
def test_ids_in(value, got):
    assert list(ids.ids_in(value)) == got


def test_evidence_in():
    value = ["D1:2; D1:3,D2:1", {"dia_id": "D3:1", "turn_id": "D3:2"}, {"evidence": ["D4:1", 5]}, None]
    assert list(ids.evidence_in(value)) == ["D1:2", "D1:3", "D2:1", "D3:1", "D3:2", "D4:1", "5"]


def test_id_columns(spark):
    df = spark.createDataFrame([("a;b,a", '["x"]', ["i", "j"], [0.5, 0.25])], "e string, p string, i array<string>, s array<double>")
    r = df.select(ids.extract_evidence(F.col("e")).alias("e"), ids.positives([F.col("p"), F.col("e")]).alias("p"), ids.join_ids(F.col("i")).alias("j"), ids.id_scores(F.col("i"), F.col("s")).alias("s")).first()
    assert (r["e"], r["p"], r["j"], r["s"]) == (["a", "b"], ["x", "a;b", "a"], "i，j", "i:0.500000，j:0.250000")


def test_prompts_and_turns(spark):
    i, q, d, none = F.lit("I"), F.lit("q"), F.lit("d"), F.lit(None).cast("string")
    r = spark.range(1).select(
        X.prompt(F.lit(" I "), q, none).alias("pair"), X.chat_prompt(i, q, d).alias("chat"), X.chat_pair(i, q, d).alias("two"), X.pair_length(i, q, d).alias("n"),
        X.turn_doc(F.lit("s1"), none, F.lit("A"), F.lit("x  y"), F.lit("A"), F.lit("B")).alias("turn"), X.turn_doc(F.lit("s1"), none, none, F.lit(" ")).alias("none"),
    ).first()
    assert r["pair"] == "<Instruct>: I\n<Query>: q\n<Document>: " and r["n"] == len("<Instruct>: I\n<Query>: q\n<Document>: d")
    assert "<Instruct>: I\n\n<Query>: q\n\n<Document>: d<|im_end|>\n<|im_start|>assistant\n<think>" in r["chat"]
    assert r["two"]["query"].endswith("<Instruct>: I\n<Query>: q\n") and r["two"]["document"].startswith("<Document>: d<|im_end|>")
    assert r["turn"] == "session: s1, speaker: A, participants: A, B, text: x y" and r["none"] == ""


def test_discovery_and_cache(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "qrels").mkdir()
    for name in ("test.jsonl", "data/test-0.parquet", "qrels/test.tsv", "other.json"):
        (tmp_path / name).write_text("x")
    tail = lambda xs: [x.rsplit("/", 1)[-1] for x in xs]
    assert tail(discovery.split_files(spark, str(tmp_path), "test")) == ["test.jsonl", "test-0.parquet"]
    assert tail(discovery.qrels_files(spark, str(tmp_path))) == ["test.tsv"] and discovery.split_files(spark, str(tmp_path), "dev") == []
    made = []
    for model in ("m", "m", "n"):
        discovery.cached_table(spark, str(tmp_path / "cache"), {"model": model}, lambda: made.append(1) or spark.range(3))
    assert len(made) == 2


def test_predict_and_supervision(spark):
    corpus = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(["red car", "blue sky", "red sky at night", " "])], "doc_id string, text string")
    best = pipelines.predict(corpus.withColumnRenamed("text", "doc"), "red sky", 2).collect()
    assert [(r["rank"], r["doc_id"]) for r in best] == [(1, "d2"), (2, "d0")] or best[0]["doc_id"] == "d2"
    q = spark.createDataFrame([("d0", "car"), ("d1", "sky")], "qid string, query string")
    rows = pipelines.supervised_pairs(corpus, q, negatives=2).collect()
    assert {(r["qid"], r["doc_id"]) for r in rows if r["labels"] == 10.0} == {("d0", "d0"), ("d1", "d1")} and len(rows) == 6
    with pytest.raises(ValueError, match="qrels"):
        pipelines.supervised_pairs(corpus, q.withColumn("qid", F.lit("none")))
    qrels = spark.createDataFrame([("d0", "d2", 1.0), ("d0", "d1", 0.0)], "qid string, doc_id string, score double")
    only = pipelines.supervised_pairs(corpus, q, qrels, mode="positives_only").collect()
    assert [(r["qid"], r["doc_id"]) for r in only] == [("d0", "d2")]


def test_subset_and_candidates(spark):
    rows = [(i, f"g{i // 4}", "q" * 5, "d" * 10, 10.0 if i % 4 == 0 else 0.0, "") for i in range(40)] + [(99, "long", "q", "d" * 3000, 10.0, "I")]
    ex = spark.createDataFrame(rows, "source_index long, group_key string, query string, doc string, raw_label double, instruction string")
    got = pipelines.prepare_subset(ex, 0.2, max_docs=2, max_doc_chars=4)
    assert got.count() == 8 and got.select("group_key").distinct().count() == 4 and {len(r["doc"]) for r in got.collect()} == {4}
    assert pipelines.first_instruction(ex, "x") == "I"
    corpus = spark.createDataFrame([("1", "alpha beta"), ("2", "gamma")], "doc_id string, text string")
    queries = spark.createDataFrame([("a", "alpha"), ("b", "nothing relevant")], "qid string, query string")
    qrels = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 1.0), ("b", "9", 1.0)], "qid string, doc_id string, score double")
    c = pipelines.build_candidates(corpus, queries, qrels, ensure=True).collect()
    assert sorted((r["qid"], r["doc_id"], r["labels"]) for r in c) == [("a", "1", 10.0), ("a", "2", 10.0)]


def test_dense_by_tiles(spark, monkeypatch):
    import random

    from rankloom.operators import retrieval

    rnd = random.Random(3)
    rows = [(i, [float(rnd.choice([-1, 0, 1])) for _ in range(4)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = df.where("doc_id % 4 = 3").withColumnRenamed("doc_id", "qid")
    whole = sorted(map(tuple, retrieval.dense(df, q, 5, normalize=False).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 7)
    tiles = retrieval.dense(df, q, 5, normalize=False)
    assert sorted(map(tuple, tiles.collect())) == whole and "Cartesian" not in tiles._jdf.queryExecution().executedPlan().toString()
    vectors = dict(rows[:-1])
    for i in [i for i in vectors if i % 4 == 3]:
        want = sorted((-sum(a * b for a, b in zip(vectors[i], v)), j) for j, v in vectors.items() if j != i)[:5]
        assert [(-r[2], r[1]) for r in sorted(whole, key=lambda r: r[3]) if r[0] == i] == want
    assert retrieval.dense(df.limit(0), q, 5).count() == 0 and retrieval.dense(df, q.limit(0), 5).count() == 0
