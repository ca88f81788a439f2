import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.functions.scorers import model_scorer, register, score
from rankloom.plans import pipelines
from rankloom.sources import records as R
from rankloom.sources import sinks, tables
from rankloom.streaming import normalize


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '﻿{"a": 1}\n\n{"a": 2}\n')
    assert R.read_json_lines(spark, good).count() == 2
    bad = write(tmp_path / "b.jsonl", '{"a": 1}\n[1]\nnot json\n')
    with pytest.raises(Exception, match="not a JSON object"):
        R.read_json_lines(spark, bad).collect()
    assert R.read_json_lines(spark, bad, "drop").count() == 1 and R.read_json_lines(spark, bad, "any").count() == 2


def test_json_documents(spark, tmp_path):
    for i, (text, n) in enumerate([('[{"a":1}, 2, {"a":3}]', 2), ('{"records": [{"a":1}]}', 1), ('{"a": 1}', 1)]):
        assert R.read_json_document(spark, write(tmp_path / f"{i}.json", text)).count() == n
    assert R.read_json_document(spark, write(tmp_path / "v.json", '{"x": {"a":1}, "y": {"a":2}}'), values=True).count() == 2


def test_label_chain(spark, tmp_path):
    rows = [{"labels": None, "label": 1}, {"label": 0.7}, {"label": 7}, {"labels": 0.7}, {"score": "x"}, {"score": "3.5"}]
    path = write(tmp_path / "l.jsonl", "\n".join(json.dumps({"q": f"q{i}", "text": "t", **r}) for i, r in enumerate(rows)))
    got = {r["query"]: (r["raw_label"], r["label"]) for r in R.to_examples(R.read_json_lines(spark, path)).collect()}
    assert got == {"q1": (7.0, 0.7), "q2": (7.0, 0.7), "q3": (0.7, pytest.approx(0.07)), "q5": (3.5, 0.35)}


def test_examples(spark, tmp_path):
    text = '{"question":" q ","qid":"a","pid":7,"title":"T","abstract":"S","label":0.7}\n{"q":"q2","docid":"d3","text":"body","score":5}\n{"q":"","doc":"x","label":1}\n{"q":"x","doc":"","label":1}\n'
    got = {r["query"]: r for r in R.to_examples(R.read_json_lines(spark, write(tmp_path / "e.jsonl", text)), "I").collect()}
    assert got["q"]["doc"] == "title: T, abstract: S" and got["q"]["doc_id"] == "7" and got["q"]["group_key"] == "a" and got["q"]["instruction"] == "I"
    assert got["q2"]["group_key"] == "q2" and set(got) == {"q", "q2"}


def test_cells(spark):
    df = spark.createDataFrame([("a，b, a;；c\n", "12.0"), (None, "NaN"), ("", " x　")], "ids string, cell string")
    assert [r[0] for r in df.select(X.split_ids(F.col("ids"))).collect()] == [["a", "b", "c"], [], []]
    assert [r[0] for r in df.select(X.clean_cell(F.col("cell"))).collect()] == ["12", "", "x"]


def test_tokens_and_snippets(spark):
    df = spark.createDataFrame([("Ab1 中x文", "0123456789"), (None, "01234567")], "t string, s string")
    assert [r[0] for r in df.select(X.bm25_tokens(F.col("t"))).collect()] == [["ab1", "x", "中", "文", "中文"], []]
    assert [r[0] for r in df.select(X.snippet(F.col("s"), 8)).collect()] == ["01234...", "01234567"]


def test_ground_truth_and_recall(spark, tmp_path):
    gt = write(tmp_path / "gt.csv", '﻿query,PageId\nq1,"a，b"\nq1,"b;c"\nq2,\n')
    rows = {r["query"]: r for r in tables.merge_ground_truth(tables.read_ground_truth(spark, gt)).collect()}
    assert set(rows) == {"q1"} and rows["q1"]["doc_ids"] == ["a", "b", "c"] and rows["q1"]["raw_page_ids"] == "a，b，b;c"
    with pytest.raises(ValueError, match="lacks"):
        tables.read_ground_truth(spark, gt, ids="Nope")
    with pytest.raises(ValueError, match="CSV"):
        tables.read_ground_truth(spark, "x.xlsx")
    shapes = ['{"q1": [{"id": "a", "text": "x"}, {"id": "", "text": "y"}, {"id": "c", "text": "z"}]}', '[{"q": "q1", "items": [{"page_id": "a", "text": "x"}, {"PageId": "c", "doc": "z"}]}]', '[{"query": "q1", "doc_id": "a", "text": "x"}, {"query": "q1", "doc_id": "c", "text": "z"}]']
    for i, text in enumerate(shapes):
        got = tables.read_recall(spark, write(tmp_path / f"r{i}.json", text)).orderBy("source_rank").collect()
        assert [(r["query"], r["source_rank"], r["doc_id"]) for r in got] == [("q1", 1, "a"), ("q1", 2, "c")]
    per, summary = pipelines.evaluate_business(spark, gt, str(tmp_path / "r0.json"))
    assert per.count() == 1 and summary.first()["num_scored_pairs"] == 2


@pytest.mark.parametrize("text", ["query-id\tcorpus-id\tscore\nq\td\t2\n", "q d 2\n", "q 0 d 2\n", "qid,docid,relevance\nq,d,2\n"])
def test_qrels_forms(spark, tmp_path, text):
    got = tables.read_qrels(spark, write(tmp_path / "q.tsv", text)).collect()
    assert [(r["qid"], r["doc_id"], r["score"]) for r in got] == [("q", "d", 2.0)]


def test_qrels_merge(spark, tmp_path):
    text = "qid\tdocid\tscore\nq\ta\t0\nq\tb\tx\nq\tc\t1\nq\tc\t2\n"
    got = tables.merge_qrels(tables.read_qrels(spark, write(tmp_path / "q.tsv", text))).collect()
    assert {r["doc_id"]: r["score"] for r in got} == {"b": 1.0, "c": 2.0}


def test_dialogues(spark, tmp_path):
    sample = {"sample_id": "s1", "conversation": {"session_10": [{"speaker": "B", "text": "no  id"}], "session_2_date_time": "d2", "session_2": [{"speaker": "A", "dia_id": "D2:1", "text": "hi"}]}, "qa": [{"question": "who?", "evidence": ["D2:1"], "category": 1}]}
    recs = R.read_json_document(spark, write(tmp_path / "d.json", json.dumps([sample])))
    got = tables.read_dialogues(recs).orderBy("session_no").collect()
    assert [(r["session"], r["session_time"], r["dia_id"], r["said"]) for r in got] == [("session_2", "d2", "D2:1", "hi"), ("session_10", None, "session_10:1", "no id")]
    assert tables.read_dialogue_questions(recs).first()["evidence"] == '["D2:1"]'


def test_assignment_files(spark, tmp_path):
    a = R.read_assignment(spark, write(tmp_path / "a.json", '[{"query_id": "x", "split": "dev"}, {"index": 3, "split": "test"}]')).collect()
    assert {(r["key"], r["index"], r["split"]) for r in a} == {("x", None, "dev"), (None, 3, "test")}
    b = R.read_assignment(spark, write(tmp_path / "b.json", '{"train": [1, 2], "test": ["k"]}')).collect()
    assert {(r["key"], r["index"], r["split"]) for r in b} == {(None, 1, "train"), (None, 2, "train"), ("k", None, "test")}


def test_runs_and_metrics_files(spark, tmp_path):
    for run, text in (("d__m", '{"a": 1}\n'), ("d__n", "")):
        (tmp_path / run).mkdir()
        write(tmp_path / run / "predictions.jsonl", text)
        write(tmp_path / run / "metrics.json", text or "broken")
    assert [r["run_name"] for r in tables.discover_runs(spark, str(tmp_path)).collect()] == ["d__m"]
    assert [r["run_name"] for r in tables.collect_metrics(spark, f"{tmp_path}/*/metrics.json").collect()] == ["d__m"]


def test_split_kinds(spark, tmp_path):
    with pytest.raises(ValueError, match="mix"):
        tables.read_split(spark, ["a.parquet", "b.jsonl"])


def test_model_scorer_restores_order(spark):
    register("length", model_scorer(lambda: lambda texts: [len(t) for t in texts], batch_size=2))
    df = spark.createDataFrame([(i, "", "x" * n, "d") for i, n in enumerate([10, 1, 5])], "i int, instruction string, query string, doc string").coalesce(1)
    got = [r["score"] for r in score(df, "length").orderBy("i").collect()]
    assert got[0] - got[1] == 9 and got[2] - got[1] == 4
    with pytest.raises(ValueError, match="no scorer"):
        score(df, "nope")


def test_pipeline_and_sinks(spark, tmp_path):
    rows = [{"query": "red car", "query_id": "1", "doc": "a red car", "labels": 10}, {"query": "red car", "query_id": "1", "doc": "blue sky", "labels": 0}, {"query": "sky", "doc": "blue sky", "labels": 10}]
    path = write(tmp_path / "p.jsonl", "\n".join(map(json.dumps, rows)))
    preds = pipelines.score_examples(pipelines.load_examples(spark, path))
    assert preds.count() == 3
    out = pipelines.evaluate(preds)
    assert out["macro"].first()["ndcg_1"] == 1.0
    assert pipelines.split_examples(pipelines.load_examples(spark, path)).count() == 3
    sinks.write_json_lines(preds.select("query", "reason"), str(tmp_path / "j"))
    assert "reason" in spark.read.text(str(tmp_path / "j")).first()[0]
    sinks.write_csv(preds.select("query", F.array(F.lit(1)).alias("a")), str(tmp_path / "c"), ["query", "a", "none"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["query", "a", "none"]
    assert sinks.markdown_table(preds.select("query")).count("\n") == 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", '{"q": "x", "doc": "d", "label": 1}\nbroken\n')
    q = normalize.write_examples(normalize.example_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
