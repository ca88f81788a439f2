import json

import pytest

from rankloom.operators import metrics, sampling
from rankloom.plans import commands as C
from rankloom.sources import sinks
from rankloom.sources.records import to_examples, read_json_lines


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")


@pytest.fixture
def runs(tmp_path):
    rows = [
        {"query": "q1", "doc_id": "a", "score": 0.2, "rank": 1, "is_relevant": True},
        {"query": "q1", "doc_id": "b", "score": 0.9, "rank": 2, "is_relevant": False},
        {"query": "q1", "doc_id": "a", "score": 0.1, "rank": 3, "is_relevant": True},
        {"query": "q2", "doc_id": "c", "score": 0.5, "source_rank": 2, "is_relevant": True},
        {"query": "q2", "doc_id": "d", "score": 0.5, "source_rank": 1, "is_relevant": False},
        {"query": "", "doc_id": "x", "score": 1.0, "is_relevant": True},
    ]
    put(tmp_path / "d__m" / "predictions.jsonl", rows)
    put(tmp_path / "d__m" / "per_query_metrics.jsonl", [{"query": "q1", "正确标签数量": 4}, {"query": "q2", "num_gt_docs": "x"}])
    put(tmp_path / "d__n" / "predictions.jsonl", rows[:2])
    for run, figures in (("d__m", {"MAP": 0.5, "by": {"k": [1]}}), ("d__n", {"MRR": 0.25})):
        (tmp_path / run / "overall_metrics.json").write_text(json.dumps(figures))
    return str(tmp_path)


def test_recompute_beta(spark, runs):
    summary, per = C.recompute_beta(spark, runs, [1.0], ids=True)
    got = {(r["run_name"], r["query"]): r for r in per.collect()}
    q1, q2 = got["d__m", "q1"], got["d__m", "q2"]
    # stored order a, b, a; scores 0.2, 0.9, 0.1 become 0.125, 1, 0: F1 is expected best at 2
    assert (q1["best_k"], q1["true_count"], q1["recalled_relevant_count"], q1["hit_count"], q1["selected_ids"], q1["hit_ids"]) == (2, 4, 1, 1, "a，b", "a")
    assert q1["selected_id_scores"] == "a:0.200000，b:0.900000" and (q1["precision"], q1["recall"]) == (0.5, 0.25)
    # equal ranks and scores: the source's rank decides; all scores alike cut at 1
    assert (q2["best_k"], q2["true_count"], q2["selected_ids"], q2["hit_count"]) == (1, 1, "d", 0)
    s = {r["run_name"]: r for r in summary.collect()}
    assert s["d__m"]["num_queries"] == 2 and s["d__m"]["total_true_ids"] == 5 and s["d__m"]["micro_precision"] == round(1 / 3, 6) and s["d__n"]["num_queries"] == 1


def test_summarize(spark, runs):
    got = {r["run_name"]: r.asDict() for r in C.summarize(spark, runs).collect()}
    assert got["d__m"]["dataset"] == "d" and got["d__m"]["model"] == "m" and float(got["d__m"]["MAP"]) == 0.5 and got["d__m"]["by"] == '{"k":[1]}' and got["d__m"]["MRR"] is None


def test_compare_and_diagnose(spark):
    schema = "key string, ndcg_10 double, mrr double, ap double, best_positive_rank long"
    a = spark.createDataFrame([("x", 0.9, 1.0, 1.0, 1), ("y", 0.8, 0.5, 0.5, 2), ("z", 0.1, 0.1, 0.1, 9)], schema)
    b = spark.createDataFrame([("x", 0.3, 0.2, 0.2, 5), ("y", 0.1, 0.1, 0.1, 0), ("w", 0.1, 0.1, 0.1, 9)], schema)
    got = C.compare(a, b, "key")
    assert [r["key"] for r in got["cases"].collect()] == ["y", "x"]
    s = got["summary"].first()
    assert (s["shared"], s["only_better"], s["only_worse"]) == (2, 1, 1)
    rows = spark.createDataFrame([("r", "q", "d1", 1.0, 0.1, 1, 1.0, 1, 1), ("r", "q", "d2", 0.0, 0.9, 2, 0.5, 2, 1)], "run string, gk string, doc_id string, g double, s double, sidx long, retrieval_score double, retrieval_rank int, true_relevant_count long")
    out = C.diagnose(rows, rows, ["run", "gk"], ["run"])
    assert out["suggestions"].first()["suggestions"] == "inverted scores rank better; positives have lower scores than negatives"
    assert C.diagnose(rows, None, ["run", "gk"], ["run"]).keys() == {"candidates"}


def test_raw_label(spark):
    texts = ['{"labels": 3, "label": 0.5}', '{"raw_label": "4"}', '{"label": 0.7}', '{"label": 7}', '{"labels": null, "label": 1}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("parse_json(t) record")
    assert [round(r[0], 6) for r in df.select(C.raw_label_of()).collect()] == [3.0, 4.0, 7.0, 7.0, 0.0, 0.0]


def brute_listwise(group, t, low, strategy, by_label, max_pos, max_neg):
    rows = sorted(group, key=lambda r: (-r[1], r[0])) if by_label else sorted(group)
    best = max(rows, key=lambda r: (r[1], -r[0]))
    pos = [r for r in rows if r[1] >= t] if strategy != "top1" else [best]
    pos = pos or ([best] if strategy == "threshold_or_top1" else [])
    neg = [r for r in rows if r not in pos and r[1] < low] or [r for r in rows if r not in pos]
    return (pos[: max_pos or None], neg[: max_neg or None]) if len(rows) >= 2 and pos and neg else ([], [])


@pytest.mark.parametrize("strategy", sampling.STRATEGIES)
@pytest.mark.parametrize("low", [None, 0.3, 0.9])
def test_listwise_strategies(spark, strategy, low):
    import random

    rnd = random.Random(f"{strategy}{low}")
    rows = [(f"g{rnd.randint(0, 12)}", i, rnd.choice([0.0, 0.2, 0.3, 0.7, 0.8, 1.0])) for i in range(60)] + [("one", 100, 1.0), ("high", 101, 1.0), ("high", 102, 0.9)]
    df = spark.createDataFrame(rows, "k string, sidx long, g double")
    for by_label in (False, True):
        got = sampling.listwise_export(df, "k", strategy=strategy, negative_threshold=low, by_label=by_label, max_pos=2, max_neg=3).collect()
        want = set()
        for k in {r[0] for r in rows}:
            sides = brute_listwise([r[1:] for r in rows if r[0] == k], 0.7, 0.7 if low is None else low, strategy, by_label, 2, 3)
            want |= {(k, r[0], side, i + 1) for side, chosen in zip(("positive", "negative"), sides) for i, r in enumerate(chosen)}
        assert {(r["k"], r["sidx"], r["side"], r["place"]) for r in got} == want
    stats = sampling.listwise_stats(df, "k", strategy=strategy, negative_threshold=low).first()
    assert stats["skipped_small_groups"] >= 1 and sum(stats[c] for c in ("num_exported_groups", "skipped_small_groups", "skipped_no_positive", "skipped_no_negative")) == stats["num_query_groups"]


def test_export_messages(spark, tmp_path):
    put(tmp_path / "x.jsonl", [{"instruction": "rank", "query": "q", "query_id": "1", "doc": " d1 ", "labels": 9}, {"query": "q", "query_id": "1", "doc": "d2", "labels": 1}, {"query": "z", "doc": "only", "labels": 9}])
    rows, stats = C.export_listwise(to_examples(read_json_lines(spark, str(tmp_path / "x.jsonl"))))
    r = rows.first()
    assert [m.asDict() for m in r["messages"]] == [{"role": "system", "content": "rank"}, {"role": "user", "content": "q"}]
    assert [[m["content"] for m in x] for x in r["positive_messages"]] == [["d1"]] and [[m["content"] for m in x] for x in r["negative_messages"]] == [["d2"]]
    assert stats.first()["skipped_small_groups"] == 1 and rows.count() == 1


def test_inspect(spark, tmp_path):
    put(tmp_path / "corpus.jsonl", [{"_id": str(i), "text": "t"} for i in range(4)])
    put(tmp_path / "queries.jsonl", [{"id": "0", "text": "q"}, {"id": "9", "text": "q", "positive_doc_ids": ["1"]}, {"text": "no id"}])
    (tmp_path / "qrels.tsv").write_text("qid\tpid\tscore\n0\t1\t1\n0\t2\t1\n9\t1\t0\n")
    got = C.inspect(spark, str(tmp_path))
    assert (got["num_corpus_rows"], got["num_query_rows"], got["qrels_query_count"], got["positive_field_queries"], got["id_match_overlap_queries"]) == (4, 3, 1, 1, 1)
    assert got["recommended_supervision_strategy"] == "explicit" and not C.inspect(spark, str(tmp_path / "nothing"))["ok"]


def test_prepare_dialogues(spark, tmp_path):
    turns = [{"speaker": "A", "dia_id": f"D1:{i}", "text": t} for i, t in enumerate(["I like red apples", "we went by train", "the dog barks"])]
    sample = {"sample_id": "s1", "conversation": {"session_1": turns, "session_1_date_time": "May"}, "qa": [{"question": "which apples?", "evidence": ["D1:0"]}, {"question": "", "evidence": ["D1:0"]}, {"question": "who?", "evidence": ["D9:9"]}]}
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    rows, totals = C.prepare_dialogues(spark, str(tmp_path / "d.json"), 2)
    best = rows.orderBy("retrieval_rank").first()
    assert best["doc_id"] == "s1::D1:0" and best["labels"] == 10.0 and best["qid"] == "s1:0"
    assert totals.first()["num_queries"] == 1 and totals.first()["candidate_recall"] == 1.0


def test_written_figures_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("文", 1)], "a string, n int")
    sinks.write_json_figures(df, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8")) == {"a": "文", "n": 1}
    C.write_report(df, str(tmp_path / "r.md"), "Cases")
    assert (tmp_path / "r.md").read_text(encoding="utf-8").startswith("# Cases\n\n| a | n |\n")
    sinks.write_csv(df, str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa,n")


def test_business_ids(spark):
    gt = spark.createDataFrame([("q", ["a", "b"]), ("z", ["c"])], "query string, doc_ids array<string>")
    preds = spark.createDataFrame([("q", "x", 0.9, 1), ("q", "b", 0.8, 2), ("q", "a", 0.1, 3)], "query string, doc_id string, s double, sidx long")
    got = {r["query"]: tuple(r)[1:] for r in metrics.business_ids(gt, preds).collect()}
    assert got == {"q": ("x，b", "x:0.900000，b:0.800000", "b", "a"), "z": ("", "", "", "c")}
