"""Whole commands as compositions of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scorers import score
from ..functions.text import pair_length, truncate
from ..operators import analysis, metrics, retrieval, sampling
from ..operators.rank import ranked
from ..sources.records import read_json_document, read_json_lines, to_examples
from ..sources.tables import merge_ground_truth, merge_qrels, read_ground_truth, read_qrels, read_recall


def load_examples(spark: SparkSession, path: str, instruction: str = "", require_label: bool = True) -> DataFrame:
    """Examples of a JSON lines or JSON file."""
    records = read_json_lines(spark, path) if path.endswith(".jsonl") else read_json_document(spark, path)
    return to_examples(records, instruction, require_label)


def score_examples(examples: DataFrame, scorer: str = "lexical") -> DataFrame:
    """Predictions: examples with score, g, s and sidx as the metrics read them, ranks included."""
    p = score(examples, scorer).withColumns({"g": F.col("label"), "s": F.col("score"), "sidx": F.col("source_index")})
    p = ranked(p, ["group_key"], "s", "sidx").drop("n", "s_min", "s_max").withColumnRenamed("rk", "rank_by_score")
    return ranked(p, ["group_key"], "g", "sidx").drop("n", "s_min", "s_max").withColumnRenamed("rk", "rank_by_label")


def evaluate(predictions: DataFrame, keys: Sequence[str] = ("group_key",)) -> dict[str, DataFrame]:
    """Per-query, macro, inverted and pointwise metrics of predictions (g, s, sidx)."""
    keys = list(keys)
    exact = metrics.per_query(predictions, keys, exact=True)
    return {
        "per_query": metrics.per_query(predictions, keys),
        "macro": metrics.macro(exact, []),
        "inverted": metrics.inverted(predictions, keys, []),
        "pointwise": metrics.pointwise(predictions),
    }


def evaluate_business(spark: SparkSession, truth_csv: str, recall_json: str, scorer: str = "lexical") -> tuple[DataFrame, DataFrame]:
    """(per query, summary) of recall lists scored against a ground-truth table."""
    gt = merge_ground_truth(read_ground_truth(spark, truth_csv))
    recall = read_recall(spark, recall_json).join(gt.select("query"), "query", "left_semi").withColumn("instruction", F.lit(""))
    preds = score(recall, scorer).select("query", "doc_id", F.col("score").alias("s"), F.col("source_rank").alias("sidx"))
    return metrics.business(gt, preds), metrics.business_summary(metrics.business(gt, preds, exact=True))


def build_candidates(corpus: DataFrame, queries: DataFrame, qrels_path: str | DataFrame, k: int = 100, ensure: bool = False) -> DataFrame:
    """BM25 candidate lists of the queries that have a positive in the corpus.

    corpus has doc_id and text, queries qid and query; qrels are a file or (qid, doc_id, score).
    """
    qrels = merge_qrels(read_qrels(corpus.sparkSession, qrels_path)) if isinstance(qrels_path, str) else qrels_path.where("score > 0")
    positives = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id")
    eligible = queries.where("trim(query) != ''").join(positives.select("qid").distinct(), "qid", "left_semi")
    found = retrieval.bm25(corpus, "text", eligible, "query", k)
    return retrieval.labelled(found, positives, "bm25", "bm25", ensure)


def split_examples(examples: DataFrame, eval_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Examples with the split of their group."""
    splits = sampling.group_split(examples.select("group_key"), "group_key", eval_ratio, test_ratio, seed)
    return examples.join(splits.select("group_key", "split"), "group_key")


def analyse(predictions: DataFrame, keys: Sequence[str], category: str, worst: int = 30) -> dict[str, DataFrame]:
    """Query summary, categories and the report of the worst cases; the category is a column of the keys."""
    summary = analysis.query_summary(predictions, list(keys))
    return {"summary": summary, "categories": analysis.category_summary(summary, category), "worst": analysis.bad_cases(summary, worst)}


def predict(docs: DataFrame, query: str, k: int, scorer: str = "lexical", instruction: str = "") -> DataFrame:
    """(rank, doc_id, doc, score) of the k best documents for one query; docs has doc_id and doc, blank docs are left out."""
    rows = docs.where("trim(doc) != ''").withColumns({"instruction": F.lit(instruction), "query": F.lit(query)})
    best = score(rows, scorer).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "doc", "score")  # k rows


def prepare_subset(
    examples: DataFrame, ratio: float = 0.1, max_pair_chars: int = 2048, max_docs: int = 0, max_doc_chars: int = 0, threshold: float = 7.0, seed: int = 42
) -> DataFrame:
    """Tenth of the examples in whole groups: pairs within the length, capped groups with all positives, groups with one.

    The target is a share of all rows that came in, not of those left after the filters.
    """
    target = int(examples.agg(F.greatest(F.bround(F.count(F.lit(1)) * min(1.0, max(0.0, ratio))), F.lit(1))).first()[0])
    rows = examples.where(pair_length(F.col("instruction"), F.col("query"), F.col("doc")) <= max_pair_chars) if max_pair_chars else examples
    if max_doc_chars:
        rows = rows.withColumn("doc_truncated", F.length("doc") > max_doc_chars).withColumn("doc", truncate(F.col("doc"), max_doc_chars))
    if max_docs:
        rows = sampling.cap_groups(rows, "group_key", max_docs, [F.col("source_index")], F.col("raw_label") >= threshold)
    kept = rows.where(F.col("raw_label") >= threshold).select("group_key").distinct()
    chosen = sampling.sample_groups(rows.join(kept, "group_key", "left_semi"), "group_key", target, seed)
    count = chosen.groupBy("group_key").agg(F.count(F.lit(1)).alias("candidate_count"), F.sum((F.col("raw_label") >= threshold).cast("long")).alias("candidate_relevant_count"))
    return chosen.join(count, "group_key")


def supervised_pairs(
    corpus: DataFrame, queries: DataFrame, qrels: DataFrame | None = None, mode: str = "random", negatives: int = 15, max_docs: int = 32, min_match: float = 0.8, seed: int = 42
) -> DataFrame:
    """(qid, query, doc_id, doc, labels, reason): positives and sampled negatives of each query, at most max_docs a query.

    Without qrels a query's positive is the document of the same id, if at least min_match of the queries have one;
    mode is "random" or "positives_only".  Positives come first when a query has more than max_docs.
    """
    q = queries.where("trim(query) != ''").select("qid", "query")
    if qrels is None:
        same = q.select("qid").join(corpus.select(F.col("doc_id").alias("qid")), "qid", "left_semi")
        n, m = q.count(), same.count()
        if not n or m / n < min_match:
            raise ValueError(f"{m} of {n} queries have a document of the same id; qrels are needed")
        pos = same.select("qid", F.col("qid").alias("doc_id"))
    else:
        pos = qrels.where("score > 0").select("qid", "doc_id").join(corpus.select("doc_id"), "doc_id", "left_semi").join(q.select("qid"), "qid", "left_semi")
    rows = pos.distinct().select("qid", "doc_id", F.lit(10.0).alias("labels"), F.lit("positive").alias("reason"), F.lit(0).alias("_o"))
    if mode == "random":
        neg = sampling.random_negatives(q.join(pos.select("qid"), "qid", "left_semi"), pos, corpus, negatives, seed)
        rows = rows.unionByName(neg.select("qid", "doc_id", F.lit(0.0).alias("labels"), F.lit("random_negative").alias("reason"), F.lit(1).alias("_o")))
    rows = sampling.cap_groups(rows, "qid", max_docs, [F.col("_o"), retrieval.hash_order(seed, F.col("doc_id"))]).drop("_o")
    return rows.join(q, "qid").join(corpus.select("doc_id", F.col("text").alias("doc")), "doc_id").select("qid", "query", "doc_id", "doc", "labels", "reason")


def split_files(examples: DataFrame, path: str, **ratios: float) -> None:
    """One folder of JSON lines for each split."""
    split_examples(examples, **ratios).write.option("ignoreNullFields", "false").partitionBy("split").json(path)


def first_instruction(examples: DataFrame, default: str = "") -> str:
    """The first instruction that isn't blank."""
    got = examples.where("trim(instruction) != ''").agg(F.min_by("instruction", "source_index")).first()[0]
    return got or default
