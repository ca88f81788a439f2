"""Commands over run folders, candidate files, dialogues and datasets; each gives its tables, writers stand in sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import POSITIVE_FIELDS, extract_evidence, positives
from ..functions.scalar import as_float
from ..operators import analysis, metrics, retrieval, sampling
from ..operators.metrics import BETAS, THRESHOLD, _left
from ..sources import sinks
from ..sources.discovery import glob, qrels_files, split_files
from ..sources.order import with_place
from ..sources.records import first_filled, present, read_json_document, read_json_lines, text_of
from ..sources.tables import collect_metrics, discover_runs, read_dialogue_questions, read_dialogues, read_qrels, read_split

#: Fields of a query's metrics that may hold its true count, in this order.
COUNT_FIELDS = ("正确标签数量", "num_gt_docs", "true_count", "gt_count")
#: Fields that may hold the id and the text of a row of a dataset.
ROW_ID, ROW_TEXT = ("id", "_id", "qid", "query_id", "doc_id", "docid", "pid", "corpus_id"), ("text", "contents", "query", "question")


def _number(name: str, default: float | None = 0.0) -> Column:
    got = text_of("record", name).try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def recompute_beta(spark: SparkSession, root: str, betas: Sequence[float] = BETAS, ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary, per query) of the runs under a folder, from their stored predictions and per-query metrics.

    Predictions without query or doc_id are left out; a run without per-query metrics counts the relevant ids that were
    recalled.
    """
    p = discover_runs(spark, root).select(
        "run_name", text_of("record", "query").alias("query"), text_of("record", "doc_id").alias("doc_id"), _number("score").alias("s"),
        (F.lower(F.coalesce(text_of("record", "is_relevant"), F.lit(""))).isin("true") | (F.coalesce(text_of("record", "is_relevant").try_cast("double"), F.lit(0.0)) != 0)).alias("is_relevant"),
        _number("rank", None).cast("long").alias("rank"), _number("source_rank", None).cast("long").alias("source_rank"),
    ).where("coalesce(query, '') <> '' AND coalesce(doc_id, '') <> ''")
    counts = None
    pattern = f"{root}/*/per_query_metrics.jsonl"
    if glob(spark, [pattern]):
        rows = with_place(spark.read.text(pattern), pattern).withColumn("record", F.try_parse_json("value")).where("record is not null")
        run = F.url_decode(F.element_at(F.split("file", "/"), -2))
        rows = rows.select(run.alias("run_name"), "source_index", text_of("record", "query").alias("query"), first_filled("record", COUNT_FIELDS).try_cast("long").alias("n"))
        counts = rows.where("coalesce(query, '') <> '' AND n IS NOT NULL").groupBy("run_name", "query").agg(F.max_by("n", "source_index").alias("true_count"))
    keys = ["run_name", "query"]
    exact = metrics.stored_order_beta(p, keys, counts, betas, exact=True)
    return metrics.stored_order_summary(exact, ["run_name"]), metrics.stored_order_beta(p, keys, counts, betas, ids=ids)


def summarize(spark: SparkSession, root: str, name: str = "overall_metrics.json") -> DataFrame:
    """One row a run with its dataset, model and all figures of its metrics file, nested values as JSON text.

    The columns are all keys of all runs, as many as the metrics have names.
    """
    rows = collect_metrics(spark, f"{root}/*/{name}")
    each = rows.select("run_name", F.explode(F.try_variant_get("record", "$", "map<string, variant>")).alias("key", "v"))
    text = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    names = [r["key"] for r in each.select("key").distinct().orderBy("key").collect()]
    dataset, model = analysis.run_parts(F.col("run_name"))
    wide = each.select("run_name", "key", text.alias("v")).groupBy("run_name").pivot("key", names).agg(F.first("v"))
    return wide.select("run_name", dataset.alias("dataset"), model.alias("model"), *[F.col(f"`{n}`") for n in names if n not in ("run_name", "dataset", "model")])


def raw_label_of(record: str = "record") -> Column:
    """The label of a record on the scale to 10: labels, else raw_label, else label, which to 1 is of the other scale."""
    value = as_float(text_of(record, "label"))
    return F.when(present(record, "labels"), as_float(text_of(record, "labels"))).when(present(record, "raw_label"), as_float(text_of(record, "raw_label"))).otherwise(
        F.when(value.between(0, 1), value * 10).otherwise(value)
    )


def diagnose(candidates: DataFrame, predictions: DataFrame | None, keys: Sequence[str], by: Sequence[str], threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """Candidate figures, prediction figures and hints, one row for each value of ``by``."""
    out = {"candidates": analysis.candidate_diagnostics(candidates, keys, by, threshold)}
    if predictions is not None:
        out["predictions"] = analysis.prediction_diagnostics(predictions, keys, by, threshold)
        out["suggestions"] = _left(out["candidates"], out["predictions"], by).select(*by, analysis.suggestions().alias("suggestions"))
    return out


def compare(better: DataFrame, worse: DataFrame, key: str, min_delta: float = 0.2, worse_max: float = 0.5, need_rank: bool = False) -> dict[str, DataFrame]:
    """All shared groups, the cases in which the one run is better - largest gain first - and the summary."""
    every = analysis.compare(better, worse, key)
    cases = analysis.better_cases(every, min_delta, worse_max, need_rank)
    cases = cases.orderBy(F.desc("delta_ndcg"), "worse_ndcg_10", F.desc("delta_mrr"), key)
    return {"all": every, "cases": cases, "summary": analysis.comparison_summary(better, worse, every, key)}


def export_listwise(examples: DataFrame, default_instruction: str = "", **options) -> tuple[DataFrame, DataFrame]:
    """(rows, stats): for each group the messages of its query, its positives and its negatives.

    examples are those of ``to_examples``; the instruction is the group's most frequent one.  A group's messages are one
    value, as a trainer reads them, so cap the sides where groups are large.
    """
    rows = examples.withColumns({"g": F.col("label"), "sidx": F.col("source_index")})
    chosen = sampling.listwise_export(rows, "group_key", **options)
    said = F.array(F.struct(F.lit("assistant").alias("role"), F.trim("doc").alias("content")))
    of = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("place", said.alias("m"))))), lambda x: x["m"])
    got = chosen.groupBy("group_key").agg(F.min_by("query", "sidx").alias("query"), of("positive").alias("positive_messages"), of("negative").alias("negative_messages"))
    got = _left(got, sampling.modal_value(rows, "group_key", "instruction", "sidx"), ["group_key"])
    system = F.coalesce(F.col("instruction"), F.lit(default_instruction))
    user = F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))
    messages = F.when(system != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), user)).otherwise(F.array(user))
    stats = sampling.listwise_stats(rows, "group_key", **{k: v for k, v in options.items() if k in ("threshold", "min_group", "strategy", "negative_threshold")})
    return got.select("group_key", messages.alias("messages"), "positive_messages", "negative_messages"), stats


def _as_records(df: DataFrame) -> DataFrame:
    """Rows of Parquet columns as VARIANT records."""
    return df if "record" in df.columns else df.select(F.to_variant_object(F.struct("*")).alias("record"))


def inspect(spark: SparkSession, folder: str, min_match: float = 0.8) -> dict[str, object]:
    """Figures of a dataset's folder: rows, judged queries, queries with positives of their own, ids that match."""
    files = {s: split_files(spark, folder, s) for s in ("corpus", "queries")}
    out: dict[str, object] = {"corpus_files": files["corpus"], "query_files": files["queries"], "ok": bool(files["corpus"] and files["queries"])}
    if not out["ok"]:
        return out | {"error": "Missing corpus or queries files."}
    corpus, queries = (_as_records(read_split(spark, files[s])) for s in ("corpus", "queries"))
    ids = corpus.select(first_filled("record", ROW_ID).alias("id")).where("id is not null").distinct().withColumn("hit", F.lit(1))
    own = F.size(positives([text_of("record", f) for f in POSITIVE_FIELDS])) > 0
    q = queries.select(first_filled("record", ROW_ID).alias("id"), own.cast("int").alias("own")).join(ids, "id", "left")
    figures = q.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("with_id"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"), F.count("hit").alias("hit")).first()
    judged = 0
    for f in qrels_files(spark, folder):
        judged += read_qrels(spark, f).where("score > 0").select("qid").distinct().count()
    share = figures["hit"] / max(1, figures["with_id"])
    strategy = "explicit" if judged or figures["own"] else "id_match" if share >= min_match else "missing"
    return out | {
        "num_corpus_rows": corpus.count(), "num_query_rows": figures["n"], "qrels_query_count": judged, "positive_field_queries": figures["own"],
        "id_match_overlap_queries": figures["hit"], "id_match_overlap_ratio": share, "has_supervision": bool(judged or figures["own"] or figures["hit"]),
        "recommended_supervision_strategy": strategy,
    }


def prepare_dialogues(spark: SparkSession, path: str, k: int = 100, ensure: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, totals) of the questions of dialogue samples: each is searched among the turns of its sample.

    Questions without text, without evidence, or whose evidence points at no turn, are left out.
    """
    records = read_json_lines(spark, path, "any") if path.endswith(".jsonl") else read_json_document(spark, path, ("data", "samples"))
    turns = read_dialogues(records)
    docs = analysis.dialogue_docs(turns.withColumn("turn_id", F.struct("session_no", "turn_no")))
    asked = read_dialogue_questions(records).withColumn("qid", F.concat("sample_id", F.lit(":"), F.col("qa_no").cast("string")))
    named = asked.where("trim(coalesce(question, '')) <> ''").select("sample_id", "qid", F.explode(extract_evidence(F.col("evidence"))).alias("tid"))
    right = named.join(docs.select("sample_id", "tid", "doc_id"), ["sample_id", "tid"]).select("qid", "doc_id").distinct()
    queries = asked.select("sample_id", "qid", "question").join(right.select("qid").distinct(), "qid", "left_semi")
    found = retrieval.bm25(docs, "doc", queries, "question", k, part=["sample_id"])
    got = retrieval.labelled(found, right, "bm25", "bm25", ensure)
    got = got.join(queries, "qid").join(docs.select("doc_id", "doc"), "doc_id")
    return got, retrieval.exported_totals(got)


def write_report(df: DataFrame, path: str, title: str, rows: int = 50) -> None:
    """A Markdown report of the first rows of a table (the report's own limit)."""
    target, fs = sinks.hadoop(df.sparkSession, path)
    out = fs.create(target, True)
    out.write(bytearray(f"# {title}\n\n{sinks.markdown_table(df, rows)}\n".encode()))
    out.close()
