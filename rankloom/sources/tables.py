"""Ground truth, qrels, recall lists, dialogues, runs and metrics files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import as_float
from ..functions.text import DOC_FIELDS, clean_cell, clean_text, split_ids, synthesize_doc, utrim
from ..schemas import ALIASES
from .order import with_place
from .records import first_filled, read_json_document, read_json_lines, text_of


def read_ground_truth(spark: SparkSession, path: str, query: str = "query", ids: str = "PageId") -> DataFrame:
    """(source_index, query, raw_page_ids) of a CSV with a header; missing columns are an error.

    XLSX needs a reader that isn't part of Spark; convert it to CSV first.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        raise ValueError("spreadsheets can't be read here; export the sheet as CSV")
    df = with_place(spark.read.csv(path, header=True, multiLine=True, escape='"'), path, "_place")
    df = df.withColumnsRenamed({c: c.replace("\ufeff", "").strip() for c in df.columns})
    missing = [c for c in (query, ids) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    got = df.select(F.col("_place").alias("source_index"), clean_cell(F.col(query)).alias("query"), clean_cell(F.col(ids)).alias("raw_page_ids"))
    return got.where("query != ''")


def merge_ground_truth(rows: DataFrame) -> DataFrame:
    """(query, raw_page_ids, doc_ids): rows of one query together, ids distinct in order; queries without ids are left out."""
    each = rows.select("query", F.struct("source_index", F.col("raw_page_ids").alias("raw"), split_ids(F.col("raw_page_ids")).alias("ids")).alias("r"))
    got = each.groupBy("query").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    raw = F.array_join(F.filter(F.transform("rs", lambda r: r["raw"]), lambda x: x != ""), "，")
    return got.select("query", raw.alias("raw_page_ids"), F.array_distinct(F.flatten(F.transform("rs", lambda r: r["ids"]))).alias("doc_ids")).where(F.size("doc_ids") > 0)


#: Words of which a first line with any is a header of a qrels file.
QREL_HEADER = {*ALIASES["qrel_qid"], *ALIASES["qrel_doc"], *ALIASES["qrel_score"]}


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, score) as written: Parquet, delimited text with a header, or without one three columns or TREC's four.

    Whether there is a header is seen from the first line.  Scores that can't be read are 1.
    """
    if path.endswith(".parquet"):
        df, names = with_place(spark.read.parquet(path), path, "_place"), None
    else:
        lines = with_place(spark.read.text(path), path, "_place").where(utrim(F.col("value")) != "")
        head = (lines.select("value").first() or [""])[0].lstrip("\ufeff")
        sep = "\t" if "\t" in head else "," if "," in head else None
        words = [w.strip().strip('"').lower() for w in (head.split(sep) if sep else head.split())]
        names = words if QREL_HEADER & set(words) else None
        if names:
            df = with_place(spark.read.csv(path, header=True, sep=sep or " "), path, "_place")
            df = df.withColumnsRenamed({c: c.replace("\ufeff", "").strip() for c in df.columns})
        else:
            part = F.split(utrim(F.col("value")), r"\s+" if sep != "," else ",")
            long = F.size(part) >= 4
            df = lines.select("_place", F.get(part, F.lit(0)).alias("qid"), F.when(long, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("doc_id"), F.when(long, F.get(part, F.lit(3))).otherwise(F.get(part, F.lit(2))).alias("score"))

    def zero(c: str):
        kind = df.schema[c].dataType
        return F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit(None).cast(kind)

    def pick(logical: str):
        # a number 0 counts as missing, the text "0" is an id
        cols = [F.nullif(F.nullif(F.col(f"`{c}`"), zero(c)).cast("string"), F.lit("")) for c in ALIASES[logical] if c in df.columns]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    score = next((F.col(c) for c in ALIASES["qrel_score"] if c in df.columns), F.lit(1.0))
    got = df.select(F.col("_place").alias("source_index"), pick("qrel_qid").alias("qid"), pick("qrel_doc").alias("doc_id"), as_float(score.cast("string"), 1.0).alias("score"))
    return got.where("qid is not null and doc_id is not null")


def merge_qrels(rows: DataFrame) -> DataFrame:
    """The last score of each pair; pairs with 0 or less are left out."""
    return rows.groupBy("qid", "doc_id").agg(F.max_by("score", "source_index").alias("score")).where("score > 0")


def read_recall(spark: SparkSession, path: str, id_key: str = "doc_id") -> DataFrame:
    """(query, source_rank from 1, doc_id, doc): a map of query to docs, a list of rows with docs, or flat rows.

    Docs without id or without text are left out; the ranks are those of the list as written.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    as_map = doc.where(F.schema_of_variant("v").startswith("OBJECT")).select(F.explode(F.try_variant_get("v", "$", "map<string, variant>")).alias("query", "d"))
    a = as_map.select(F.lit(0).alias("i"), "query", F.posexplode(F.try_variant_get("d", "$", "array<variant>")).alias("rank", "record"))
    rows = doc.where(F.schema_of_variant("v").startswith("ARRAY")).select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "record"))
    q = first_filled("record", ("query", "q", "question"))
    docs = F.coalesce(*[F.try_variant_get("record", f"$.{k}", "array<variant>") for k in ALIASES["recall_docs"]])
    nested = rows.where(docs.isNotNull()).select("i", q.alias("query"), F.posexplode(docs).alias("rank", "record"))
    flat = rows.where(docs.isNull()).select("i", q.alias("query"), F.lit(0).alias("rank"), "record")
    every = a.unionByName(nested).unionByName(flat).where("query is not null")
    ids = tuple(dict.fromkeys((id_key, *ALIASES["recall_doc_id"])))
    every = every.select("query", "i", "rank", first_filled("record", ids).alias("doc_id"), *[text_of("record", k).alias(f"_{k}") for k in ("doc", *DOC_FIELDS)])
    body = synthesize_doc(F.col("_doc"), {k: F.col(f"_{k}") for k in DOC_FIELDS})
    got = every.select("query", "i", "rank", "doc_id", body.alias("doc")).where("doc_id is not null and doc != ''")
    w = Window.partitionBy("query").orderBy("i", "rank")
    return got.select("query", F.row_number().over(w).alias("source_rank"), "doc_id", "doc")


def read_dialogues(records: DataFrame) -> DataFrame:
    """Turns of dialogue samples (source_index, record): sessions are keys ``session_N``, in order of their number."""
    sample = F.coalesce(first_filled("record", ALIASES["sample_id"]), F.format_string("sample_%04d", F.col("source_index")))
    conv = records.select(sample.alias("sample_id"), F.try_variant_get("record", "$.conversation", "map<string, variant>").alias("c"))
    each = conv.select("sample_id", "c", F.explode("c").alias("session", "turns")).where(F.col("session").rlike(r"^session_\d+$"))
    time = F.try_variant_get(F.get(F.filter(F.map_entries("c"), lambda e: e["key"] == F.concat(F.col("session"), F.lit("_date_time"))), F.lit(0))["value"], "$", "string")
    turns = each.select("sample_id", "session", time.alias("session_time"), F.posexplode(F.try_variant_get("turns", "$", "array<variant>")).alias("i", "record"))
    return turns.select(
        "sample_id",
        "session",
        F.regexp_extract("session", r"(\d+)$", 1).cast("int").alias("session_no"),
        "session_time",
        (F.col("i") + 1).alias("turn_no"),
        text_of("record", "speaker").alias("speaker"),
        F.coalesce(first_filled("record", ("dia_id",)), F.concat("session", F.lit(":"), (F.col("i") + 1).cast("string"))).alias("dia_id"),
        clean_text(first_filled("record", ("text", "content", "utterance", "message"))).alias("said"),
    )


def read_dialogue_questions(records: DataFrame) -> DataFrame:
    """(sample_id, qa_no, question, answer, category, evidence) of dialogue samples; evidence is its JSON or text."""
    sample = F.coalesce(first_filled("record", ALIASES["sample_id"]), F.format_string("sample_%04d", F.col("source_index")))
    qa = records.select(sample.alias("sample_id"), F.posexplode(F.try_variant_get("record", "$.qa", "array<variant>")).alias("qa_no", "record"))
    return qa.select("sample_id", "qa_no", *[text_of("record", c).alias(c) for c in ("question", "answer", "category", "evidence")])


def discover_runs(spark: SparkSession, root: str, name: str = "predictions.jsonl") -> DataFrame:
    """(run_name, source_index, record) of the prediction files of all runs under a folder; none is an error."""
    files = with_place(spark.read.text(f"{root}/*/{name}", recursiveFileLookup=False), f"{root}/*/{name}")
    got = files.select(F.url_decode(F.element_at(F.split("file", "/"), -2)).alias("run_name"), "source_index", F.try_parse_json("value").alias("record"))
    return got.where("record is not null")


def collect_metrics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(run_name, record) of metrics files; files that can't be parsed are left out."""
    doc = spark.read.text(paths, wholetext=True)
    got = doc.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_name"), F.try_parse_json("value").alias("record"))
    return got.where(F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))


def read_split(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One split: Parquet files as columns, or JSON files as VARIANT records, JSON lines and documents in any order.

    A document's array, or the values of its object, are its records; what isn't an object is left out of both kinds.
    Parquet beside JSON, and files of other kinds, are errors.
    """
    kinds = {p.rsplit(".", 1)[-1].lower() for p in paths}
    if kinds == {"parquet"}:
        return spark.read.parquet(*paths)
    if "parquet" in kinds:
        raise ValueError("a split can't mix Parquet and JSON files")
    if not kinds or kinds - {"json", "jsonl"}:
        raise ValueError(f"a split is made of Parquet files or of JSON files, not of {', '.join(sorted(kinds)) or 'nothing'}")
    parts = []
    for i, (kind, group) in enumerate(groupby(paths, lambda p: p.rsplit(".", 1)[-1].lower())):
        rows = read_json_lines(spark, list(group), "drop") if kind == "jsonl" else read_json_document(spark, list(group), keys=(), values=True)
        parts.append(rows.withColumn("source_index", F.col("source_index") + F.lit(i << 58)))
    return reduce(DataFrame.unionByName, parts)
