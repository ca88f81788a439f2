"""Sources and sinks: tables written as files in the shared folder, and read back by the readers of each format."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import scalar as S
from ..functions import text as X
from ..operators import metrics as M
from ..plans import commands
from ..sources import discovery, records, sinks, tables
from ..storage import hadoop, rows_of, session_folder
from .base import predictions, query
from .evaluation import _SO, _exact


def _folder(spark) -> str:
    return f"{session_folder(spark)}/files-{uuid.uuid4().hex}"


def _named(spark, written: str, target: str, kind: str) -> list[str]:
    """Give the part files that Spark wrote names of their own, in order: target-00000.kind and so on."""
    out = []
    for i, f in enumerate(sorted(discovery.glob(spark, [f"{written}/part-*"]))):
        source, fs = hadoop(spark, f)
        goal, _ = hadoop(spark, f"{target}-{i:05d}.{kind}")
        fs.mkdirs(goal.getParent())
        fs.rename(source, goal)
        out.append(goal.toString())
    return out


@query("SELECT example_id, query, doc, labels FROM examples")
def json_lines_read(spark, sf_dir):
    """All examples as JSON lines and back."""
    path = _folder(spark)
    sinks.write_json_lines(rows_of(spark, sf_dir, "examples").select("example_id", "query", "doc", "labels"), path)
    r = records.read_json_lines(spark, path)
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return r.select(get("example_id", "long"), get("query", "string"), get("doc", "string"), get("labels", "double"))


_BLANK = r"regexp_full_match(coalesce({0}, ''), '[\s\p{{Z}}]*')"


@query(f"""SELECT source_index AS n, count(*) AS rows, CAST(sum(length(regexp_replace(doc, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))) AS BIGINT) AS doc_chars, round(sum(labels / 10), 4) AS label
           FROM (SELECT example_id % 97 AS source_index, doc, labels FROM examples WHERE NOT {_BLANK.format('query')} AND NOT {_BLANK.format('doc')} AND labels IS NOT NULL) GROUP BY ALL""")
def examples_from_files(spark, sf_dir):
    """Files of examples under other names of the fields, in the canonical form, summed up."""
    path = _folder(spark)
    e = rows_of(spark, sf_dir, "examples").where("labels is not null").select(F.col("query").alias("question"), F.col("example_id").cast("string").alias("qid"), "doc", "labels")
    sinks.write_json_lines(e, path)
    got = records.to_examples(records.read_json_lines(spark, path, "drop"))
    return got.groupBy((F.col("query_id").cast("long") % 97).alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length(X.utrim(F.col("doc")))).alias("doc_chars"), F.round(F.sum("label"), 4).alias("label")
    )


@query("SELECT row_number() OVER (ORDER BY page_id) - 1 AS source_index, page_id, page_title FROM page_ref")
def json_document_read(spark, sf_dir):
    """The page table, which doesn't grow, as one indented JSON document under a key, and back in order."""
    path = _folder(spark)
    pages = rows_of(spark, sf_dir, "page_ref").agg(F.array_sort(F.collect_list(F.struct("page_id", "page_title"))).alias("items"))
    pages.select(F.to_json(F.struct("items"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    r = records.read_json_document(spark, path)
    return r.select("source_index", *[records.text_of("record", c).alias(c) for c in ("page_id", "page_title")])


@query("SELECT lang AS query, CAST(row_number() OVER (PARTITION BY lang ORDER BY page_id) AS INTEGER) AS source_rank, page_id AS doc_id, page_title AS doc FROM page_ref WHERE lang IS NOT NULL AND page_title IS NOT NULL")
def recall_lists_read(spark, sf_dir):
    """Pages by language as recall lists in one document, as the map form has them."""
    path = _folder(spark)
    lists = rows_of(spark, sf_dir, "page_ref").where("lang is not null and page_title is not null").groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", "page_title"))), lambda x: F.struct(x["page_id"].alias("id"), x["page_title"].alias("doc"))).alias("l")
    )
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct("lang", "l"))).alias("m")).select(F.to_json("m").alias("value"))
    whole.coalesce(1).write.text(path)
    return tables.read_recall(spark, path)


@query(r"""WITH r AS (SELECT gt_id, regexp_replace(query, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS q, regexp_replace(coalesce(raw_page_ids, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS raw FROM gt_items),
           x AS (SELECT gt_id, q AS query, regexp_split_to_array(raw, '[,，、;；\n\r\t]+') AS l FROM r WHERE coalesce(q, '') <> '')
           SELECT gt_id, query, list_aggregate(list_filter(list_transform(l, lambda v: regexp_replace(v, '^[ \x{3000}]+|[ \x{3000}]+$', '', 'g')), lambda v: v <> ''), 'string_agg', '|') AS ids FROM x""")
def ground_truth_csv(spark, sf_dir):
    """Ground truth as CSV with a byte order mark, quoted line ends and separators, and its ids."""
    path = _folder(spark)
    gt = rows_of(spark, sf_dir, "gt_items").select(F.concat_ws("␟", F.col("gt_id").cast("string"), F.col("query")).alias("query"), F.col("raw_page_ids").alias("PageId"))
    sinks.write_csv(gt.where("query like '%␟%'"), path, mark=True)
    rows = tables.read_ground_truth(spark, path)
    part = F.split("query", "␟")
    parts = F.filter(F.transform(F.split("raw_page_ids", "[,，、;；\\n\\r\\t]+"), lambda v: F.regexp_replace(v, "^[ \\u3000]+|[ \\u3000]+$", "")), lambda v: v != "")
    ids = F.when(F.size(parts) > 0, F.array_join(parts, "|"))
    return rows.select(part[0].cast("long").alias("gt_id"), X.utrim(part[1]).alias("query"), ids.alias("ids")).where("query != ''")


@query("""SELECT CAST(example_id AS VARCHAR) AS qid, doc_id, coalesce(labels, 1.0) AS score FROM examples WHERE doc_id IS NOT NULL AND doc_id <> '' AND coalesce(labels, 1.0) > 0
          AND NOT regexp_matches(doc_id, '[\\t\\n\\r"]')""")
def qrels_files_read(spark, sf_dir):
    """Judgements as delimited text with a header, in files found by their pattern, merged by the last score."""
    folder = _folder(spark)
    e = rows_of(spark, sf_dir, "examples").where("doc_id is not null").where(~F.col("doc_id").rlike('[\\t\\n\\r"]'))
    e.select(F.col("example_id").cast("string").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("labels").cast("string").alias("score")).write.csv(
        f"{folder}/w", header=True, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    _named(spark, f"{folder}/w", f"{folder}/qrels/part", "tsv")
    files = discovery.qrels_files(spark, folder)
    rows = tables.read_qrels(spark, files[0])
    for f in files[1:]:
        rows = rows.unionByName(tables.read_qrels(spark, f))
    return tables.merge_qrels(rows).select("qid", "doc_id", "score")


@query("SELECT doc_id, length(text) AS n_chars, lang FROM documents")
def split_files_read(spark, sf_dir):
    """A corpus in JSON lines, in the files of its split."""
    folder = _folder(spark)
    sinks.write_json_lines(rows_of(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "text", "lang"), f"{folder}/w")
    _named(spark, f"{folder}/w", f"{folder}/corpus", "jsonl")
    r = tables.read_split(spark, discovery.split_files(spark, folder, "corpus"))
    get = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return r.select(get("_id", "long").alias("doc_id"), F.length(get("text", "string")).cast("long").alias("n_chars"), get("lang", "string").alias("lang"))


@query(f"""WITH {_exact(_SO)}
           SELECT run_name, beta, count(*) AS num_queries, round(avg(best_k), 6) AS avg_selected_count, round(avg(precision), 6) AS avg_precision, round(avg(f1), 6) AS avg_f1,
             CAST(sum(best_k) AS BIGINT) AS total_selected, CAST(sum(hit_count) AS BIGINT) AS total_hits FROM db WHERE gk IS NOT NULL AND gk <> '' GROUP BY run_name, beta""")
def beta_matrix_files(spark, sf_dir):
    """The beta matrix from run folders: predictions.jsonl of each run, and its per-query counts."""
    root = _folder(spark)
    p = predictions(spark, sf_dir).where("gk is not null")
    rows = p.select("run_name", F.col("gk").alias("query"), F.coalesce("doc_id", F.lit("none")).alias("doc_id"), F.col("s").alias("score"), (F.col("g") >= M.THRESHOLD).alias("is_relevant"), F.col("retrieval_rank").alias("rank"), F.col("sidx").alias("source_rank"))
    counts = p.groupBy("run_name", F.col("gk").alias("query")).agg(F.max("true_relevant_count").alias("num_gt_docs")).where("num_gt_docs > 0")
    for table, name in ((rows, "predictions.jsonl"), (counts, "per_query_metrics.jsonl")):
        table.repartition("run_name").write.partitionBy("run_name").option("ignoreNullFields", "false").json(f"{root}/w-{name}")
        for f in discovery.glob(spark, [f"{root}/w-{name}/run_name=*/part-*"]):  # one file a run
            source, fs = hadoop(spark, f)
            goal, _ = hadoop(spark, f"{root}/{source.getParent().getName().removeprefix('run_name=')}/{name}")
            fs.mkdirs(goal.getParent())
            fs.rename(source, goal)
    summary, _ = commands.recompute_beta(spark, root)
    return summary.select("run_name", "beta", "num_queries", "avg_selected_count", "avg_precision", "avg_f1", "total_selected", "total_hits")


@query("""SELECT run_name, split_part(run_name, '__', 1) AS dataset, split_part(run_name, '__', 2) AS model, count(*) AS num_pairs, round(avg(coalesce(label, 0.0)), 4) AS mean_label FROM predictions GROUP BY run_name""")
def run_metrics_summary(spark, sf_dir):
    """Metrics files of all runs, one JSON document each, collected into one table."""
    root = _folder(spark)
    figures = rows_of(spark, sf_dir, "predictions").groupBy("run_name").agg(F.count(F.lit(1)).alias("num_pairs"), F.round(F.avg(F.coalesce("label", F.lit(0.0))), 4).alias("mean_label"))
    for r in figures.collect():  # one row a run
        one = spark.createDataFrame([(r["num_pairs"], r["mean_label"])], "num_pairs long, mean_label double")
        sinks.write_json_figures(one, f"{root}/{r['run_name']}/overall_metrics.json")
    got = commands.summarize(spark, root)
    return got.select("run_name", "dataset", "model", F.col("num_pairs").cast("long").alias("num_pairs"), F.col("mean_label").cast("double").alias("mean_label"))


@query("""SELECT example_id, CASE example_id % 4 WHEN 0 THEN 'd' || example_id || '|e' || coalesce(source_index, 0) WHEN 1 THEN 'd' || example_id || '|e' || coalesce(source_index, 0) || '|c'
          WHEN 2 THEN 'd' || example_id || '|x' ELSE 'e' || coalesce(source_index, 0) END AS ids FROM examples""")
def positive_ids(spark, sf_dir):
    """Document ids out of packed text, JSON lists, objects of scores, and objects with an id."""
    e = rows_of(spark, sf_dir, "examples")
    a, b = F.concat(F.lit("d"), F.col("example_id").cast("string")), F.concat(F.lit("e"), F.coalesce("source_index", F.lit(0)).cast("string"))
    form = F.when(F.col("example_id") % 4 == 0, F.concat(a, F.lit(", "), b, F.lit(",,"), a))
    form = form.when(F.col("example_id") % 4 == 1, F.format_string('["%s", ["%s", {"doc_id": "c"}], "%s"]', a, b, a))
    form = form.when(F.col("example_id") % 4 == 2, F.format_string('{"%s": 1, "%s": 0, "x": "high", "y": -2.5}', a, b)).otherwise(F.format_string('{"id": "%s", "z": 3}', b))
    return e.select("example_id", F.array_join(I.positives([form, F.lit(None).cast("string")]), "|").alias("ids"))


@query("""SELECT example_id, CASE example_id % 4 WHEN 0 THEN 'D' || example_id || ':1|D2:3' WHEN 1 THEN 'D' || example_id || ':1|D2:3|7' WHEN 2 THEN 'D' || example_id || ':1' ELSE 'D' || example_id || ':1|D2:3' END AS ids FROM examples""")
def evidence_forms(spark, sf_dir):
    """Turn ids out of evidence as text, list, object, and object with evidence inside."""
    e = rows_of(spark, sf_dir, "examples")
    a = F.concat(F.lit("D"), F.col("example_id").cast("string"), F.lit(":1"))
    form = F.when(F.col("example_id") % 4 == 0, F.concat(a, F.lit("; D2:3, "), a)).when(F.col("example_id") % 4 == 1, F.format_string('["%s,D2:3", ["D2:3", 7]]', a))
    form = form.when(F.col("example_id") % 4 == 2, F.format_string('{"dia_id": "%s", "evidence": ["no"]}', a)).otherwise(F.format_string('{"note": "x", "evidences": ["%s; D2:3"]}', a))
    return e.select("example_id", F.array_join(I.extract_evidence(form), "|").alias("ids"))


@query(f"""SELECT example_id, CASE WHEN NOT {_BLANK.format('query_id')} THEN 'qid:' || query_id WHEN NOT {_BLANK.format('query')} THEN 'query:' || query ELSE 'row:' || example_id END AS key,
           coalesce(CASE WHEN NOT {_BLANK.format('reason')} THEN regexp_replace(reason, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') END, CASE WHEN NOT {_BLANK.format('dataset')} THEN regexp_replace(dataset, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') END, '') AS said,
           'Q: ' || query || '?' AS asked, dataset || '|' || split AS parts, coalesce(try_cast(CAST(labels AS VARCHAR) AS DOUBLE), -1.0) AS label, example_id % 7 AS n FROM examples""")
def text_helpers(spark, sf_dir):
    """Keys by the first filled field, first filled texts, templates, lists, numbers with defaults."""
    e = rows_of(spark, sf_dir, "examples")
    listed = X.unique_keep_order(X.normalize_list(F.concat_ws(", ", "dataset", F.lit(""), "split", "dataset")))
    return e.select(
        "example_id",
        X.prefixed_key([("qid", F.col("query_id")), ("query", F.col("query"))], F.col("example_id")).alias("key"),
        X.first_non_empty(F.col("reason"), F.col("dataset")).alias("said"),
        X.fill_template("Q: {query}?", F.col("query")).alias("asked"),
        F.when(F.col("dataset").isNotNull() & F.col("split").isNotNull(), F.array_join(listed, "|")).alias("parts"),
        S.as_float(F.col("labels").cast("string"), -1.0).alias("label"),
        S.as_int((F.col("example_id") % 7).cast("string")).alias("n"),
    )
