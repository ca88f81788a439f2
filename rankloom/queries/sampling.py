"""Splits, samples, caps, negatives, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import category_name, extract_evidence
from ..operators import sampling as P
from ..operators.retrieval import hash_order
from ..storage import rows_of
from .base import EX, PR, examples, predictions, query

_ORDER = "md5('42:' || coalesce(gk, ''))"
_SPLIT = f"""{EX}, g AS (SELECT gk, count(*) AS n FROM ex GROUP BY gk), o AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}, gk) AS i, count(*) OVER () AS a FROM g),
    z AS (SELECT gk, n, i, CASE WHEN a <= 1 THEN 0 ELSE least(CASE WHEN a >= 3 THEN greatest(round_even(a * 0.1, 0), 1) ELSE round_even(a * 0.1, 0) END, a - 1) END AS te, a FROM o),
    y AS (SELECT *, CASE WHEN a - te <= 1 THEN 0 ELSE least(CASE WHEN a - te >= 2 THEN greatest(round_even(a * 0.1, 0), 1) ELSE round_even(a * 0.1, 0) END, a - te - 1) END AS de FROM z),
    sp AS (SELECT gk, CASE WHEN i <= te THEN 'test' WHEN i <= te + de THEN 'dev' ELSE 'train' END AS split, n FROM y)"""


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def group_split(spark, sf_dir):
    return P.group_split(examples(spark, sf_dir).select("gk"), "gk")


@query(f"WITH {_SPLIT} SELECT split, count(*) AS num_groups, CAST(sum(n) AS BIGINT) AS num_examples FROM sp GROUP BY split")
def split_info(spark, sf_dir):
    return P.split_info(P.group_split(examples(spark, sf_dir).select("gk"), "gk"))


@query(f"""WITH {EX}, a AS (SELECT gk AS key, min(CASE split WHEN 'train' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END) AS p FROM ex WHERE gk IS NOT NULL GROUP BY gk)
           SELECT example_id AS source_index, CASE coalesce(least(x.p, y.p), 0) WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split
           FROM ex LEFT JOIN a x ON x.key = ex.gk LEFT JOIN a y ON y.key = ex.query""")
def split_from_assignment(spark, sf_dir):
    """The table's own splits as an assignment by group key, given back to all rows by key or query."""
    e = examples(spark, sf_dir)
    rows = e.select(F.col("example_id").alias("source_index"), F.col("gk").alias("group_key"), "query")
    return P.split_from_assignment(rows, e.select(F.col("gk").alias("key"), "split"))


_SUB = f"""{PR}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_name, gk ORDER BY retrieval_rank, s DESC, sidx) AS z FROM pr) WHERE z <= 20 OR g >= 0.7),
    k AS (SELECT *, run_name || '|' || coalesce(gk, '') AS key FROM c WHERE (run_name, coalesce(gk, '')) IN (SELECT (run_name, coalesce(gk, '')) FROM c GROUP BY run_name, gk HAVING max(g) >= 0.7)),
    gs AS (SELECT key, count(*) AS n FROM k GROUP BY key),
    ru AS (SELECT key, sum(n) OVER (ORDER BY md5('42:' || key), key) - n AS before FROM gs)"""


@query(f"WITH {_SUB} SELECT sidx, key FROM k WHERE key IN (SELECT key FROM ru WHERE before < (SELECT round_even(count(*) * 0.1, 0) FROM predictions))")
def sample_groups(spark, sf_dir):
    """Tenth of the rows in whole groups: capped lists with all positives, groups with a positive, groups in hash order."""
    p = predictions(spark, sf_dir)
    key = F.concat_ws("|", F.col("run_name"), F.coalesce("gk", F.lit("")))
    p = p.withColumn("key", key)
    capped = P.cap_groups(p, "key", 20, [F.asc_nulls_last("retrieval_rank"), F.desc("s"), F.col("sidx")], F.col("g") >= 0.7)
    relevant = capped.where("g >= 0.7").select("key").distinct()
    target = p.agg(F.greatest(F.bround(F.count(F.lit(1)) * 0.1), F.lit(1)).alias("t")).first()["t"]
    return P.sample_groups(capped.join(relevant, "key", "left_semi"), "key", int(target)).select("sidx", "key")


@query(f"""WITH {EX}, f AS (SELECT gk, min(example_id) AS o FROM ex GROUP BY gk ORDER BY o, gk LIMIT 100) SELECT example_id FROM ex WHERE EXISTS (SELECT 1 FROM f WHERE f.gk IS NOT DISTINCT FROM ex.gk)""")
def trim_queries(spark, sf_dir):
    """Rows of the first hundred groups in order of appearance (the limit is the operator)."""
    return P.first_groups(examples(spark, sf_dir).select("example_id", "gk"), "gk", 100, "example_id").select("example_id")


@query(f"""WITH {PR} SELECT sidx, place, policy FROM (
             SELECT sidx, 'input_order' AS policy, row_number() OVER (PARTITION BY run_name, gk ORDER BY sidx) AS place FROM pr
             UNION ALL SELECT sidx, 'label_desc', row_number() OVER (PARTITION BY run_name, gk ORDER BY g DESC, sidx) FROM pr
             UNION ALL SELECT sidx, 'random', row_number() OVER (PARTITION BY run_name, gk ORDER BY md5('1000045:' || sidx), sidx) FROM pr) WHERE place <= 16""")
def truncate_group(spark, sf_dir):
    """At most 16 rows of each group by each of the truncation policies; random is seeded by seed and epoch."""
    p = predictions(spark, sf_dir).withColumn("key", F.to_json(F.struct("run_name", "gk")))
    kinds = {"input_order": [F.col("sidx")], "label_desc": [F.desc("g"), F.col("sidx")], "random": [hash_order(42 + 1000003, F.col("sidx")), F.col("sidx")]}
    out = None
    for name, order in kinds.items():
        w = Window.partitionBy("key").orderBy(*order)
        got = p.withColumn("place", F.row_number().over(w)).where("place <= 16").select("sidx", F.col("place").cast("long").alias("place"), F.lit(name).alias("policy"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""WITH q AS (SELECT DISTINCT query AS qid FROM gt_items WHERE query IS NOT NULL), p AS (SELECT DISTINCT query AS qid, doc_id FROM examples WHERE labels >= 7 AND doc_id IS NOT NULL AND query IN (SELECT qid FROM q)),
          d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS at, count(*) OVER () AS size FROM (SELECT DISTINCT doc_id FROM examples WHERE doc_id IS NOT NULL)),
          m AS (SELECT q.qid, coalesce(c, 0) AS m, (SELECT max(size) FROM d) AS size FROM q LEFT JOIN (SELECT qid, count(*) AS c FROM p GROUP BY qid) x ON x.qid = q.qid),
          s AS (SELECT qid, size, CAST('0x' || left(md5('42:' || qid), 12) AS BIGINT) % size AS start, unnest(range(0, least(15 + greatest(m, 4), size))) AS step FROM m),
          g AS (SELECT s.qid, d.doc_id, row_number() OVER (PARTITION BY s.qid ORDER BY step) AS pos FROM s JOIN d ON d.at = (start + step) % s.size ANTI JOIN p ON p.qid = s.qid AND p.doc_id = d.doc_id)
          SELECT qid, doc_id, CAST(pos AS INTEGER) AS pos FROM g WHERE pos <= 15""")
def random_negatives(spark, sf_dir):
    """15 sampled documents that aren't positives, for each query."""
    q = rows_of(spark, sf_dir, "gt_items").where("query is not null").select(F.col("query").alias("qid"))
    e = rows_of(spark, sf_dir, "examples").where("doc_id is not null")
    pos = e.where("labels >= 7").select(F.col("query").alias("qid"), "doc_id")
    return P.random_negatives(q, pos.join(q.distinct(), "qid", "left_semi"), e.select("doc_id"), 15)


_LW = f"""{EX}, l AS (SELECT example_id AS sidx, gk, coalesce(labels / 10, 0.0) AS g, instruction FROM ex WHERE gk IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY g DESC, sidx) AS top, count(*) OVER (PARTITION BY gk) AS n, sum(CASE WHEN g >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY gk) AS p FROM l),
    s AS (SELECT *, CASE WHEN g >= 0.7 OR (p = 0 AND top = 1) THEN 'positive' ELSE 'negative' END AS side FROM t WHERE n >= 2 AND (p < n OR (p = 0 AND n > 1))),
    o AS (SELECT sidx, gk, side, row_number() OVER (PARTITION BY gk, side ORDER BY sidx) AS place FROM s), k AS (SELECT * FROM o WHERE side = 'positive' OR place <= 15)"""


def _listwise(spark, sf_dir):
    e = examples(spark, sf_dir).where("gk is not null").select(F.col("example_id").alias("sidx"), "gk", F.coalesce(F.col("labels") / 10, F.lit(0.0)).alias("g"))
    return P.listwise_export(e, "gk", max_neg=15)


@query(f"WITH {_LW} SELECT sidx, gk, side, CAST(place AS INTEGER) AS place FROM k")
def listwise_export(spark, sf_dir):
    return _listwise(spark, sf_dir).select("sidx", "gk", "side", "place")


@query(f"""WITH {_LW}, g AS (SELECT gk, count(*) AS n, count(*) FILTER (side = 'positive') AS p, count(*) FILTER (side = 'negative') AS m FROM k GROUP BY gk)
           SELECT count(*) AS num_groups, round(avg(n), 6) AS avg_group, max(n) AS max_group, round(avg(p), 6) AS avg_positive, max(p) AS max_positive, round(avg(m), 6) AS avg_negative, max(m) AS max_negative FROM g""")
def export_stats(spark, sf_dir):
    side = lambda x: F.sum((F.col("side") == x).cast("long"))
    g = _listwise(spark, sf_dir).groupBy("gk").agg(F.count(F.lit(1)).alias("n"), side("positive").alias("p"), side("negative").alias("m"))
    cols = []
    for c, name in (("n", "group"), ("p", "positive"), ("m", "negative")):
        cols += [F.round(F.avg(c), 6).alias(f"avg_{name}"), F.max(c).alias(f"max_{name}")]
    return g.agg(F.count(F.lit(1)).alias("num_groups"), *cols)


def _groups(spark, sf_dir):
    return examples(spark, sf_dir).where("gk is not null").select(F.col("example_id").alias("sidx"), "gk", F.coalesce(F.col("labels") / 10, F.lit(0.0)).alias("g"))


@query(f"""WITH {EX}, x AS (SELECT example_id AS sidx, gk, coalesce(labels / 10, 0.0) AS g FROM ex WHERE gk IS NOT NULL),
           t AS (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY g DESC, sidx) = 1 AS pos, count(*) OVER (PARTITION BY gk) AS n FROM x),
           u AS (SELECT *, sum((NOT pos AND g < 0.3)::INT) OVER (PARTITION BY gk) AS under FROM t),
           k AS (SELECT sidx, gk, g, CASE WHEN pos THEN 'positive' WHEN under = 0 OR g < 0.3 THEN 'negative' END AS side FROM u WHERE n >= 3),
           r AS (SELECT sidx, gk, side, CAST(row_number() OVER (PARTITION BY gk, side ORDER BY g DESC, sidx) AS INTEGER) AS place FROM k WHERE side IS NOT NULL)
           SELECT * FROM r WHERE side = 'positive' OR place <= 4""")
def listwise_top1(spark, sf_dir):
    """The best row of each group against those under another threshold, by label."""
    got = P.listwise_export(_groups(spark, sf_dir), "gk", min_group=3, max_neg=4, strategy="top1", negative_threshold=0.3, by_label=True)
    return got.select("sidx", "gk", "side", "place")


@query(f"""WITH {EX}, g AS (SELECT gk, count(*) AS n, count(*) FILTER (coalesce(labels / 10, 0.0) >= 0.7) AS p FROM ex WHERE gk IS NOT NULL GROUP BY gk)
           SELECT CAST(sum(n) AS BIGINT) AS num_examples, count(*) AS num_query_groups, count(*) FILTER (n >= 2 AND p > 0 AND n > p) AS num_exported_groups, count(*) FILTER (n < 2) AS skipped_small_groups,
             count(*) FILTER (n >= 2 AND p = 0) AS skipped_no_positive, count(*) FILTER (n >= 2 AND p > 0 AND n = p) AS skipped_no_negative FROM g""")
def export_skips(spark, sf_dir):
    """How many groups an export leaves out, and why."""
    return P.listwise_stats(_groups(spark, sf_dir), "gk", strategy="threshold")


@query(f"""WITH {EX}, c AS (SELECT gk, instruction, count(*) AS c, min(example_id) AS o FROM ex WHERE instruction IS NOT NULL AND trim(instruction, ' ') <> '' GROUP BY ALL)
           SELECT gk, instruction FROM (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY c DESC, o) AS z FROM c) WHERE z = 1""")
def modal_instruction(spark, sf_dir):
    return P.modal_value(examples(spark, sf_dir).select("gk", "instruction", "example_id"), "gk", "instruction", "example_id")


@query()
def lpt_shards(spark, sf_dir):
    """Sources of the documents over 8 shards by falling size; a sequential rule, tested on fixtures."""
    d = rows_of(spark, sf_dir, "documents").groupBy("origin_id").agg(F.count(F.lit(1)).alias("n"))
    return P.lpt_shards(d, "origin_id", "n", 8)


@query(f"""WITH {EX} SELECT arg_min(instruction, example_id) AS instruction, min(example_id) AS source_index FROM ex WHERE instruction IS NOT NULL AND trim(instruction, ' ') <> ''""")
def first_instruction(spark, sf_dir):
    e = rows_of(spark, sf_dir, "examples").where("trim(instruction) != ''")
    return e.agg(F.min_by("instruction", "example_id").alias("instruction"), F.min("example_id").alias("source_index"))


@query("""SELECT example_id, 35 + length(coalesce(instruction, '')) + length(coalesce(query, '')) + length(coalesce(doc, '')) AS pair_chars, left(doc, 200) AS doc, coalesce(length(doc) > 200, false) AS doc_truncated,
          35 + length(coalesce(instruction, '')) + length(coalesce(query, '')) + length(coalesce(doc, '')) > 2048 AS too_long FROM examples""")
def subset_rows(spark, sf_dir):
    """Rows of the subset command with their truncation flags."""
    e = rows_of(spark, sf_dir, "examples")
    n = X.pair_length(F.col("instruction"), F.col("query"), F.col("doc")).cast("long")
    cut = F.coalesce(F.length("doc") > 200, F.lit(False))
    return e.select("example_id", n.alias("pair_chars"), X.truncate(F.col("doc"), 200).alias("doc"), cut.alias("doc_truncated"), (n > 2048).alias("too_long"))


@query("""WITH m AS (SELECT * FROM (VALUES ('1', 'single'), ('2', 'time'), ('3', 'open')) t(category, name))
          SELECT qa_id, CASE WHEN q.category IS NULL THEN 'unknown' ELSE coalesce(m.name, CAST(q.category AS VARCHAR)) END AS category_name
          FROM dialogue_qa q LEFT JOIN m ON m.category = CAST(q.category AS VARCHAR)""")
def category_names(spark, sf_dir):
    names = spark.createDataFrame([("1", "single"), ("2", "time"), ("3", "open")], "category string, name string")
    q = rows_of(spark, sf_dir, "dialogue_qa").select("qa_id", F.col("category").cast("string").alias("category"))
    return q.join(F.broadcast(names), "category", "left").select("qa_id", category_name(F.col("category"), F.col("name")).alias("category_name"))


@query()
def evidence_ids(spark, sf_dir):
    """Ids of the evidence by the recursive rule for JSON and separated text (tested on fixtures)."""
    q = rows_of(spark, sf_dir, "dialogue_qa")
    return q.select("qa_id", F.posexplode(extract_evidence(F.col("evidence"))).alias("pos", "item"))
