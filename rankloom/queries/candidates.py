"""Sources in table form, retrieval, candidate lists, dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from ..operators import analysis as A
from ..operators import retrieval as R
from ..operators.packed import unpack
from ..storage import rows_of
from .base import query


@query("""WITH t AS (SELECT query_id AS qid, doc_id, source_index, example_id, coalesce(TRY_CAST(labels AS DOUBLE), 1.0) AS score,
            row_number() OVER (PARTITION BY query_id, doc_id ORDER BY example_id DESC) AS z FROM examples WHERE query_id IS NOT NULL AND doc_id IS NOT NULL)
          SELECT qid, doc_id, score FROM t WHERE z = 1 AND score > 0""")
def qrels_normalize(spark, sf_dir):
    """Relevance judgements: the last row of a pair counts, unreadable scores are 1, scores of 0 or less are dropped."""
    e = rows_of(spark, sf_dir, "examples").where("query_id is not null and doc_id is not null")
    got = e.groupBy(F.col("query_id").alias("qid"), "doc_id").agg(F.max_by(F.coalesce("labels", F.lit(1.0)), "example_id").alias("score"))
    return got.where("score > 0")


@query("""WITH t AS (SELECT example_id, labels AS l, raw_label AS r FROM examples)
          SELECT example_id,
            CASE WHEN l IS NOT NULL THEN l ELSE r END AS raw,
            CASE WHEN l IS NOT NULL THEN round(least(greatest(l / 10, 0.0), 1.0), 6) WHEN r IS NOT NULL THEN round(least(greatest(r / 10, 0.0), 1.0), 6) END AS label,
            CASE WHEN r BETWEEN 0 AND 1 THEN r WHEN r IS NOT NULL THEN round(least(greatest(r / 10, 0.0), 1.0), 6) ELSE 0.0 END AS lone_label,
            coalesce(l, CASE WHEN r <= 1.0 THEN r * 10 ELSE r END, 0.0) AS subset_raw FROM t""")
def label_coercion(spark, sf_dir):
    """The label chains on one table: labels before raw_label, raw_label as a lone label, and the subset's raw label."""
    e = rows_of(spark, sf_dir, "examples")
    l, r, none = F.col("labels"), F.col("raw_label"), F.lit(None).cast("double")
    c = S.coerce_label(l, r, none, none, l.isNotNull(), r.isNotNull(), F.lit(False))
    return e.select(
        "example_id",
        c["raw"].alias("raw"),
        F.round(c["label"], 6).alias("label"),
        F.round(S.normalized_label(none, none, r), 6).alias("lone_label"),
        S.subset_raw_label(l, none, r).alias("subset_raw"),
    )


_WS = r"[\s\p{Z}]"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(title, ''), '^{_WS}+|{_WS}+$', '', 'g') AS t, regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') AS x,
             title AS t0, text AS x0 FROM documents)
           SELECT doc_id, length(d) AS synthesized_chars, md5(d) AS synthesized, length(c) AS corpus_chars, md5(c) AS corpus FROM (
             SELECT doc_id, regexp_replace(concat_ws(', ', CASE WHEN coalesce(t0, '') <> '' THEN 'title: ' || t END, CASE WHEN coalesce(x0, '') <> '' THEN 'text: ' || x END), '^{_WS}+|{_WS}+$', '', 'g') AS d,
               CASE WHEN t <> '' AND NOT contains(x, t) THEN regexp_replace('title: ' || t || chr(10) || 'text: ' || x, '{_WS}+$', '') ELSE x END AS c FROM t)""")
def doc_synthesis(spark, sf_dir):
    """Documents from their fields, by the record rule and by the corpus rule, as lengths and digests of whole texts."""
    d = rows_of(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    syn = X.synthesize_doc(none, {"title": F.col("title"), "text": F.col("text")})
    cor = X.normalize_doc(F.col("title"), F.col("text"))
    return d.select("doc_id", F.length(syn).cast("long").alias("synthesized_chars"), F.md5(syn).alias("synthesized"), F.length(cor).cast("long").alias("corpus_chars"), F.md5(cor).alias("corpus"))


@query(rf"""WITH t AS (SELECT example_id, 35 + length(coalesce(instruction, '')) + length(coalesce(query, '')) + length(coalesce(doc, '')) AS pair_chars,
             [regexp_replace(coalesce(v, ''), '^{_WS}+|{_WS}+$', '', 'g') for v in [instruction, query, doc]] AS p FROM examples)
           SELECT example_id, pair_chars, md5('<Instruct>: ' || p[1] || chr(10) || '<Query>: ' || p[2] || chr(10) || '<Document>: ' || p[3]) AS pointwise,
             md5(CASE WHEN p[1] = '' THEN p[2] ELSE p[1] || chr(10) || chr(10) || p[2] END) AS plain,
             md5(CASE WHEN p[1] = '' THEN 'Query: ' || p[2] ELSE p[1] || chr(10) || chr(10) || 'Query: ' || p[2] END) AS named
           FROM t""")
def prompt_text(spark, sf_dir):
    """Prompts of the scorers, of every length."""
    e = rows_of(spark, sf_dir, "examples")
    i, q, d = F.col("instruction"), F.col("query"), F.col("doc")
    return e.select(
        "example_id", X.pair_length(i, q, d).cast("long").alias("pair_chars"), F.md5(X.prompt(i, q, d)).alias("pointwise"), F.md5(X.instruction_query(i, q)).alias("plain"),
        F.md5(X.instruction_query(i, q, "Query: ")).alias("named"),
    )


@query("""SELECT example_id, length(doc) AS doc_chars FROM examples
          WHERE 35 + length(coalesce(instruction, '')) + length(coalesce(query, '')) + length(coalesce(doc, '')) <= 2048""")
def pair_length_filter(spark, sf_dir):
    """Pairs within the length limit of the subset command."""
    e = rows_of(spark, sf_dir, "examples")
    kept = e.where(X.pair_length(F.col("instruction"), F.col("query"), F.col("doc")) <= 2048)
    return kept.select("example_id", F.length("doc").cast("long").alias("doc_chars"))


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g'), ' ') AS c, text FROM documents)
           SELECT doc_id, length(c) AS clean_chars, CASE WHEN length(c) > 80 THEN left(c, 77) || '...' ELSE c END AS snippet, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS compact FROM t""")
def snippet_clean(spark, sf_dir):
    d = rows_of(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(X.clean_text(F.col("text"))).cast("long").alias("clean_chars"), X.snippet(F.col("text"), 80).alias("snippet"), X.compact(F.col("text"), 40).alias("compact"))


@query(r"""WITH t AS (SELECT example_id, list_distinct([x for x in string_split(regexp_replace(lower(coalesce(query, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') if x <> '']) AS q,
             list_distinct([x for x in string_split(regexp_replace(lower(coalesce(doc, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') if x <> '']) AS d FROM examples)
          SELECT example_id, round(CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0.0 ELSE least(len(list_intersect(q, d)) / len(q) + least(0.15, ln(1 + len(d)) / 100), 1.0) END, 6) AS score FROM t""")
def lexical_score(spark, sf_dir):
    e = rows_of(spark, sf_dir, "examples")
    return e.select("example_id", F.round(S.lexical_score(X.word_set(F.col("query")), X.word_set(F.col("doc"))), 6).alias("score"))


_TOKENS = r"""(SELECT {k}, list_concat(list_concat(regexp_extract_all(t, '[a-z0-9]+'), l), list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1])) AS toks
   FROM (SELECT {k}, t, regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]') AS l FROM (SELECT {k}, lower(coalesce({c}, '')) AS t FROM {f})))"""
_BM = f"""dt AS {_TOKENS.format(k='doc_id', c='text', f='documents')}, dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
    fr AS (SELECT term, count(*) AS df FROM po GROUP BY term)"""


@query(f"WITH {_BM} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM fr, st")
def bm25_corpus_stats(spark, sf_dir):
    _, terms, _ = R.corpus_stats(rows_of(spark, sf_dir, "documents"), "text")
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_BM}, qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(toks) AS term FROM {_TOKENS.format(k='qid', c='query', f='(SELECT gt_id AS qid, query FROM gt_items WHERE gt_id % 100 = 0)')}) GROUP BY ALL),
           sc AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / greatest(tf + 1.2 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1e-9)), 1e-9)), 6) AS bm25
             FROM qt JOIN po USING (term) JOIN fr USING (term) JOIN dl USING (doc_id), st GROUP BY qid, doc_id)
           SELECT qid, doc_id, bm25, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_id) AS rank FROM sc) WHERE rank <= 100""")
def bm25_candidates(spark, sf_dir):
    """Top 100 documents of the stated query set: every ground-truth row whose id is divisible by 100."""
    q = rows_of(spark, sf_dir, "gt_items").where("gt_id % 100 = 0").select(F.col("gt_id").alias("qid"), "query")
    return R.bm25(rows_of(spark, sf_dir, "documents"), "text", q, "query", 100)


_DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS e FROM v),
    pd AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.e, d.e), 6) AS dense FROM u q, u d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
    ca AS (SELECT qid, doc_id, dense, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS rank FROM pd) WHERE rank <= {k})"""


def _dense(spark, sf_dir, k):
    v = rows_of(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return v, R.dense(v.select(F.col("vec_id").alias("doc_id"), "embedding"), q, k)


@query(f"WITH {_DENSE.format(k=100)} SELECT qid, doc_id, dense, CAST(rank AS INTEGER) AS rank FROM ca")
def dense_candidates(spark, sf_dir):
    """Top 100 vectors of the stated query set: every vector whose id is divisible by 100, against all others."""
    return _dense(spark, sf_dir, 100)[1]


_POS = "ps AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)"
_LAB = f"""WITH {_DENSE.format(k=50)}, {_POS},
    c0 AS (SELECT ca.qid, ca.doc_id, rank AS retrieval_rank, dense AS retrieval_score, ps.qid IS NOT NULL AS hit, 0 AS added FROM ca LEFT JOIN ps ON ca.qid = ps.qid AND ca.doc_id = ps.doc_id
      UNION ALL SELECT qid, doc_id, 50 + row_number() OVER (PARTITION BY qid ORDER BY doc_id), 0.0, true, 1 FROM (SELECT * FROM ps ANTI JOIN ca ON ps.qid = ca.qid AND ps.doc_id = ca.doc_id)),
    tc AS (SELECT qid, count(*) AS t FROM ps GROUP BY qid),
    cl AS (SELECT c0.qid, doc_id, CASE WHEN hit THEN 10.0 ELSE 0.0 END::DOUBLE AS labels,
      CASE WHEN added = 1 THEN 'dense_missed_positive_added' WHEN hit THEN 'dense_retrieved_positive' ELSE 'dense_retrieved_negative' END AS reason,
      CAST(retrieval_rank AS INTEGER) AS retrieval_rank, retrieval_score, 'dense' AS retrieval_backend, coalesce(t, 0) AS true_relevant_count, CAST(sum(hit::INT) OVER (PARTITION BY c0.qid) AS BIGINT) AS candidate_relevant_count
      FROM c0 LEFT JOIN tc ON c0.qid = tc.qid)"""


def _labelled(spark, sf_dir, ensure=True):
    v, got = _dense(spark, sf_dir, 50)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    pos = q.join(v.select(F.col("vec_id").alias("doc_id"), "label"), "label").where("qid <> doc_id").select("qid", "doc_id")
    return R.labelled(got, pos, "dense", "dense", ensure)


@query(f"{_LAB} SELECT * FROM cl")
def ensure_positives(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(f"""{_LAB} SELECT count(*) AS num_queries, CAST(sum(n) AS BIGINT) AS num_pairs, CAST(sum(t) AS BIGINT) AS total_true, CAST(sum(c) AS BIGINT) AS total_candidate,
             round(sum(c) / sum(t), 6) AS candidate_recall FROM (SELECT qid, count(*) AS n, max(true_relevant_count) AS t, max(candidate_relevant_count) AS c FROM cl WHERE reason <> 'dense_missed_positive_added' GROUP BY qid)""".replace(
    "CAST(sum(hit::INT) OVER (PARTITION BY c0.qid) AS BIGINT)", "CAST(sum(CASE WHEN added = 0 THEN hit::INT ELSE 0 END) OVER (PARTITION BY c0.qid) AS BIGINT)"))
def candidate_recall(spark, sf_dir):
    return R.exported_totals(_labelled(spark, sf_dir, ensure=False))


_TURNS = """tn AS (SELECT *, coalesce(nullif(trim(dia_id, ' '), ''), session || ':' || turn_no) AS tid FROM dialogue_turns WHERE said IS NOT NULL AND trim(said, ' ') <> ''),
    td AS (SELECT sample_id, sample_id || '::' || tid AS doc_id, tid, TRY_CAST(regexp_extract(session, '^session_([0-9]+)$', 1) AS INTEGER) AS session_no, turn_no,
      concat_ws(', ', 'session: ' || session, 'time: ' || session_time, 'speaker: ' || speaker, 'text: ' || said) AS doc
      FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, tid ORDER BY turn_id DESC) AS z FROM tn) WHERE z = 1)"""


@query(f"WITH {_TURNS} SELECT * FROM td")
def dialogue_docs(spark, sf_dir):
    return A.dialogue_docs(rows_of(spark, sf_dir, "dialogue_turns"))


@query()
def dialogue_evidence(spark, sf_dir):
    """Evidence ids of questions resolved to turns; SQL can't undo the packing, so no statement is given."""
    qa = rows_of(spark, sf_dir, "dialogue_qa")
    return A.evidence_docs(unpack(qa, ["qa_id"], "evidence"), qa, A.dialogue_docs(rows_of(spark, sf_dir, "dialogue_turns")))


@query(f"""WITH {_TURNS}, dt AS {_TOKENS.format(k='sample_id, doc_id', c='doc', f='td')}, dl AS (SELECT sample_id, doc_id, len(toks) AS dl FROM dt),
           st AS (SELECT sample_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY sample_id),
           po AS (SELECT sample_id, doc_id, term, count(*) AS tf FROM (SELECT sample_id, doc_id, unnest(toks) AS term FROM dt) GROUP BY ALL),
           fr AS (SELECT sample_id, term, count(*) AS df FROM po GROUP BY ALL),
           qt AS (SELECT sample_id, qid, term, count(*) AS qtf FROM (SELECT sample_id, qid, unnest(toks) AS term FROM {_TOKENS.format(k='sample_id, qid', c='question', f='(SELECT sample_id, qa_id AS qid, question FROM dialogue_qa)')}) GROUP BY ALL),
           sc AS (SELECT sample_id, qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / greatest(tf + 1.2 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1e-9)), 1e-9)), 6) AS bm25
             FROM qt JOIN po USING (sample_id, term) JOIN fr USING (sample_id, term) JOIN dl USING (sample_id, doc_id) JOIN st USING (sample_id) GROUP BY ALL)
           SELECT sample_id, qid, doc_id, bm25, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, qid ORDER BY bm25 DESC, doc_id) AS rank FROM sc) WHERE rank <= 10""")
def dialogue_bm25(spark, sf_dir):
    """Top 10 turns of each question within its own dialogue, with statistics of that dialogue."""
    docs = A.dialogue_docs(rows_of(spark, sf_dir, "dialogue_turns"))
    q = rows_of(spark, sf_dir, "dialogue_qa").select("sample_id", F.col("qa_id").alias("qid"), "question")
    return R.bm25(docs, "doc", q, "question", 10, part=["sample_id"])


@query("""WITH q AS (SELECT DISTINCT query FROM gt_items WHERE query IS NOT NULL), c AS (SELECT DISTINCT query FROM examples WHERE query IS NOT NULL)
          SELECT count(*) AS num_queries, count(c.query) AS matched, round(count(c.query) / count(*), 6) AS ratio, CASE WHEN count(c.query) / count(*) >= 0.8 THEN 'id_match' ELSE 'qrels' END AS supervision
          FROM q LEFT JOIN c USING (query)""")
def id_match_ratio(spark, sf_dir):
    """How many keys of one side stand in the other, and the supervision that follows from it."""
    q = rows_of(spark, sf_dir, "gt_items").select("query").where("query is not null").distinct()
    c = rows_of(spark, sf_dir, "examples").select("query").where("query is not null").distinct().withColumn("hit", F.lit(1))
    j = q.join(c, "query", "left").agg(F.count(F.lit(1)).alias("num_queries"), F.count("hit").alias("matched"))
    share = S.ratio(F.col("matched"), F.col("num_queries"))
    return j.select("num_queries", "matched", F.round(share, 6).alias("ratio"), F.when(share >= 0.8, "id_match").otherwise("qrels").alias("supervision"))


@query("""WITH t AS (SELECT pred_id, score AS y, retrieval_score AS n FROM predictions WHERE score IS NOT NULL AND isfinite(score) AND retrieval_score IS NOT NULL)
          SELECT pred_id, round(1 / (1 + exp(-least(greatest(-y - -n, -80.0), 80.0))), 6) AS yes_no, round(1 / (1 + exp(-y)), 6) AS sigmoid,
            round(ln(least(greatest(y, 1e-6), 1 - 1e-6) / (1 - least(greatest(y, 1e-6), 1 - 1e-6))), 5) AS logit FROM t""")
def score_functions(spark, sf_dir):
    """Scalar score functions: yes/no from two log probabilities, sigmoid, clipped logit."""
    p = rows_of(spark, sf_dir, "predictions").where("score is not null and retrieval_score is not null and not isnan(score) and abs(score) < double('infinity')")
    y, n = F.col("score"), F.col("retrieval_score")
    return p.select("pred_id", F.round(S.yes_no_score(-y, -n), 6).alias("yes_no"), F.round(S.sigmoid(y), 6).alias("sigmoid"), F.round(S.logit(y), 5).alias("logit"))


