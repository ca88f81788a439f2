"""First-stage retrieval (BM25, dense vectors) and candidate lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import l2_normalize
from ..functions.text import bm25_tokens
from ..storage import materialize, small_or_shuffled

#: The usual parameters of BM25.
K1, B = 1.2, 0.75


def postings(corpus: DataFrame, text: str, part: Sequence[str] = ()) -> DataFrame:
    """(*part, doc_id, term, tf) of every document."""
    words = corpus.select(*part, "doc_id", F.explode(bm25_tokens(F.col(text))).alias("term"))
    return words.groupBy(*part, "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(corpus: DataFrame, text: str, part: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lengths, frequencies, size): dl of every document, df and idf of every term, number and mean length of documents.

    Empty documents count; with ``part`` the statistics are those of each part by itself.
    """
    lengths = corpus.select(*part, "doc_id", F.size(bm25_tokens(F.col(text))).alias("dl"))
    size = lengths.groupBy(*part).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = postings(corpus, text, part).groupBy(*part, "term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(size, list(part)) if part else df.crossJoin(F.broadcast(size))  # size is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return lengths, joined.select(*part, "term", "df", idf.alias("idf")), size


def bm25(
    corpus: DataFrame, text: str, queries: DataFrame, query: str, k: int, part: Sequence[str] = (), qid: str = "qid", k1: float = K1, b: float = B
) -> DataFrame:
    """(*part, qid, doc_id, bm25, rank): the k best documents of each query; documents without a common term never come.

    The corpus is tokenised once.  Only postings with a term of a query go on, as the semi-join with the queries' terms
    comes before the counts of a term within a document; they carry the length of their document and are written once,
    for the frequencies and for the scores.  Scores are rounded to six
    places before they are ranked, ties go by doc_id.
    """
    wanted = queries.select(*part, qid, F.explode(bm25_tokens(F.col(query))).alias("term"))
    wanted = materialize(wanted.groupBy(*part, qid, "term").agg(F.count(F.lit(1)).alias("qtf")), "query-terms")
    tokens = corpus.select(*part, "doc_id", bm25_tokens(F.col(text)).alias("_tokens"))
    # the empty term stands for the document itself, so that one pass gives the statistics of the corpus as well
    every = F.concat(F.array(F.lit("")), F.col("_tokens"))
    words = tokens.select(*part, "doc_id", F.size("_tokens").alias("dl"), F.explode(every).alias("term"))
    parts = queries.select(*part).distinct().withColumn("term", F.lit("")) if part else queries.sparkSession.createDataFrame([("",)], "term string")
    terms = wanted.select(*part, "term").distinct().unionByName(parts)
    found = words.join(small_or_shuffled(terms), [*part, "term"], "left_semi")
    found = materialize(found.groupBy(*part, "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    size = found.where("term = ''").groupBy(*part).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    found = found.where("term <> ''")
    df = found.groupBy(*part, "term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(size, list(part)) if part else df.crossJoin(F.broadcast(size))  # size is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.select(*part, "term", "avgdl", idf.alias("idf")).join(small_or_shuffled(wanted), [*part, "term"])
    hits = found.join(df, [*part, "term"])
    norm = F.greatest(F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))), F.lit(1e-9))
    score = F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm)
    scored = hits.groupBy(*part, qid, "doc_id").agg(F.round(score, 6).alias("bm25"))
    return top_k(scored, [*part, qid], "bm25", "doc_id", k)


def top_k(scored: DataFrame, keys: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank; the group limit runs before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries and documents of one tile of a dense search.
QUERY_BLOCK, DOC_BLOCK = 2_000, 20_000


def dense(corpus: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", normalize: bool = True) -> DataFrame:
    """(qid, doc_id, dense, rank): the k nearest vectors of each query by inner product, the query's own id left out.

    queries is a stated set, compared with all rows: both are cut into blocks, each block of the one meets each of the
    other in a tile, and a tile gives the k best of each of its queries by one matrix product.  Null vectors take no
    part.
    """
    unit = (lambda c: l2_normalize(c)) if normalize else (lambda c: c.cast("array<double>"))
    sides, counts = [], []
    for rows, name, block in ((queries, "qid", QUERY_BLOCK), (corpus, "doc_id", DOC_BLOCK)):
        rows = rows.where(F.col(vector).isNotNull()).select(F.col(name).alias("id"), unit(F.col(vector)).alias("v"))
        counts.append(max(1, -(-rows.count() // block)))
        sides.append(rows)
    (q, d), (n_q, n_d) = sides, counts
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.lit(0).alias("side"), own(n_q).alias("i"), every(n_d).alias("j"), "id", "v")
    d = d.select(F.lit(1).alias("side"), own(n_d).alias("j"), every(n_q).alias("i"), "id", "v")
    tiles = q.unionByName(d).repartition("i", "j").sortWithinPartitions("i", "j", "side", "id")
    kind = tiles.schema["id"].dataType.simpleString()
    best = tiles.mapInPandas(_nearest(k), f"qid {kind}, doc_id {kind}, dense double")
    return top_k(best, ["qid"], "dense", "doc_id", k)


def _nearest(k: int):
    def answer(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        is_doc = b["side"].to_numpy() == 1
        qids, dids = b["id"].to_numpy()[~is_doc], b["id"].to_numpy()[is_doc]
        if not len(qids) or not len(dids):
            return
        q, d = (np.stack(b["v"].to_numpy()[m]) for m in (~is_doc, is_doc))
        for i in range(0, len(qids), 256):
            scores = np.round(q[i : i + 256] @ d.T, 6) + 0.0
            scores[qids[i : i + 256, None] == dids[None, :]] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # documents come by id, so ties do too
            got = np.take_along_axis(scores, order, 1)
            row, col = np.nonzero(got > -np.inf)
            yield pd.DataFrame({"qid": qids[i + row], "doc_id": dids[order[row, col]], "dense": got[row, col]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            key = b["i"].to_numpy().astype(np.int64) * (1 << 32) + b["j"].to_numpy()
            for part in np.split(np.arange(len(b)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                if not len(part):
                    continue
                if held and (held[-1]["i"].iloc[-1], held[-1]["j"].iloc[-1]) != (b["i"].iloc[part[0]], b["j"].iloc[part[0]]):
                    yield from answer(pd.concat(held, ignore_index=True))
                    held = []
                held.append(b.iloc[part])
        if held:
            yield from answer(pd.concat(held, ignore_index=True))

    return run


def labelled(candidates: DataFrame, positives: DataFrame, score: str, backend: str, ensure: bool = False) -> DataFrame:
    """Candidate rows with labels 10 or 0, reasons, and the counts of true and of retrieved positives of each query.

    With ``ensure`` the positives that were missed follow after the list, with score 0 and ranks in order of doc_id.
    """
    pos = positives.select("qid", "doc_id").distinct().withColumn("_pos", F.lit(True))
    rows = candidates.select("qid", "doc_id", F.col("rank").alias("retrieval_rank"), F.col(score).alias("retrieval_score"))
    got = rows.join(pos, ["qid", "doc_id"], "left").withColumn("_added", F.lit(0))
    if ensure:
        missed = pos.join(rows.select("qid").distinct(), "qid", "left_semi").join(rows, ["qid", "doc_id"], "left_anti")
        last = rows.groupBy("qid").agg(F.max("retrieval_rank").alias("_last"))
        w = Window.partitionBy("qid").orderBy("doc_id")
        missed = missed.join(last, "qid").select("qid", "doc_id", (F.row_number().over(w) + F.col("_last")).alias("retrieval_rank"), F.lit(0.0).alias("retrieval_score"), "_pos", F.lit(1).alias("_added"))
        got = got.unionByName(missed)
    hit = F.coalesce("_pos", F.lit(False))
    reason = F.when(F.col("_added") == 1, F.lit(f"{backend}_missed_positive_added")).when(hit, F.lit(f"{backend}_retrieved_positive")).otherwise(F.lit(f"{backend}_retrieved_negative"))
    got = got.withColumn("labels", F.when(hit, 10.0).otherwise(0.0)).withColumn("reason", reason)
    true = pos.groupBy("qid").agg(F.count(F.lit(1)).alias("true_relevant_count"))
    inside = got.groupBy("qid").agg(F.sum((F.col("labels") > 0).cast("long")).alias("candidate_relevant_count"))
    got = got.join(true, "qid", "left").join(inside, "qid").fillna(0, ["true_relevant_count"])
    return got.select("qid", "doc_id", "labels", "reason", "retrieval_rank", "retrieval_score", F.lit(backend).alias("retrieval_backend"), "true_relevant_count", "candidate_relevant_count")


def exported_totals(candidates: DataFrame, qid: str = "qid") -> DataFrame:
    """One row: queries, pairs, true and retrieved positives, micro candidate recall."""
    per = candidates.groupBy(qid).agg(F.count(F.lit(1)).alias("n"), F.max("true_relevant_count").alias("t"), F.max("candidate_relevant_count").alias("c"))
    recall = F.coalesce(F.try_divide(F.sum("c"), F.nullif(F.sum("t"), F.lit(0))), F.lit(0.0))
    return per.agg(
        F.count(F.lit(1)).alias("num_queries"), F.sum("n").alias("num_pairs"), F.sum("t").alias("total_true"), F.sum("c").alias("total_candidate"), F.round(recall, 6).alias("candidate_recall")
    )


def hash_order(seed: int, *cols: Column) -> Column:
    """Deterministic pseudorandom order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
