"""Canonical schemas."""

from __future__ import annotations

EXAMPLE = "source_index long, group_key string, instruction string, query string, query_id string, doc_id string, doc string, label double, raw_label double, reason string"
CANDIDATE = (
    "dataset string, query_id string, qid string, doc_id string, query string, doc string, labels double, reason string, retrieval_rank int, "
    "retrieval_score double, retrieval_backend string, true_relevant_count long, candidate_relevant_count long"
)
QRELS = "qid string, doc_id string, score double"
GROUND_TRUTH = "query string, raw_page_ids string, doc_ids array<string>"
TURN = "sample_id string, session string, session_no int, session_time string, turn_no int, speaker string, dia_id string, said string"

#: Names under which the logical fields of records stand, in order of preference.
ALIASES = {
    "query": ("query", "question", "q"),
    "query_id": ("query_id", "qid"),
    "doc_id": ("doc_id", "docid", "pid", "corpus_id"),
    "row_id": ("id", "_id", "qid", "query_id", "doc_id", "docid", "pid", "corpus_id"),
    "row_text": ("text", "contents", "query", "question"),
    "recall_docs": ("docs", "documents", "recall", "items"),
    "recall_doc_id": ("doc_id", "page_id", "PageId", "id"),
    "sample_id": ("sample_id", "id", "conversation_id", "conv_id"),
    "qrel_qid": ("qid", "query-id", "query_id", "query"),
    "qrel_doc": ("pid", "pids", "corpus-id", "corpus_id", "docid", "doc_id"),
    "qrel_score": ("score", "relevance", "label"),
}
