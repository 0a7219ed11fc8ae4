"""All queries of the engine by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import answer_queries, dialogue_queries, evidence_queries, lexicon_queries, matching_queries, note_queries, ordered_queries, question_queries, record_queries, report_queries, retrieval_queries, search_queries, similarity_queries, store_queries, streaming_queries, text_queries, topk_queries

MODULES = (text_queries, retrieval_queries, ordered_queries, evidence_queries, streaming_queries, question_queries, matching_queries, search_queries, record_queries, topk_queries, store_queries, lexicon_queries, similarity_queries, dialogue_queries, answer_queries, report_queries, note_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
