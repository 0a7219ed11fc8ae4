"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_secrets, op2_quality, op3_kneser_ney, op4_mixing, op5_token_ids, op6_warc, op7_sentencepiece, op8_jaccard, op9_topk, op10_suffix_dedup, op11_embedding_dedup, op12_collocations, op13_periodic_runs

QUERIES = {
    "op1_secret_scans": op1_secrets.query,
    "op2_quality_rules": op2_quality.query,
    "op3_lm_scoring": op3_kneser_ney.query,
    "op4_mixing": op4_mixing.query,
    "op5_token_ids": op5_token_ids.query,
    "op6_warc": op6_warc.query,
    "op7_sentencepiece": op7_sentencepiece.query,
    "op8_jaccard_join": op8_jaccard.query,
    "op9_exact_topk": op9_topk.query,
    "op10_suffix_dedup": op10_suffix_dedup.query,
    "op11_embedding_dedup": op11_embedding_dedup.query,
    "op12_collocations": op12_collocations.query,
    "op13_periodic_runs": op13_periodic_runs.query,
}

ORACLES: dict[str, str] = {
    "op6_warc": op6_warc.ORACLE,
    "op8_jaccard_join": op8_jaccard.ORACLE,
    "op9_exact_topk": op9_topk.ORACLE,
    "op11_embedding_dedup": op11_embedding_dedup.ORACLE,
    "op12_collocations": op12_collocations.ORACLE,
}
