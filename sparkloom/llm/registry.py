"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from sparkloom.llm import bpe, content_sort, crf_language, decontaminate, filter_audit, jaccard, kdtree, mpeg, pii, quotes, sessions, toxicity, url_filter

QUERIES = {
    "op1_kdtree": kdtree.op1_kdtree,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": crf_language.op3_language,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quotes": quotes.op7_quotes,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_mpeg": mpeg.op9_mpeg,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_exact_dedup": content_sort.op11_exact_dedup,
    "op12_sessions": sessions.op12_sessions,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_quotes": quotes.OP7_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_exact_dedup": content_sort.OP11_SQL,
    "op12_sessions": sessions.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
