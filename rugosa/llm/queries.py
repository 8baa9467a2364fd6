"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    divergence,
    filter_audit,
    fingerprints,
    htmltext,
    langid,
    line_dedup,
    mixing,
    near_vectors,
    neighbours,
    ngram_join,
    packing,
    pii,
    quality,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_pack_documents": packing.op2_pack_documents,
    "op3_near_vectors": near_vectors.op3_near_vectors,
    "op4_quality": quality.op4_quality,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_html_text": htmltext.op8_html_text,
    "op9_language": langid.op9_language,
    "op10_personal_data": pii.op10_personal_data,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_nearest_vectors": neighbours.op13_nearest_vectors,
}
ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
