"""Queries of this package and the SQL that some of them must agree with."""

from __future__ import annotations

from rostrum.llm import bpe, filter_audit, language_id, line_dedup, mixing, ngram_join, private_spans, quality_model, quality_rules, target_resampling, tiff, token_counts, warc

QUERIES = {
    "op1_quality_classifier": quality_model.op1_quality_classifier,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_bpe_codec": bpe.op4_bpe_codec,
    "op5_media_tiff": tiff.op5_media_tiff,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_warc": warc.op8_warc,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_private_spans": private_spans.op11_private_spans,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_target_resampling": target_resampling.op13_target_resampling,
}

ORACLES = {
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_target_resampling": target_resampling.OP13_SQL,
}
