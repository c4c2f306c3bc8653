"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    bpe,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secrets,
    suffix_dedup,
    token_alignment,
    vectors,
    warc,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_language_id": language_id.op6_language_id,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_nearest_vectors": vectors.op8_nearest_vectors,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_warc": warc.op11_warc,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op11_warc": warc.OP11_SQL,
}
