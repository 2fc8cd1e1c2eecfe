"""Queries of the operators over the given tables, and SQL for those that SQL can state."""

from __future__ import annotations

from . import (crf_langid, hard_negatives, imatch, mixture, quality_votes, sentencepiece_codec, signature_tree, simhash_pivots,
               substring_fm, token_files, tool_calls, whitening, wrapper_html)

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_token_files": token_files.op2_token_files,
    "op3_tool_calls": tool_calls.op3_tool_calls,
    "op4_fm_substring": substring_fm.op4_fm_substring,
    "op5_quality_votes": quality_votes.op5_quality_votes,
    "op6_crf_language": crf_langid.op6_crf_language,
    "op7_imatch": imatch.op7_imatch,
    "op8_signature_tree": signature_tree.op8_signature_tree,
    "op9_wrapper_html": wrapper_html.op9_wrapper_html,
    "op10_mix_sources": mixture.op10_mix_sources,
    "op11_angular_negatives": hard_negatives.op11_angular_negatives,
    "op12_simhash_pivots": simhash_pivots.op12_simhash_pivots,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op3_tool_calls": tool_calls.ORACLE,
    "op10_mix_sources": mixture.ORACLE,
    "op11_angular_negatives": hard_negatives.ORACLE,
}
