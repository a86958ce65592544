"""Queries and SQL of the operators, for __spark_entry__.py."""

from __future__ import annotations

from . import hostrules, language, licences, mixing, nearest, ngramjoin, pieces, quality, repeats, toxicity

QUERIES = {
    "op1_ngram_join": ngramjoin.op1_ngram_join,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality": quality.op4_quality,
    "op5_language": language.op5_language,
    "op6_host_rules": hostrules.op6_host_rules,
    "op7_mix": mixing.op7_mix,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_nearest": nearest.op9_nearest,
    "op10_suffix_dedup": repeats.op10_suffix_dedup,
}

ORACLE_SQL = {
    "op2_licence_scan": licences.OP2_SQL,
    "op6_host_rules": hostrules.OP6_SQL,
    "op7_mix": mixing.OP7_SQL,
}
