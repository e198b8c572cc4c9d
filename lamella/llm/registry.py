"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from lamella.llm import class_lm, importance, mixing, pipeline, quality_rules, sentencepiece_codec, sharding, simhash, suffix_array, topk, toxicity

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_toxicity": toxicity.query,
    "op3_simhash": simhash.query,
    "op4_mixing": mixing.query,
    "op5_sentencepiece": sentencepiece_codec.query,
    "op6_class_lm": class_lm.query,
    "op7_topk": topk.query,
    "op8_importance": importance.query,
    "op9_quality_rules": quality_rules.query,
    "op10_suffix_array": suffix_array.query,
    "pipeline": pipeline.run,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op7_topk": topk.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
}

if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
