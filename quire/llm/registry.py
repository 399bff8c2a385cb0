"""Queries of the corpus operators, and the SQL of those that SQL can express."""

import corpus_pipeline
from quire.llm import mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, top_k


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_sharding": sharding.op3_sharding,
        "op4_top_k": top_k.op4_top_k,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_packing": packing.op7_packing,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_mixing": mixing.op9_mixing,
        "op10_pii": pii.op10_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": top_k.ORACLE, "op9_mixing": mixing.ORACLE}
