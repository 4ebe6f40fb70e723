"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filtra.llm import (ann, classifier, jaccard, maxent, mixing, packing, phrases, pii, rules,
                        sharding, suffixes, superkmers, variants)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1,
    "op2_mixing": mixing.op2,
    "op3_packing": packing.op3,
    "op4_nearest_neighbours": ann.op4,
    "op5_suffix_dedup": suffixes.op5,
    "op6_lm_scores": maxent.op6,
    "op7_quality_classifier": classifier.op7,
    "op8_quality_rules": rules.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_sharding": sharding.op10,
    "op11_spelling_variants": variants.op11,
    "op12_collocations": phrases.op12,
    "op13_superkmer_dedup": superkmers.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": rules.ORACLE,
    "op12_collocations": phrases.ORACLE,
    "op13_superkmer_dedup": superkmers.ORACLE,
}
