"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, audit, balanced, decontaminate, language, mainhtml, neardup, neighbours, packing, secrets, sharding, suffixdedup, tokencounts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokencounts.op1_token_counts,
    "op2_main_text": mainhtml.op2_main_text,
    "op3_packing": packing.op3_packing,
    "op4_secrets": secrets.op4_secrets,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_suffix_dedup": suffixdedup.op6_suffix_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_language": language.op8_language,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_neardup": neardup.op10_neardup,
    "op11_balanced_packing": balanced.op11_balanced_packing,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op4_secrets": secrets.ORACLE, "op13_filter_audit": audit.ORACLE}
