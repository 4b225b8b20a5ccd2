"""The queries of this subpackage: one thin query per operator, with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: module → name of its query; each module has ``query(spark, folder)`` and may have ``SQL``
OPERATORS = {
    "sharding": "op1_minimax_shards",
    "tokens": "op2_simple8b_tokens",
    "extraction": "op3_main_text",
    "scoring": "op4_bloom_lm",
    "minhash": "op5_minmax_dedup",
    "decontamination": "op6_decontaminate",
    "language": "op7_language_id",
    "urls": "op8_url_rules",
    "mixing": "op9_pareto_mix",
    "exact": "op10_block_naming",
    "toxicity": "op11_nb_toxicity",
    "search": "op12_term_search",
    "whitening": "op13_polar_whitening",
}


def _modules():
    return {name: importlib.import_module(f"tarnlake.llm.{module}") for module, name in OPERATORS.items()}


def queries() -> dict[str, Query]:
    return {name: module.query for name, module in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _modules().items() if getattr(module, "SQL", None)}
