"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import worker_files

#: query -> module that defines a function of that name, and ORACLE_SQL there if SQL can express the query.
MODULES = {
    "op1_packing": "packing",
    "op2_toxicity": "toxicity",
    "op3_trie_bpe": "trie_bpe",
    "op4_url_filter": "url_filter",
    "op5_jaccard_join": "jaccard_join",
    "op6_cover_tree": "cover_tree",
    "op7_language_id": "language_id",
    "op8_quality_net": "quality_net",
    "op9_simple8b": "simple8b",
    "op10_line_rules": "line_rules",
}


def _bound(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        worker_files(spark, "tidewatch")
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
