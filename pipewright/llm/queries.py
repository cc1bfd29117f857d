"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, collision_ann, compression_rules, jaccard_join, language_id, lattice_lm, mixing, packing, secrets, url_filter

MODULES = [language_id, secrets, mixing, chat_format, lattice_lm, compression_rules, collision_ann, packing, url_filter, jaccard_join]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in MODULES for name in dir(m) if name.startswith("op") and name[2:].split("_")[0].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
