"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

import importlib

#: Query name -> module with query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_decontamination": "decontaminate",
    "op3_simhash": "simhash",
    "op4_secret_scan": "secret_scan",
    "op5_mixing": "mixing",
    "op6_token_counts": "token_counts",
    "op7_line_dedup": "line_dedup",
    "op8_language_id": "language_id",
    "op9_quality": "quality",
    "op10_exact_dedup": "exact_dedup",
    "op11_fill_in_middle": "fim",
    "op12_toxicity": "toxicity",
    "op13_sale_enrichment": "sale_enrichment",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}
