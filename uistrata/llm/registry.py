"""Queries of the corpus operators and the SQL that checks them, where SQL can."""

from __future__ import annotations

import importlib

#: query name: module; a module's ORACLE_SQL is given where SQL expresses the query.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_source_mix": "source_mix",
    "op3_license_scan": "license_scan",
    "op4_language_id": "language_id",
    "op5_secret_scan": "secret_scan",
    "op6_spotsigs": "spotsigs",
    "op7_packing": "packing",
    "op8_gru_lm": "gru_lm",
    "op9_minhash": "minhash",
    "op10_exact_dedup": "exact_dedup",
    "op11_url_filter": "url_filter",
    "op12_hard_negatives": "hard_negatives",
    "op13_resampling": "resampling",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
