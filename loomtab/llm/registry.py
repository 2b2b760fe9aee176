"""The queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from importlib import import_module

#: Query name: (module, DuckDB SQL attribute or None).
_QUERIES = {
    "op1_source_mixing": ("mixing", None),
    "op2_license_scan": ("license_scan", None),
    "op3_exact_dedup": ("exact_dedup", "ORACLE"),
    "op4_personal_data": ("personal_data", None),
    "op5_quality": ("quality", None),
    "op6_token_counts": ("token_counts", None),
    "op7_language_id": ("language_id", None),
    "op8_nearest_neighbours": ("neighbours", None),
    "op9_byte_bpe": ("byte_bpe", None),
    "op10_jaccard_join": ("jaccard_join", "ORACLE"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
