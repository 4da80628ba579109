"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> module that defines a function of that name.
MODULES = {
    "op5_sentencepiece": "sentencepiece_codec",
    "op1_quality_classifier": "quality_nbsvm",
    "op8_line_dedup": "line_dedup",
    "op9_jaccard_join": "jaccard_join",
    "op2_secret_scans": "secret_scan",
    "op3_language_id": "language_id",
    "op4_best_fit_packing": "packing",
    "op10_url_filters": "url_filters",
    "op6_topk_search": "topk_search",
    "op7_quality_rules": "quality_rules",
}
#: Further queries, which SQL can hold to account: a module's function of this name.
PARTS = {"secret_counts": "secret_scan", "quality_base": "quality_rules", "url_rules": "url_filters"}
#: Modules with an ``ORACLE`` dict of query name -> DuckDB SQL.
ORACLES = ("topk_search", "line_dedup", "jaccard_join", "secret_scan", "quality_rules", "url_filters")


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{m}"), name) for name, m in (MODULES | PARTS).items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ORACLES:
        out |= importlib.import_module(f"{__package__}.{m}").ORACLE
    return out
