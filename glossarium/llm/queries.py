"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query -> module that has it; a module's ORACLE holds its SQL.
MODULES = {
    "op1_decontamination": "decontamination",
    "op2_token_counts": "token_counts",
    "op3_packing": "packing",
    "op4_near_dedup": "near_dedup",
    "op5_quality": "quality",
    "op6_toxicity": "toxicity",
    "op7_pseudonyms": "pseudonyms",
    "op8_html_extraction": "html_extraction",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_exact_dedup": "exact_dedup",
    "op11_license_scan": "license_scan",
    "op12_collocations": "collocations",
    "op13_vector_codes": "vector_codes",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES.values():
        out |= getattr(import_module(f"{__package__}.{module}"), "ORACLE", {})
    return out
