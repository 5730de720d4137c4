"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("fingerprint", "urlfilter", "packing", "decontaminate", "toxicity", "mainhtml", "suffix", "cotrain", "simhash", "licence")


def queries() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"corpuslens.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"corpuslens.llm.{m}").ORACLE.items()}
