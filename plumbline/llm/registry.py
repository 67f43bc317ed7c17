"""Queries of this package by name, and their SQL where there is any."""

from __future__ import annotations

import importlib

MODULES = "toxicity packing minhash language_id fertility exact_dedup html_extract url_filter mixing sharding".split()


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= importlib.import_module(f"plumbline.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"plumbline.llm.{m}"), "ORACLE", {})
    return out
