"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Module of each query.
MODULES = ("q_toxic", "q_print", "q_pii", "q_shard", "q_url", "q_exact", "q_mix", "q_pack", "q_near", "q_lm")


def _modules():
    return [import_module(f"lumenquarry.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
