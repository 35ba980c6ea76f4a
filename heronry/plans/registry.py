"""All queries of the engine's own operators with their DuckDB oracles."""

from __future__ import annotations

from importlib import import_module

#: Modules whose ``query`` holds queries and oracles.
MODULES = ("heronry.plans.text_queries", "heronry.plans.file_queries", "heronry.plans.graph_queries", "heronry.plans.usage_queries", "heronry.plans.audit_queries", "heronry.plans.parser_queries", "heronry.plans.code_queries", "heronry.plans.resolve_queries", "heronry.plans.report_queries", "heronry.plans.answer_queries", "heronry.plans.ledger_queries", "heronry.plans.build_queries", "heronry.plans.flow_queries", "heronry.plans.index_queries", "heronry.plans.sheet_queries", "heronry.plans.hierarchy_queries", "heronry.plans.page_queries", "heronry.plans.anchored_queries")


def queries() -> dict:
    """Name to ``f(spark, sf_dir) -> DataFrame``."""
    return {k: f for m in MODULES for k, f in import_module(m).query.queries.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL over the same tables."""
    return {k: s for m in MODULES for k, s in import_module(m).query.oracles.items()}
