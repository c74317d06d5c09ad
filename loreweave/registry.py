"""Every registered query and its DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from loreweave.plans import eval_plans, graph_plans, language_plans, store_plans, text_plans, vector_plans

_MODULES = (vector_plans, store_plans, text_plans, graph_plans, eval_plans, language_plans)


def queries() -> dict:
    return {name: query for module in _MODULES for name, (query, _) in module.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.PLANS.items() if sql}
