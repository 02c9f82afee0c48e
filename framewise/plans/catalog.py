"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

AREAS = ("frames", "files", "quality", "splitting", "tensor_ops", "evaluation", "full_frames", "probing", "curves", "run_tables")


def _collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for area in AREAS:
        registry = importlib.import_module(f"framewise.plans.{area}").reg
        queries.update(registry.queries)
        sql.update(registry.sql)
    return queries, sql


QUERIES, SQL = _collect()
