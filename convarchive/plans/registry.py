"""All registered queries of the library and their SQL.

Names start with the operator's id in the inventory. Plans register themselves with ``query``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLANS = ["merge", "threads", "topics", "texts", "projects", "indexes", "galleries", "repairs", "lineages", "libraries", "intakes", "scans", "streams"]


def query(name: str, sql: str | None = None):
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under ``name``, with SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


for _plan in PLANS:
    import_module(f"convarchive.plans.{_plan}")
