"""Registry of the named queries the driver runs (Spark side and DuckDB oracle side).

Each query is a function ``(spark, sf_dir) -> DataFrame`` built from the library's
operators; its oracle is independent SQL over the raw driver tables.  Queries whose
semantics SQL cannot state (trained models, stateful streams) register no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise


MODULES = ["q_validate", "q_profile", "q_collect", "q_sources", "q_checker", "q_merge",
           "q_retrieve", "q_evaluate", "q_report", "q_model", "q_stream", "q_more", "q_stores"]
