"""Registry of named queries: a Spark plan and, where SQL can say it, an oracle.

Each plan takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables in ``sf_dir``. The oracle is independent ANSI SQL (DuckDB dialect)
over the same base tables, usually written the way the reference phrases the
question, not the way the Spark plan computes it.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name!r} registered twice")
        PLANS[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from ledgerline.plans import (  # noqa: F401
        tieout_plans, drift_plans, access_plans, model_plans, snapshot_plans, names_plans, order_plans,
    )
