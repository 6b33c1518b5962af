"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is executed in full through the ``noop``
sink (no collect). ``baseline_loop_sec`` times the reference's plan shape for
the lineitem tie-out — one three-way re-join and count per compared column —
next to our single-join plan (``tieout_lineitem_summary``).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from ledgerline.operators.tieout import Tieout  # noqa: E402
from ledgerline.plans.registry import PLANS, load_all  # noqa: E402
from ledgerline.session import get_spark  # noqa: E402
from ledgerline.sources.fixtures import fixture  # noqa: E402
from ledgerline.sources.tables import read_table  # noqa: E402

LINE_KEY = ["l_orderkey", "l_linenumber"]


def _run(df) -> float:
    t0 = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def reference_loop(spark, f, t, key, cols):
    """The reference's shape: per column, shared keys (f join t) x f x t, count."""
    fa, ta = f.alias("f"), t.alias("t")
    jcond = [F.col(f"f.{k}") == F.col(f"t.{k}") for k in key]
    shared = fa.join(ta, jcond).select(*[F.col(f"f.{k}").alias(k) for k in key]).alias("s")
    total = 0.0
    for c in cols:
        cond = ([F.col(f"s.{k}") == F.col(f"f.{k}") for k in key]
                + [F.col(f"s.{k}") == F.col(f"t.{k}") for k in key])
        q = (shared.join(fa, [F.col(f"s.{k}") == F.col(f"f.{k}") for k in key])
             .join(ta, cond).filter(~F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")))
             .agg(F.count(F.lit(1)).alias("diff")))
        total += min(_run(q), _run(q))
    return round(total, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    load_all()
    _run(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())  # warm-up

    line = read_table(spark, sf_dir, "lineitem")
    line_to = fixture(spark, sf_dir, "line_to")
    orders = read_table(spark, sf_dir, "orders")
    orders_to = fixture(spark, sf_dir, "orders_to")
    lt = Tieout(line, line_to, LINE_KEY, name="LINE")
    ot = Tieout(orders, orders_to, ["o_orderkey"], name="ORD")

    queries = {
        "tieout_lineitem_overview": lambda: lt.overview,
        "tieout_lineitem_summary": lambda: lt.summary,
        "tieout_lineitem_detail": lambda: lt.detail(),
        "tieout_orders_summary": lambda: ot.summary,
        "tieout_orders_detail": lambda: ot.detail(),
    }
    for name in ("tieout_overview", "tieout_columns_summary", "tieout_summary_duplicate_keys",
                 "tieout_hot_key_summary", "sum_detail",
                 "copy_refresh_plan", "role_delta", "model_audit", "snapshot_changes", "snapshot_content",
                 "name_parse"):
        queries[name] = (lambda n=name: PLANS[n](spark, sf_dir))

    # Best of two runs: the first run of a plan also pays JIT / codegen warm-up.
    times = {}
    for name, build in queries.items():
        times[name] = min(_run(build()), _run(build()))

    baseline = None
    if os.environ.get("BENCH_BASELINE", "1") == "1":
        baseline = reference_loop(spark, line, line_to, LINE_KEY, lt.shared)

    total = round(sum(times.values()), 3)
    out = {"metric": "total_query_sec", "value": total, "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}
    if baseline is not None:
        out["baseline_loop_sec"] = baseline
        out["speedup_single_join_vs_loop"] = round(baseline / max(times["tieout_lineitem_summary"], 1e-3), 2)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
