"""Run registered queries against their DuckDB oracles and compare results.

Used by the tests and as a command: ``python -m ledgerline.plans.check SF_DIR [names...]``.
Comparison: same column names, same row count, same multiset of rows after
normalising values (NULL/NaN/NaT alike, timestamps as ISO text, doubles to
9 significant digits).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from ledgerline.plans.registry import ORACLES, PLANS, load_all
from ledgerline.sources.tables import BASE_TABLES, table_path


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
    except ImportError:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    con = con or duck_connection(sf_dir)
    t0 = time.time()
    sdf = PLANS[name](spark, sf_dir)
    s_cols, s_rows = _rows(sdf.toPandas())
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLES:
        res["status"] = "rows-only"
        return res
    o_cols, o_rows = _rows(con.execute(ORACLES[name]).df())
    res["oracle_rows"] = len(o_rows)
    if s_cols != o_cols:
        res["status"] = f"COLUMNS spark={s_cols} oracle={o_cols}"
    elif s_rows != o_rows:
        o_set, s_set = set(o_rows), set(s_rows)
        extra = [r for r in s_rows if r not in o_set][:3]
        missing = [r for r in o_rows if r not in s_set][:3]
        res["status"] = f"VALUES spark-only={extra} oracle-only={missing}"
    else:
        res["status"] = "match"
    return res


def main(argv):
    from ledgerline.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    names = argv[2:] or sorted(PLANS)
    spark = get_spark("local[8]", 8)
    con = duck_connection(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "rows-only")
        bad += not ok
        print(("ok   " if ok else "FAIL ") + str(r), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
