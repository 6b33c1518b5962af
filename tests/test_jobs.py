"""End-to-end jobs over the fixtures."""

import os

from pyspark.sql import functions as F

from ledgerline import jobs
from ledgerline.operators.tieout import Validation
from ledgerline.session import scratch_path
from ledgerline.sources.fixtures import fixture


def test_tieout_target_writes_all_outputs(spark, sf):
    tables = {n: fixture(spark, sf, n) for n in ("tie_from", "tie_to", "dup_from", "dup_to")}
    vals = [Validation("ORD", ("o_orderkey",), "tie_from", "tie_to", ("_ignore_me",)),
            Validation("DUP", ("l_orderkey", "l_linenumber"), "dup_from", "dup_to")]
    paths = jobs.tieout_target(spark, vals, tables, scratch_path(spark, "job_tieout"), prefix="TIEOUT_T")
    assert sorted(os.path.basename(p) for p in paths.values()) == sorted(
        ["1_OVERVIEW", "2_COLUMNS_SUMMARY", "3_COLUMNS_DETAIL", "4_COLUMNS_SKIPPED",
         "5_SUM_OVERVIEW", "6_SUM_COLUMN", "7_SUM_DETAIL", "8_SUM_FIELD"])
    col = spark.read.parquet(paths["6_SUM_COLUMN"])
    assert col.filter("col_nm = 'o_orderdate'").first().col_match == "PERFECT"
    fld = {r.name: r.tot_diff for r in spark.read.parquet(paths["8_SUM_FIELD"]).collect()}
    assert fld["ORD"] == 131 + 292 + 207 and fld["DUP"] > 16161


def test_export_snapshot_twice(spark, sf):
    root = scratch_path(spark, "job_snapshot")
    objs = fixture(spark, sf, "catalog_objects")
    first = jobs.export_snapshot(spark, objs, fixture(spark, sf, "export_manifest"), root,
                                 run_ts=F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    content = spark.read.parquet(first["content"])
    assert content.count() > 0 and set(content.columns) >= {"db_nm", "sc_nm", "file_nm", "content"}
    second = jobs.export_snapshot(spark, objs, jobs.current_manifest(spark, root), root,
                                  run_ts=F.lit("2031-01-01 00:00:00").cast("timestamp_ntz"))
    statuses = {r.status for r in spark.read.parquet(second["changes"]).select("status").distinct().collect()}
    assert statuses <= {"NO_CHANGE", "NOT_SEEN"}


def test_refresh_dry_run_and_grants_swap(spark, sf):
    plan, done = jobs.refresh_copies(fixture(spark, sf, "cat_tables"), fixture(spark, sf, "storage_metrics"),
                                     "TEST_DB", "SC_1", "TEST_DB", "SC_2")
    assert done is None and plan.count() == 440
    out = jobs.materialise_grants(spark, fixture(spark, sf, "future_grants_db"), fixture(spark, sf, "databases"),
                                  fixture(spark, sf, "future_grants_schema"), fixture(spark, sf, "schemata"),
                                  fixture(spark, sf, "grants_to_roles"), prefix="t_")
    assert set(out) == {"allfuturegrantsdb", "allfuturegrantssc", "allgrantswh"}
    assert spark.table("t_allgrantswh").count() == fixture(spark, sf, "grants_to_roles").filter(
        "deleted_on is null and granted_on = 'WAREHOUSE'").count()


def test_checkpoint_dir_prefers_cluster_setting(spark):
    from ledgerline.session import checkpoint_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = checkpoint_dir(spark)
    if configured:
        assert got == configured
    assert checkpoint_dir(spark) == got and os.path.isdir(got.replace("file:", ""))
    assert spark.sparkContext.getCheckpointDir() is not None
