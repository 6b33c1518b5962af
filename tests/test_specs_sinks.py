"""Spec readers and sinks."""

import os

from pyspark.sql import functions as F

from ledgerline.operators.tieout import Tieout
from ledgerline.session import scratch_path
from ledgerline.sources import sinks, specs
from ledgerline.sources.fixtures import fixture

ROLE_DOC = {
    "MARKETING_FR": {"ORDER": "INCEXC",
                     "INCLUDE": [{"TYPE": "SCHEMA", "DATABASE": "EU_%", "SCHEMA": "CLICKS", "ROLE": "VEW"},
                                 {"TYPE": "WAREHOUSE", "WAREHOUSE": "NIGHTLY", "ROLE": "OPR"}],
                     "EXCLUDE": [{"TYPE": "SCHEMA", "DATABASE": "EU_TEST", "SCHEMA": "%"}],
                     "CUSTOM_INCLUDE": ["FINANCE_FR", "LEDGER_VEW_AR"], "CUSTOM_EXCLUDE": [], "SCIM_ROLES": []},
    "NOBODY_FR": {k: "INCEXC" if k == "ORDER" else [] for k in (
        "ORDER", "INCLUDE", "EXCLUDE", "CUSTOM_INCLUDE", "CUSTOM_EXCLUDE", "SCIM_ROLES")},
}
MODEL_DOC = {"TYPE": "QUEUE", "AR_PREFIX": "_QU_", "ROLE_OWNER": "QU_KEEPER", "ROLE_HIERARCHY": ["BOSS", "PUSH", "PEEK"],
             "ROLE_PERMISSIONS": {"BOSS": {"PURGE": ["QUEUE"]}, "PUSH": {}, "PEEK": {"READ": ["TOPICS", "HEADERS"]}}}


def test_role_spec_rows(spark):
    rules, custom = specs.role_spec_rows(specs.docs_frame(spark, [ROLE_DOC]))
    got = sorted((r.role_name, r.rule, r.obj_type, r.role_type) for r in rules.collect())
    assert got == [("MARKETING_FR", "EXCLUDE", "SCHEMA", None), ("MARKETING_FR", "INCLUDE", "SCHEMA", "VEW"),
                   ("MARKETING_FR", "INCLUDE", "WAREHOUSE", "OPR")]
    assert sorted(r.role_ref for r in custom.collect()) == ["FINANCE_FR", "LEDGER_VEW_AR"]


def test_privilege_model_rows(spark):
    rows = specs.privilege_model_rows(specs.docs_frame(spark, [MODEL_DOC])).collect()
    assert {(r.obj_type, r.ar_prefix, r.role_owner) for r in rows} == {("QUEUE", "_QU_", "QU_KEEPER")}
    assert sorted((r.pos, r.role, r.privilege, r.kind) for r in rows if r.kind) == [
        (0, "BOSS", "PURGE", "QUEUE"), (2, "PEEK", "READ", "HEADERS"), (2, "PEEK", "READ", "TOPICS")]
    assert [(r.pos, r.role, r.privilege) for r in rows if not r.kind] == [(1, "PUSH", None)]


def test_validation_yaml(tmp_path):
    p = tmp_path / "v.yaml"
    p.write_text("T1:\n  OUTPUT_DB: D\n  OUTPUT_SC: S\n  OUTPUT_PREFIX: P\n  VALIDATIONS:\n"
                 "    - NAME: A\n      KEY: [k]\n      FROM_TBL: D.S.F\n      TO_TBL: D.S.T\n")
    settings, vals = specs.read_validations([str(p)], "T1")
    assert settings["OUTPUT_PREFIX"] == "P" and vals[0].key == ("k",) and vals[0].ignore_cols == ()
    try:
        specs.read_validations([str(p)], "NOPE")
        raise AssertionError("expected KeyError")
    except KeyError as e:
        assert "T1" in str(e)


def test_write_tieouts_and_swap(spark, sf):
    f, t = fixture(spark, sf, "tie_from"), fixture(spark, sf, "tie_to")
    tt = Tieout(f, t, ["o_orderkey"], name="ORD", ignore_cols=["_ignore_me"])
    base = scratch_path(spark, "tieout_out")
    paths = sinks.write_tieouts(spark, [tt], base)
    summ = {r.col_nm: r.col_diff_cnt for r in spark.read.parquet(paths["2_COLUMNS_SUMMARY"]).collect()}
    assert summ == {r.col_nm: r.col_diff_cnt for r in tt.summary.collect()}
    assert "tieout_dt" in spark.read.parquet(paths["1_OVERVIEW"]).columns
    v1 = sinks.swap_in(spark, spark.range(3), "swap_demo")
    v2 = sinks.swap_in(spark, spark.range(5), "swap_demo")
    assert v1 != v2 and spark.table("swap_demo").count() == 5


def test_yaml_target_end_to_end(spark, sf, tmp_path):
    """Validation spec → all validations of the target → the stored outputs."""
    from ledgerline.operators.tieout import run_validations

    p = tmp_path / "t.yaml"
    p.write_text("SAMPLE:\n  OUTPUT_DB: OUT\n  OUTPUT_SC: TIE\n  OUTPUT_PREFIX: S\n  VALIDATIONS:\n"
                 "    - NAME: ORD\n      KEY: [o_orderkey]\n      FROM_TBL: DB.SC.TIE_FROM\n      TO_TBL: DB.SC.TIE_TO\n"
                 "      IGNORE_COLS: [_ignore_me]\n"
                 "    - NAME: DUP\n      KEY: [l_orderkey, l_linenumber]\n      FROM_TBL: DB.SC.DUP_FROM\n"
                 "      TO_TBL: DB.SC.DUP_TO\n")
    _, vals = specs.read_validations([str(p)], "SAMPLE")
    tables = {f"DB.SC.{n.upper()}": fixture(spark, sf, n) for n in ("tie_from", "tie_to", "dup_from", "dup_to")}
    out = run_validations(spark, tables, vals)
    summ = {(r.name, r.col_nm): r.col_diff_cnt for r in out["summary"].collect()}
    assert summ[("ORD", "o_orderstatus")] == 292 and summ[("DUP", "l_returnflag")] == 16161
    assert out["overview"].count() == 2 and out["skipped"].count() == 2
    assert out["detail"].groupBy("name").agg(F.sum("diff_cnt").alias("n")).filter("name = 'DUP'").first().n \
        == summ[("DUP", "l_returnflag")] + summ[("DUP", "l_linestatus")]


def test_spec_document_lint(spark):
    from ledgerline.operators.access import lint_spec_documents
    bad = {"A_FR": {"ORDER": "INCEXC", "INCLUDE": {"TYPE": "SCHEMA"}, "EXCLUDE": [], "CUSTOM_INCLUDE": [],
                    "CUSTOM_EXCLUDE": []},
           "B_FR": ROLE_DOC["MARKETING_FR"]}
    got = sorted((r.role_name, r.violation) for r in lint_spec_documents(specs.docs_frame(spark, [bad])).collect())
    assert got == [("A_FR", "INCLUDE is not a list"), ("A_FR", "missing SCIM_ROLES")]
