"""Copy drift plan counts, refresh apply, and snapshot re-run stability."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerline import jobs
from ledgerline.operators import drift, snapshot
from ledgerline.session import scratch_path
from ledgerline.sources.fixtures import fixture


def test_refresh_plan_counts(spark, sf):
    t, m = fixture(spark, sf, "cat_tables"), fixture(spark, sf, "storage_metrics")
    p = drift.refresh_plan(t, m, "TEST_DB", "SC_1", "TEST_DB", "SC_2")
    assert (p.count(), p.filter("action = 'SKIP'").count()) == (440, 3)
    r = drift.refresh_plan(t, m, "TEST_DB", "SC_1", "TEST_DB", "SC_2", scope="reference")
    trap = r.filter("clone_db_sc = 'TEST_DB.SC_1'")
    assert (trap.count(), trap.filter("action = 'SKIP'").count()) == (60, 1)


def test_refresh_empties_the_copy_of_an_emptied_source(spark):
    path = scratch_path(spark, f"refresh_{uuid.uuid4().hex}")
    rows = [("SRC.SC", "T_1", 1), ("DST.SC", "T_1", 9), ("DST.SC", "T_2", 8), ("DST.SC", "T_3", 7)]
    drift.new_dataset(spark.createDataFrame(rows, "db_sc string, table_name string, v int"), path)
    plan = spark.createDataFrame([("DST.SC", "SRC.SC", "T_1", "REFRESH"), ("DST.SC", "SRC.SC", "T_2", "REFRESH"),
                                  ("DST.SC", "SRC.SC", "T_3", "SKIP")],
                                 "clone_db_sc string, src_db_sc string, table_name string, action string")
    drift.refresh_dataset(plan, path)
    assert sorted(map(tuple, drift.current_dataset(spark, path).collect())) == [
        ("DST.SC", "T_1", 1), ("DST.SC", "T_3", 7), ("SRC.SC", "T_1", 1)]
    drift.drop_tables(plan.where("table_name = 'T_3'"), path)
    assert drift.current_dataset(spark, path).where("table_name = 'T_3'").count() == 0


def test_first_copy_refuses_collisions(spark, sf):
    t, m = fixture(spark, sf, "cat_tables"), fixture(spark, sf, "storage_metrics")
    path = scratch_path(spark, f"first_{uuid.uuid4().hex}")
    drift.new_dataset(fixture(spark, sf, "table_data"), path)
    names = ("TEST_DB", "SC_1", "TEST_DB", "SC_2")
    with pytest.raises(ValueError, match="exist"):
        jobs.first_copy(t, m, *names, path)
    done = jobs.first_copy(t, m, *names, path, delete_existing=True)
    one = drift.first_copy_plan(t, m, *names, delete_existing=True).first().table_name
    cols = ["l_linenumber", "l_quantity", "l_returnflag"]
    a, b = (done.where(f"db_sc = 'TEST_DB.{sc}' and table_name = '{one}'").select(*cols) for sc in ("SC_1", "SC_2"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_second_snapshot_run_is_unchanged(spark, sf):
    objs = fixture(spark, sf, "catalog_objects")
    first = snapshot.changes(objs, fixture(spark, sf, "export_manifest"))
    manifest = snapshot.next_manifest(first, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    again = snapshot.changes(objs, manifest)
    statuses = {r.status for r in again.select("status").distinct().collect()}
    assert statuses <= {"NO_CHANGE", "NOT_SEEN"} and "NO_CHANGE" in statuses


def test_signature_normalisation(spark):
    df = spark.createDataFrame([("()",), ("(A VARCHAR)",), ("(A VARCHAR, B NUMBER)",), ("(A NUMBER) RETURN TABLE",)], "s string")
    got = [r[0] for r in df.select(snapshot.normalise_signature(F.col("s"))).collect()]
    assert got == ["()", "(VARCHAR)", "(VARCHAR, NUMBER)", "(NUMBER)"]


def test_partition_refresh_replaces_only_refreshed_copies(spark, sf):
    t, m = fixture(spark, sf, "cat_tables"), fixture(spark, sf, "storage_metrics")
    plan = drift.refresh_plan(t, m, "TEST_DB", "SC_1", "TEST_DB", "SC_2")
    data = fixture(spark, sf, "table_data")
    path = scratch_path(spark, f"partition_refresh_{uuid.uuid4().hex}")
    drift.new_dataset(data, path)
    after = drift.refresh_dataset(plan, path)
    cols = ["l_linenumber", "l_quantity", "l_returnflag"]
    refreshed = plan.filter("action = 'REFRESH'").first().table_name
    src = data.filter(f"db_sc = 'TEST_DB.SC_1' and table_name = '{refreshed}'").select(*cols)
    dst = after.filter(f"db_sc = 'TEST_DB.SC_2' and table_name = '{refreshed}'").select(*cols)
    assert src.count() > 0 and src.exceptAll(dst).count() == 0 and dst.exceptAll(src).count() == 0
    skipped = plan.filter("action = 'SKIP'").first().table_name
    before = data.filter(f"db_sc = 'TEST_DB.SC_2' and table_name = '{skipped}'").select(*cols)
    kept = after.filter(f"db_sc = 'TEST_DB.SC_2' and table_name = '{skipped}'").select(*cols)
    assert before.exceptAll(kept).count() == 0 and kept.exceptAll(before).count() == 0


def test_parts_in_order_are_the_whole_file(spark, sf):
    objs = fixture(spark, sf, "catalog_objects")
    whole = {(r.file_nm): r.content for r in snapshot.content(objs).collect()}
    rebuilt = {}
    for r in sorted(snapshot.content_parts(objs).collect(), key=lambda r: (r.file_nm, r.part, r.content)):
        rebuilt.setdefault(r.file_nm, []).append(r.content)
    assert {k: "\n".join(v) for k, v in rebuilt.items()} == whole


def test_missing_source_and_unknown_types(spark):
    objs = spark.createDataFrame(
        [("D", "S", "TABLE", "A", None, None), ("D", "S", "EVENT TABLE", "B", None, "create B"), ("D", "S", "VIEW", "C", None, None)],
        "db_nm string, sc_nm string, obj_type string, obj_name string, argument_signature string, ddl string"
    ).withColumn("last_altered", F.lit("2024-01-02").cast("timestamp_ntz"))
    man = spark.createDataFrame([("D", "S", "C.vw")], "db_nm string, sc_nm string, file_nm string").withColumn(
        "file_last_modified", F.lit("2024-01-01").cast("timestamp_ntz"))
    c = snapshot.changes(objs, man)
    assert {r.file_nm: r.status for r in c.collect()} == {"A.tbl": "ERROR", "B.event_table": "NEW", "C.vw": "ERROR"}
    kept = {r.file_nm: r.file_last_modified.year for r in snapshot.next_manifest(c, F.lit("2030-01-01").cast("timestamp_ntz")).collect()}
    assert kept == {"B.event_table": 2030, "C.vw": 2024}


OBJECTS = ("db_nm string, sc_nm string, obj_type string, obj_name string, argument_signature string, ddl string, "
           "last_altered timestamp_ntz")


def _named(spark, names, day, text="x"):
    rows = [("D", "S", t, n, None, f"{text} {t} {n}") for t, n in names]
    return (spark.createDataFrame(rows, OBJECTS.rsplit(", ", 1)[0])
            .withColumn("last_altered", F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")))


def test_files_of_one_id_are_told_apart_by_their_names(spark, monkeypatch):
    """Ids deal and sort rows; where two files share one, names decide. NULL names meet nothing."""
    monkeypatch.setattr(snapshot, "with_id", lambda rows: rows.withColumn(snapshot.ID, F.lit(1).cast("long")))
    objs = _named(spark, [("TABLE", "A"), ("TABLE", "B"), ("DYNAMIC TABLE", "B"), ("VIEW", None)], 5)
    man = spark.createDataFrame([("D", "S", "A.tbl", 9), ("D", "S", "GONE.vw", 9), ("D", "S", None, 9)],
                                "db_nm string, sc_nm string, file_nm string, d int")
    man = man.select("db_nm", "sc_nm", "file_nm", F.expr("make_timestamp_ntz(2024, 1, d, 0, 0, 0)").alias("file_last_modified"))
    c = snapshot.changes(objs, man)
    got = sorted((r.file_nm or "", r.obj_type or "", r.status) for r in c.collect())
    assert got == [("", "", "NOT_SEEN"), ("", "VIEW", "NOT_SEEN"), ("A.tbl", "TABLE", "NO_CHANGE"), ("B.tbl", "DYNAMIC TABLE", "NEW"),
                   ("B.tbl", "TABLE", "NEW"), ("GONE.vw", "", "NOT_SEEN")]
    text = snapshot.content(objs, c.where("status = 'NEW'")).collect()
    assert [(r.file_nm, r.content, r.n_parts) for r in text] == [("B.tbl", "x DYNAMIC TABLE B\nx TABLE B", 2)]


def test_stored_text_is_dealt_and_sorted_once_by_a_number(spark):
    """not by every name of a file, and not dealt again to group what was joined by file."""
    import re

    root = scratch_path(spark, f"plan_{uuid.uuid4().hex}")
    none = spark.createDataFrame([], "db_nm string, sc_nm string, file_nm string, file_last_modified timestamp_ntz")
    done = jobs.export_snapshot(spark, _named(spark, [("TABLE", "A"), ("VIEW", "B")], 1), none, root)
    assert list(done) == ["changes", "content", "manifest"]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = jobs.current_content(spark, root)
        plan = now._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(re.findall("Exchange hashpartitioning", plan)) == 2
    assert re.search(r"SortMergeJoin \[file_id#\d+L\], \[listed_file_id#\d+L\], LeftSemi", plan)
    assert sorted((r.file_nm, r.content) for r in now.collect()) == [("A.tbl", "x TABLE A"), ("B.vw", "x VIEW B")]
    # A run without changes stores nothing, and everything is still read.
    jobs.export_snapshot(spark, _named(spark, [("TABLE", "A"), ("VIEW", "B")], 1), jobs.current_manifest(spark, root), root)
    assert jobs.current_content(spark, root).count() == 2
