"""Commits: concurrent writers, output sets, swapped tables, datasets by table, vacuum."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerline import jobs
from ledgerline.operators import drift
from ledgerline.operators.tieout import Validation
from ledgerline.session import scratch_path
from ledgerline.sources import sinks
from ledgerline.sources.commits import CommitLog, Conflict, Folder
from ledgerline.sources.datasets import Dataset


@pytest.fixture()
def place(spark):
    return scratch_path(spark, f"commits_{uuid.uuid4().hex}")


def test_a_commit_needs_the_current_number(spark, place):
    log = CommitLog(spark, place)
    assert log.current() == (0, {})
    first = log.commit({"x": 1}, after=0)
    with pytest.raises(Conflict):
        log.commit({"x": 2}, after=0)
    assert not Folder(spark, place).write_new(f"{first.number:020d}.json", "{}")  # nothing is replaced
    assert log.current() == (1, {"x": 1})
    log.forget(1)
    assert log.current() == (1, {"x": 1})  # the current commit stays


# -- swapped tables -----------------------------------------------------------
def test_of_two_writers_one_swap_is_refused(spark):
    name = f"swap_{uuid.uuid4().hex[:8]}"
    a, b = sinks.Swap(spark, name), sinks.Swap(spark, name)
    sinks.swap_in(spark, spark.range(1), name)
    at_a, at_b = a.begin(), b.begin()
    a.finish(spark.range(2), at_a)
    with pytest.raises(Conflict):
        b.finish(spark.range(3), at_b)
    assert spark.table(name).count() == 2
    assert {r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{name}__*'").collect()} == set(a.versions())
    b.finish(spark.range(3))
    assert spark.table(name).count() == 3


def test_swaps_keep_the_last_versions(spark):
    name = f"swap_{uuid.uuid4().hex[:8]}"
    made = [sinks.swap_in(spark, spark.range(n), name, keep=3) for n in range(1, 7)]
    assert sinks.Swap(spark, name).versions() == made[-3:]
    assert {r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{name}__*'").collect()} == set(made[-3:])
    assert spark.table(name).count() == 6


# -- outputs that belong together ---------------------------------------------------
def _target(spark, place, rows, **options):
    f = spark.createDataFrame(rows, "k int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    return jobs.tieout_target(spark, [Validation("V", ("k",), "F", "T")], {"F": f, "T": t}, place, prefix="P", **options)


def test_a_run_that_fails_midway_leaves_the_former_eight_outputs(spark, place, monkeypatch):
    base = f"{place}/P"
    _target(spark, place, [(1, "a"), (2, "x")])
    before = {k: sorted(map(str, df.collect())) for k, df in sinks.current_outputs(spark, base).items()}
    assert len(before) == 8

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("ledgerline.operators.reports.sum_field", broken)
        with pytest.raises(RuntimeError):
            _target(spark, place, [(1, "y"), (2, "x")])
    assert len(Folder(spark, f"{base}/runs").names()) == 2  # four outputs were written
    assert {k: sorted(map(str, df.collect())) for k, df in sinks.current_outputs(spark, base).items()} == before
    paths = _target(spark, place, [(1, "y"), (2, "x"), (3, "z")])
    now = sinks.current_outputs(spark, base)
    assert now["2_COLUMNS_SUMMARY"].first().col_diff_cnt == 2 and set(now) == set(paths)


def test_old_runs_go_and_an_overtaken_run_is_refused(spark, place):
    base = f"{place}/P"
    slow = sinks.OutputSet(spark, base)
    for n in range(4):
        _target(spark, place, [(1, "a"), (2, str(n))])
    frames = {"1_OVERVIEW": sinks.write_and_read(spark.range(1), f"{slow.folder()}/1_OVERVIEW")}
    with pytest.raises(Conflict):
        slow.publish(frames)
    assert len(sinks.current_outputs(spark, base)) == 8
    assert len([r for r in Folder(spark, f"{base}/runs").names() if r != slow.run]) == 2


# -- datasets by table ------------------------------------------------------------------
def _plan(spark, rows):
    return spark.createDataFrame(rows, "clone_db_sc string, src_db_sc string, table_name string, action string")


def _state(df):
    return sorted(map(tuple, df.collect()))


def test_a_refresh_writes_the_refreshed_tables_only(spark, place):
    wide = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "SRC.SC").otherwise("DST.SC").alias("db_sc"),
        F.concat(F.lit("T_"), (F.floor(F.col("id") / 2) % 100).cast("string")).alias("table_name"), F.col("id").alias("v"))
    store = Dataset(spark, place)
    first = store.create(wide)
    stored = Folder(spark, f"{place}/rows/__version={first}")
    kept = stored.names(), stored.bytes()
    drift.refresh_dataset(_plan(spark, [("DST.SC", "SRC.SC", "T_7", "REFRESH"), ("DST.SC", "SRC.SC", "T_8", "SKIP")]), place)
    second = store.versions()[-1]
    assert (stored.names(), stored.bytes()) == kept  # nothing old was touched
    assert store.bytes_of(second) < kept[1] / 50  # one table of two hundred
    new = spark.read.parquet(f"{place}/rows/__version={second}")
    assert new.select("db_sc", "table_name").distinct().collect() == [("DST.SC", "T_7")] and new.count() == 1000
    assert store.read().count() == 200_000
    assert store.read().where("db_sc = 'DST.SC' and table_name = 'T_7' and v % 2 = 0").count() == 1000
    before = Folder(spark, f"{place}/rows").bytes()
    drift.drop_tables(_plan(spark, [("DST.SC", "SRC.SC", f"T_{n}", "DROP") for n in range(100)]), place)
    assert Folder(spark, f"{place}/rows").bytes() == before  # a drop is a matter of the manifest
    assert store.read().select("db_sc").distinct().collect() == [("SRC.SC",)]
    assert store.vacuum() == [second]  # the first still holds the sources
    assert store.versions() == [first] and store.read().count() == 100_000


def test_tables_named_and_emptied(spark, place):
    rows = [("A", "x", 1), ("A", "y", 2), ("B", "x", 3)]
    store = Dataset(spark, place)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.create(spark.createDataFrame(rows, "db_sc string, table_name string, v int"))
    drift.refresh_dataset(_plan(spark, [("B", "A", "x", "REFRESH"), ("B", "A", "nowhere", "REFRESH")]), place)
    assert _state(store.read()) == [("A", "x", 1), ("A", "y", 2), ("B", "x", 1)]
    # A copy of an emptied source is a table without rows.
    assert ("B", "nowhere") in {tuple(r)[:2] for r in store.tables().collect()}
    wanted = spark.createDataFrame([("A", "y"), ("A", "y"), ("C", "z")], "db_sc string, table_name string")
    assert _state(store.read(wanted)) == [("A", "y", 2)]


def test_of_two_refreshes_the_overtaken_one_changes_nothing(spark, place):
    store = Dataset(spark, place)
    data = spark.createDataFrame([("A", "x", 1), ("B", "x", 3)], "db_sc string, table_name string, v int")
    store.create(data)

    def overtaken(read):
        drift.drop_tables(_plan(spark, [("A", "B", "x", "DROP")]), place)
        return read().withColumn("v", F.lit(9))

    with pytest.raises(Conflict):
        store.replace(overtaken, data.select("db_sc", "table_name"))
    assert _state(store.read()) == [("B", "x", 3)]


# -- vacuum of stored snapshots -----------------------------------------------------------
def _objects(spark, texts, day):
    return spark.createDataFrame([("D", "S", "TABLE", n, None, t) for n, t in texts.items()],
                                 "db_nm string, sc_nm string, obj_type string, obj_name string, argument_signature string, "
                                 "ddl string").withColumn("last_altered", F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz"))


def test_after_ten_runs_with_deletes_only_live_files_are_stored(spark, place):
    none = spark.createDataFrame([], "db_nm string, sc_nm string, file_nm string, file_last_modified timestamp_ntz")
    for run in range(1, 11):
        # Every run alters all objects but the steady ones, and one more has vanished.
        texts = {f"O{n}": f"text {n} of run {run} " * 50 for n in range(run, 20)}
        objects = _objects(spark, texts, run).unionByName(_objects(spark, {"STEADY": "always " * 50}, 1))
        manifest = none if run == 1 else jobs.current_manifest(spark, place)
        stamp = F.lit(f"2024-01-{run:02d} 12:00:00").cast("timestamp_ntz")
        jobs.export_snapshot(spark, objects, manifest, place, run_ts=stamp, delete=True)
    store = Folder(spark, f"{place}/content")
    before, whole = _state(jobs.current_content(spark, place)), store.bytes()
    assert len(before) == 11
    done = jobs.vacuum_snapshot(spark, place)
    assert _state(jobs.current_content(spark, place)) == before
    assert store.bytes() < whole / 4 and len(done["written"]) == 1
    parts = sinks.read_snapshot(spark, store.path)
    assert sorted(r.file_nm for r in parts.collect()) == sorted(r[2] for r in before)  # a part each, nothing dead
    assert len(Folder(spark, f"{place}/manifest").names()) == 1 and len(Folder(spark, f"{place}/commits").names()) == 1
    assert jobs.vacuum_snapshot(spark, place) == {"removed": [], "written": []}  # nothing left to do
    # The next run goes on from the vacuumed manifest.
    jobs.export_snapshot(spark, _objects(spark, {"STEADY": "always " * 50}, 1), jobs.current_manifest(spark, place), place,
                         run_ts=F.lit("2024-02-01").cast("timestamp_ntz"), delete=True)
    assert [r[2] for r in _state(jobs.current_content(spark, place))] == ["STEADY.tbl"]


def test_vacuum_leaves_large_whole_versions_alone(spark, place):
    none = spark.createDataFrame([], "db_nm string, sc_nm string, file_nm string, file_last_modified timestamp_ntz")
    stamp = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    jobs.export_snapshot(spark, _objects(spark, {f"O{n}": "x" for n in range(5)}, 1), none, place, run_ts=stamp)
    more = _objects(spark, {f"P{n}": "y" for n in range(5)}, 1)
    jobs.export_snapshot(spark, more, jobs.current_manifest(spark, place), place, run_ts=stamp)
    assert jobs.vacuum_snapshot(spark, place, small=5) == {"removed": [], "written": []}
    merged = jobs.vacuum_snapshot(spark, place, small=6)  # two small ones become one
    assert len(merged["removed"]) == 2 and len(merged["written"]) == 1
    assert jobs.current_content(spark, place).count() == 10


def test_usage_counts_every_part_once_and_by_a_number(spark):
    """a file that two types of object share is listed twice and stored once."""
    import re

    parts = spark.createDataFrame([("D", "S", f, str(i), "text", v) for f, v, n in (("A", "v1", 3), ("B", "v1", 2), ("A", "v2", 1), ("C", "v0", 1))
                                   for i in range(n)], sinks.PARTS)
    listed = spark.createDataFrame([("D", "S", "A", "v1"), ("D", "S", "A", "v1"), ("D", "S", "B", "v2"), ("D", "S", "A", "v2"),
                                    ("D", "S", "N", None)], "db_nm string, sc_nm string, file_nm string, version string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        usage = sinks.snapshot_usage(parts, listed)
        plan = usage._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert re.search(r"SortMergeJoin \[file_id#\d+L\], \[listed_file_id#\d+L\], LeftSemi", plan)
    assert sorted((r.version, r.n_parts, r.n_live, r.n_chars) for r in usage.collect()) == [
        ("v0", 1, 0, 4), ("v1", 5, 3, 20), ("v2", 1, 1, 4)]


def test_source_and_plan_are_evaluated_once(spark, tmp_path):
    """Tables are listed from the rows that were written, and a refresh stores its plan."""
    from pyspark.sql import functions as F

    from ledgerline.operators import drift
    from ledgerline.sources.datasets import Dataset

    def counted(df, seen):
        # The accumulator counts rows as they are made.
        return spark.createDataFrame(df.rdd.map(lambda r: (seen.add(1), r)[1]), df.schema)

    data = spark.createDataFrame([("S", "T", 1), ("S", "U", 2), ("D", "T", 0), ("D", "U", 0)], "db_sc string, table_name string, v int")
    made, planned = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    path = str(tmp_path / "data")
    Dataset(spark, path).create(counted(data, made))
    assert made.value == 4
    plan = spark.createDataFrame([("D", "S", "T", "REFRESH"), ("D", "S", "U", "SKIP")],
                                 "clone_db_sc string, src_db_sc string, table_name string, action string")
    now = drift.refresh_dataset(counted(plan, planned), path)
    assert planned.value == 2
    assert sorted(map(tuple, now.collect())) == [("D", "T", 1), ("D", "U", 0), ("S", "T", 1), ("S", "U", 2)]
    assert now.where(F.col("table_name") == "none").count() == 0
