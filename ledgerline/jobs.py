"""End-to-end jobs: the operators composed the way each tool of the reference
runs them. Each job takes DataFrames (or a resolver for table names), writes
its outputs under a folder the caller names and returns what it wrote.

Outputs are written before anything is derived from them, so downstream
reports read small stored tables and a lost executor only recomputes from the
last written table, not from the compared tables.
"""

from __future__ import annotations

import os
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import access, drift, reports, snapshot
from ledgerline.operators.tieout import Tieout, Validation
from ledgerline.sources import sinks, specs
from ledgerline.sources.commits import CommitLog, Conflict, Folder
from ledgerline.sources.datasets import new_version

def tieout_target(spark: SparkSession, validations: Sequence[Validation],
                  tables: Mapping[str, DataFrame] | Callable[[str], DataFrame], output_root: str,
                  prefix: str = "TIEOUT", **options) -> dict[str, str]:
    """Compare every validation of a target and write the eight outputs, which
    replace those of the run before together (:class:`~ledgerline.sources.sinks.OutputSet`):
    read them with :func:`~ledgerline.sources.sinks.current_outputs`. Their paths.

    ``tables`` maps the spec's table names to DataFrames, or is a function
    resolving a name (e.g. ``spark.table``). ``options`` go to :class:`Tieout`
    (case_insensitive, null_as_blank, multiplicity).
    """
    resolve = tables if callable(tables) else tables.__getitem__
    touts = [Tieout(resolve(v.from_tbl), resolve(v.to_tbl), list(v.key), name=v.name, from_tbl=v.from_tbl,
                    to_tbl=v.to_tbl, ignore_cols=v.ignore_cols, **options) for v in validations]
    run = sinks.OutputSet(spark, os.path.join(output_root, prefix))
    frames = sinks.write_tieout_frames(spark, touts, run.folder())
    overview, summary, detail = (frames[k] for k in ("1_OVERVIEW", "2_COLUMNS_SUMMARY", "3_COLUMNS_DETAIL"))
    sum_col = reports.sum_column(overview, summary)
    reported = {
        "5_SUM_OVERVIEW": reports.sum_overview(overview),
        "6_SUM_COLUMN": sum_col,
        "7_SUM_DETAIL": reports.sum_detail(overview, detail),
        "8_SUM_FIELD": reports.sum_field(sum_col),
    }
    frames |= {k: sinks.write_and_read(df, os.path.join(run.folder(), k)) for k, df in reported.items()}
    return run.publish(frames)


def tieout_from_yaml(spark: SparkSession, yaml_paths: Sequence[str], target: str,
                     tables: Mapping[str, DataFrame] | Callable[[str], DataFrame], output_root: str,
                     **options) -> dict[str, str]:
    """:func:`tieout_target` driven by a YAML validation spec."""
    settings, vals = specs.read_validations(yaml_paths, target)
    prefix = "TIEOUT_" + settings.get("OUTPUT_PREFIX", target)
    return tieout_target(spark, vals, tables, output_root, prefix=prefix, **options)


def refresh_copies(tables: DataFrame, metrics: DataFrame, from_db: str, from_sc: str, to_db: str, to_sc: str,
                   data_path: str | None = None, dry_run: bool = True, scope: str = "target"):
    """Plan the refresh of drifted copies; unless ``dry_run``, rewrite them.

    Returns (plan, data): the plan, and after a refresh the dataset as it now is.
    ``data_path`` holds all tables as partitions (db_sc, table_name) of one dataset;
    every refreshed copy is replaced in one job, and a copy whose source is empty
    comes out empty.
    """
    plan = drift.refresh_plan(tables, metrics, from_db, from_sc, to_db, to_sc, scope)
    if dry_run:
        return plan, None
    if data_path is None:
        raise ValueError("data_path is needed unless dry_run")
    return plan, drift.refresh_dataset(plan, data_path)


def first_copy(tables: DataFrame, metrics: DataFrame, from_db: str, from_sc: str, to_db: str, to_sc: str,
               data_path: str, delete_existing: bool = False) -> DataFrame:
    """Copy every eligible table of a schema for the first time; refuses when a name
    is taken in the target, unless ``delete_existing``. The dataset as it now is."""
    plan = drift.first_copy_plan(tables, metrics, from_db, from_sc, to_db, to_sc, delete_existing)
    taken = [r.table_name for r in plan.where("collision").select("table_name").limit(10).collect()]
    if taken and not delete_existing:
        raise ValueError(f"tables exist in {to_db}.{to_sc} already: {', '.join(taken)}")
    todo = plan.select(F.col("source_db_sc").alias("src_db_sc"), F.col("target_db_sc").alias("clone_db_sc"),
                       "table_name", F.lit("REFRESH").alias("action"))
    return drift.refresh_dataset(todo, data_path)


def remove_copies(tables: DataFrame, metrics: DataFrame, from_db: str, from_sc: str, to_db: str, to_sc: str,
                  data_path: str) -> DataFrame:
    """Drop every copy in the target that descends from the source. The dataset as it now is."""
    return drift.drop_tables(drift.removal_plan(tables, metrics, from_db, from_sc, to_db, to_sc), data_path)


def export_snapshot(spark: SparkSession, objects: DataFrame, manifest: DataFrame, output_root: str,
                    run_ts: Column | None = None, delete: bool = False,
                    scope: DataFrame | None = None) -> dict[str, str]:
    """Store the content of new and changed objects, then the next manifest.

    Content is added as a version of its own; the manifest says for each file
    which version holds it, so unchanged files stay where they are. The manifest
    is written aside and committed last, so an interrupted run leaves the previous
    one in force and a run that another one overtook is refused.
    """
    run_ts = run_ts if run_ts is not None else F.current_timestamp().cast("timestamp_ntz")
    log = CommitLog(spark, os.path.join(output_root, "commits"))
    began, version = log.current(), new_version()
    changed = sinks.write_and_read(snapshot.changes(objects, manifest, delete=delete, scope=scope),
                                   os.path.join(output_root, "changes", version))
    todo = changed.filter(F.col("status").isin("NEW", "CHANGED"))
    content_path = os.path.join(output_root, "content")
    sinks.write_snapshot(snapshot.content_parts(snapshot.in_scope(objects, scope), todo), content_path, version)
    following = snapshot.next_manifest(changed, run_ts, version)
    if scope is not None:  # what lies outside the scope stays listed as it was
        outside = manifest.join(snapshot.named_schemas(scope), ["db_nm", "sc_nm"], "left_anti")
        following = following.unionByName(outside, allowMissingColumns=True)
    path = os.path.join(output_root, "manifest", version)
    sinks.write_table(following, path)
    log.commit({"manifest": version}, after=began.number)
    return {"changes": os.path.join(output_root, "changes", version), "content": content_path, "manifest": path}


def current_manifest(spark: SparkSession, output_root: str) -> DataFrame:
    """The manifest the last completed :func:`export_snapshot` run named."""
    now = CommitLog(spark, os.path.join(output_root, "commits")).current()
    return spark.read.parquet(os.path.join(output_root, "manifest", now.state["manifest"]))


def current_content(spark: SparkSession, output_root: str) -> DataFrame:
    """(db_nm, sc_nm, file_nm, content, n_parts) of every file the current manifest lists."""
    parts = sinks.read_snapshot(spark, os.path.join(output_root, "content"))
    listed = current_manifest(spark, output_root).select(*snapshot.KEYS, "version")
    return snapshot.file_text(snapshot.of_files(parts, listed, [*snapshot.KEYS, "version"]))


def vacuum_snapshot(spark: SparkSession, output_root: str, small: int = 100_000) -> dict[str, list[str]]:
    """K7, E5: give back what replaced and vanished files hold.

    Stored parts meet the current manifest in one join, counted per version. A
    version without a live part is removed; one that is partly dead, or holds fewer
    than ``small`` parts, is rewritten: its live parts, with those of all others
    like it, become one new version, the manifest is committed to name it, and only
    then are the old folders removed, with the manifests and change lists before
    it. Versions that are whole and large are not touched. Returns the versions
    ``removed`` and the one ``written``. A run that commits meanwhile makes this one
    raise Conflict, with nothing removed.
    """
    log = CommitLog(spark, os.path.join(output_root, "commits"))
    began = log.current()
    store = Folder(spark, os.path.join(output_root, "content"))
    if not began.number or not store.names():
        return {"removed": [], "written": []}
    listed = current_manifest(spark, output_root)
    parts = sinks.read_snapshot(spark, store.path)
    held = {r.version: r for r in sinks.snapshot_usage(parts, listed).collect()}  # a row per run since the last vacuum
    stored = [n.removeprefix("version=") for n in store.names() if n.startswith("version=")]
    dead = [v for v in stored if v <= began.state["manifest"] and (v not in held or not held[v].n_live)]
    again = [v for v, r in held.items() if 0 < r.n_live < r.n_parts or 0 < r.n_live < small]
    if len(again) == 1 and held[again[0]].n_live == held[again[0]].n_parts:
        again = []  # small, but whole and alone
    version = new_version()
    written = [version] if again else []
    if again:
        old = F.col("version").isin(again)
        live = snapshot.of_files(parts.where(old), listed.where(old), [*snapshot.KEYS, "version"])
        sinks.write_snapshot(live, store.path, version)
        moved = F.when(F.col("version").isin(again), F.lit(version)).otherwise(F.col("version"))
        listed = listed.withColumn("version", moved)
        sinks.write_table(listed, os.path.join(output_root, "manifest", version))
        try:
            log.commit({"manifest": version}, after=began.number)
        except Conflict:
            store.remove(f"version={version}")
            raise
    for v in (*dead, *again):
        store.remove(f"version={v}")
    root = Folder(spark, output_root)
    for old in log.last(1_000)[:-1]:
        root.remove("manifest", old.state["manifest"])
        root.remove("changes", old.state["manifest"])
        log.forget(old.number)
    return {"removed": [*dead, *again], "written": written}


def materialise_grants(spark: SparkSession, raw_db: DataFrame, databases: DataFrame, raw_sc: DataFrame,
                       schemata: DataFrame, grants_to_roles: DataFrame, prefix: str = "") -> dict[str, str]:
    """A1-A3 with K6: each grant table built aside and swapped in as a view."""
    return {
        "allfuturegrantsdb": sinks.swap_in(spark, access.future_grants_db(raw_db, databases), prefix + "allfuturegrantsdb"),
        "allfuturegrantssc": sinks.swap_in(spark, access.future_grants_schema(raw_sc, schemata), prefix + "allfuturegrantssc"),
        "allgrantswh": sinks.swap_in(spark, access.warehouse_grants(grants_to_roles), prefix + "allgrantswh"),
    }
