"""Copy drift: which table copies have drifted from their source, and the plans.

Inputs are catalog frames, one row per table:

* ``tables``: table_catalog, table_schema, table_name, table_type, row_count,
  bytes, created, last_altered (an information_schema.tables listing);
* ``metrics``: id, clone_group_id, table_catalog, table_schema, table_name,
  active_bytes, retained_for_clone_bytes, deleted — a one-level lineage graph
  stored as a parent pointer (``id == clone_group_id`` means an original).

Everything is joins and column expressions on these frames; the data of the
tables themselves is only touched by :func:`refresh_dataset` and :func:`drop_tables`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path
from ledgerline.sources.datasets import Dataset

NAME_COLS = ["table_catalog", "table_schema", "table_name"]

# Refresh reason texts, in the order they are reported.
REASONS = [
    ("clone_active_bytes", "clone table has active_bytes"),
    ("src_retained_for_clone_bytes", "src table has retained_for_clone_bytes"),
    ("src_deleted", "src table deleted"),
    ("row_count_diff", "clone and src row_count_diff"),
    ("bytes_diff", "clone and src bytes_diff"),
    ("dml_since_clone", "src has had dml_since_clone"),
]
FLAGS = [f for f, _ in REASONS]


def _flag(cond: Column) -> Column:
    """CASE WHEN cond THEN TRUE ELSE FALSE: NULL comparisons become FALSE."""
    return F.when(cond, F.lit(True)).otherwise(F.lit(False))


def _in_schema(db: str, sc: str) -> Column:
    return (F.col("table_catalog") == F.lit(db)) & (F.col("table_schema") == F.lit(sc))


def base_tables(tables: DataFrame, db: str, sc: str) -> DataFrame:
    """Base tables of one schema."""
    return tables.filter(_in_schema(db, sc) & (F.col("table_type") == "BASE TABLE"))


def tables_with_lineage(tables: DataFrame, metrics: DataFrame, db: str, sc: str) -> DataFrame:
    """Base tables left-joined to their live storage row, with ``is_clone``.

    Unmatched tables get ``is_clone = TRUE`` (the CASE has no NULL branch).
    """
    live = metrics.filter(F.col("deleted") == F.lit(False)).select(
        "id", "clone_group_id", *NAME_COLS, "active_bytes", "retained_for_clone_bytes")
    return (base_tables(tables, db, sc).join(live, NAME_COLS, "left")
            .select("id", "clone_group_id", *NAME_COLS,
                    _flag(~(F.col("id") == F.col("clone_group_id"))
                          | F.col("id").isNull() | F.col("clone_group_id").isNull()).alias("is_clone"),
                    "row_count", "bytes", "active_bytes", "retained_for_clone_bytes"))


def eligible_for_copy(lineage: DataFrame) -> DataFrame:
    """Originals that have storage metrics (copies and unknowns are skipped)."""
    return lineage.filter(~F.col("is_clone") & ~(F.col("id").isNull() & F.col("clone_group_id").isNull()))


def collisions(eligible: DataFrame, tables: DataFrame, to_db: str, to_sc: str) -> DataFrame:
    """Eligible names that already exist as base tables in the target schema."""
    target = base_tables(tables, to_db, to_sc).select("table_name")
    return eligible.join(target, "table_name", "left_semi")


def first_copy_plan(tables: DataFrame, metrics: DataFrame, from_db: str, from_sc: str,
                    to_db: str, to_sc: str, delete_existing: bool = False) -> DataFrame:
    """C11: one row per table to copy, action CREATE, or CREATE OR REPLACE when
    ``delete_existing``; rows whose name exists in the target are marked
    ``collision`` (callers refuse the plan unless ``delete_existing``).
    """
    elig = eligible_for_copy(tables_with_lineage(tables, metrics, from_db, from_sc))
    target = base_tables(tables, to_db, to_sc).select("table_name").distinct().withColumn("collision", F.lit(True))
    action = "CREATE OR REPLACE" if delete_existing else "CREATE"
    return (elig.join(target, "table_name", "left")
            .select(F.concat_ws(".", F.lit(to_db), F.lit(to_sc)).alias("target_db_sc"),
                    F.concat_ws(".", F.lit(from_db), F.lit(from_sc)).alias("source_db_sc"),
                    "table_name", F.lit(action).alias("action"),
                    F.coalesce(F.col("collision"), F.lit(False)).alias("collision")))


def drift_flags(tables: DataFrame, from_db: str, from_sc: str, to_db: str, to_sc: str) -> DataFrame:
    """C4: source and copy paired by table name, with the three data-drift flags."""
    cols = ["table_name", "row_count", "bytes", "created", "last_altered"]
    st = base_tables(tables, from_db, from_sc).select(*cols).alias("st")
    ct = base_tables(tables, to_db, to_sc).select(*cols).alias("ct")
    return (st.join(ct, F.col("st.table_name") == F.col("ct.table_name"), "inner")
            .select(F.col("st.table_name").alias("table_name"),
                    F.col("st.row_count").alias("st_row_count"), F.col("ct.row_count").alias("ct_row_count"),
                    F.col("st.bytes").alias("st_bytes"), F.col("ct.bytes").alias("ct_bytes"),
                    F.col("st.created").alias("st_created"), F.col("ct.created").alias("ct_created"),
                    F.col("st.last_altered").alias("st_last_altered"),
                    F.col("ct.last_altered").alias("ct_last_altered"),
                    _flag(F.col("st.row_count") != F.col("ct.row_count")).alias("row_count_diff"),
                    _flag(F.col("st.bytes") != F.col("ct.bytes")).alias("bytes_diff"),
                    _flag(F.col("st.last_altered") > F.col("ct.created")).alias("dml_since_clone")))


def lineage_pairs(metrics: DataFrame, from_db: str, from_sc: str, to_db: str, to_sc: str,
                  scope: str = "target") -> DataFrame:
    """C5 + C6: each copy joined to its parent through the parent pointer.

    Candidates are live rows of the target schema plus all rows (deleted too)
    of the source schema. ``scope='target'`` keeps only copies that live in the
    target schema; ``scope='reference'`` also keeps source-schema rows that
    are themselves copies (the reference then plans them for overwrite in
    place).
    """
    if scope not in ("target", "reference"):
        raise ValueError("scope must be 'target' or 'reference'")
    cand = metrics.filter((_in_schema(to_db, to_sc) & (F.col("deleted") == F.lit(False)))
                          | _in_schema(from_db, from_sc))
    cand = cand.withColumn("is_clone", _flag(~(F.col("id") == F.col("clone_group_id"))
                                             | F.col("id").isNull() | F.col("clone_group_id").isNull()))
    child = cand.filter(F.col("is_clone"))
    if scope == "target":
        child = child.filter(_in_schema(to_db, to_sc))
    c, p = child.alias("c"), cand.alias("p")
    return (c.join(p, F.col("p.id") == F.col("c.clone_group_id"), "inner")
            .select(F.concat(F.col("c.table_catalog"), F.lit("."), F.col("c.table_schema")).alias("clone_db_sc"),
                    F.concat(F.col("p.table_catalog"), F.lit("."), F.col("p.table_schema")).alias("src_db_sc"),
                    F.col("c.table_name").alias("table_name"),
                    _flag(F.col("c.active_bytes") > 0).alias("clone_active_bytes"),
                    _flag(F.col("p.retained_for_clone_bytes") > 0).alias("src_retained_for_clone_bytes"),
                    F.col("p.deleted").alias("src_deleted")))


def needs_refresh(flags=FLAGS) -> Column:
    """Skip only when all six flags are exactly FALSE (NULL means refresh)."""
    all_false = None
    for f in flags:
        term = F.col(f).eqNullSafe(F.lit(False))
        all_false = term if all_false is None else (all_false & term)
    return ~all_false


def refresh_reasons() -> Column:
    """The reasons that hold, quoted, in fixed order, separated by blanks."""
    parts = [F.when(F.col(f) == F.lit(True), F.lit(f'"{text}"')) for f, text in REASONS]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def refresh_plan(tables: DataFrame, metrics: DataFrame, from_db: str, from_sc: str,
                 to_db: str, to_sc: str, scope: str = "target") -> DataFrame:
    """One row per copy: target, source, table, the six flags, action, reasons."""
    lp = lineage_pairs(metrics, from_db, from_sc, to_db, to_sc, scope)
    df = drift_flags(tables, from_db, from_sc, to_db, to_sc).select(
        "table_name", "row_count_diff", "bytes_diff", "dml_since_clone")
    return (lp.join(df, "table_name", "inner")
            .withColumn("action", F.when(needs_refresh(), F.lit("REFRESH")).otherwise(F.lit("SKIP")))
            .withColumn("reasons", refresh_reasons()))


def removal_plan(tables: DataFrame, metrics: DataFrame, from_db: str, from_sc: str,
                 to_db: str, to_sc: str) -> DataFrame:
    """Every copy in the target that descends from the source: DROP."""
    lp = lineage_pairs(metrics, from_db, from_sc, to_db, to_sc, "target")
    names = drift_flags(tables, from_db, from_sc, to_db, to_sc).select("table_name")
    return (lp.join(names, "table_name", "left_semi")
            .select("clone_db_sc", "src_db_sc", "table_name", F.lit("DROP").alias("action")))


def refresh_rows(plan: DataFrame, data: DataFrame, db_sc_col: str = "db_sc",
                 table_col: str = "table_name") -> DataFrame:
    """C10 for tables kept as partitions of one dataset ``(db_sc, table_name, ...)``:
    the new content of every copy the plan marks REFRESH is its source's rows,
    relabelled with the copy's schema. One join of the (catalog-sized) plan with
    the data; no per-table loop.
    """
    todo = (plan.filter(F.col("action") == "REFRESH")
            .select(F.col("src_db_sc").alias("_src"), F.col("clone_db_sc").alias("_dst"),
                    F.col("table_name").alias("_tbl")).distinct())
    rows = data.join(todo, (data[db_sc_col] == todo["_src"]) & (data[table_col] == todo["_tbl"]), "inner")
    cols = [c for c in data.columns if c != db_sc_col]
    return rows.select(F.col("_dst").alias(db_sc_col), *cols)


def refresh_dataset(plan: DataFrame, path: str, db_sc_col: str = "db_sc", table_col: str = "table_name") -> DataFrame:
    """C10 applied to the dataset under ``path``: every refreshed copy is written anew
    with its source's rows, and nothing else is. A copy of an emptied source is
    listed, without rows. The plan is evaluated once and stored for its three uses.
    Returns the dataset as it now is."""
    spark = plan.sparkSession
    store = Dataset(spark, path, db_sc_col, table_col)
    todo = plan.filter(F.col("action") == "REFRESH").select("clone_db_sc", "src_db_sc", "table_name", "action")
    stored = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    todo.write.parquet(stored)
    todo = spark.read.schema(todo.schema).parquet(stored)
    copies, sources = (todo.select(F.col(n).alias(db_sc_col), F.col("table_name").alias(table_col))
                       for n in ("clone_db_sc", "src_db_sc"))
    store.replace(lambda read: refresh_rows(todo, read(sources), db_sc_col, table_col), copies)
    return store.read()


def drop_tables(plan: DataFrame, path: str, db_sc_col: str = "db_sc", table_col: str = "table_name") -> DataFrame:
    """C12 applied: the tables the plan drops leave the manifest; no row is written."""
    store = Dataset(plan.sparkSession, path, db_sc_col, table_col)
    store.replace(None, plan.select(F.col("clone_db_sc").alias(db_sc_col), F.col("table_name").alias(table_col)), drop=True)
    return store.read()


def new_dataset(data: DataFrame, path: str) -> DataFrame:
    """Write all tables of ``data`` to the dataset under ``path``."""
    store = Dataset(data.sparkSession, path)
    store.create(data)
    return store.read()


def current_dataset(spark: SparkSession, path: str) -> DataFrame:
    return Dataset(spark, path).read()
