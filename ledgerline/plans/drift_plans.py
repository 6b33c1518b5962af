"""Copy-drift queries: source schema TEST_DB.SC_1, copies in TEST_DB.SC_2.

The oracle is written from the rules, not from the plans: tables of a name are
laid side by side by one grouping, and the six flags of a copy are a list of
(held, text) pairs from which action and reasons are read off.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import drift
from ledgerline.plans.registry import register
from ledgerline.sources.fixtures import fixture, oracle_cte

SRC = ("TEST_DB", "SC_1")
DST = ("TEST_DB", "SC_2")
CTE = oracle_cte("cat_tables", "storage_metrics")


def _inputs(spark, sf_dir):
    return fixture(spark, sf_dir, "cat_tables"), fixture(spark, sf_dir, "storage_metrics")


# A base table of the source schema and its live storage row; what is not known
# to be an original (its own lineage group) counts as a copy.
_KNOWN = """,
known as (
  from (from cat_tables where table_type = 'BASE TABLE' and (table_catalog, table_schema) = ('TEST_DB', 'SC_1'))
  left join (select * exclude (deleted) from storage_metrics where deleted is not distinct from false)
       using (table_catalog, table_schema, table_name)
  select id, clone_group_id, table_catalog, table_schema, table_name,
         (id = clone_group_id) is not true as is_clone, row_count, bytes, active_bytes, retained_for_clone_bytes)"""
_ORIGINALS = _KNOWN + """,
originals as (from known where id = clone_group_id)"""
_TAKEN = """(select table_name from cat_tables
  where table_type = 'BASE TABLE' and table_catalog || '.' || table_schema = 'TEST_DB.SC_2')"""

# Each name's tables in the two schemas side by side.
_SIDE_BY_SIDE = """,
sided as (
  select table_name, table_schema = 'SC_1' as here, row_count, bytes, created, last_altered from cat_tables
   where table_catalog = 'TEST_DB' and table_schema in ('SC_1', 'SC_2') and table_type = 'BASE TABLE'),
twins as (
  select table_name, {columns}
    from sided group by table_name
  having bool_or(here) and bool_or(not here)),
marked as (
  select *, (st_row_count <> ct_row_count) is true as row_count_diff, (st_bytes <> ct_bytes) is true as bytes_diff,
         (st_last_altered > ct_created) is true as dml_since_clone
    from twins)""".format(columns=",\n         ".join(
    f"first({c}) filter (where {cond}) as {side}_{c}"
    for c in ("row_count", "bytes", "created", "last_altered") for side, cond in (("st", "here"), ("ct", "not here"))))


def _copies(only_target: bool) -> str:
    """Copies with the row their parent pointer names; rows of the source schema
    count even when deleted, rows of the target schema only while live."""
    where = "place = 'TEST_DB.SC_2'" if only_target else "true"
    return _SIDE_BY_SIDE + f""",
seen as (
  select *, table_catalog || '.' || table_schema as place from storage_metrics
   where case table_catalog || '.' || table_schema when 'TEST_DB.SC_1' then true when 'TEST_DB.SC_2' then not deleted end),
copies as (
  select kid.place as clone_db_sc, parent.place as src_db_sc, kid.table_name,
         (kid.active_bytes > 0) is true as clone_active_bytes,
         (parent.retained_for_clone_bytes > 0) is true as src_retained_for_clone_bytes,
         parent.deleted as src_deleted, marked.row_count_diff, marked.bytes_diff, marked.dml_since_clone
    from (from seen where (id = clone_group_id) is not true and {where}) kid
    join seen parent on kid.clone_group_id = parent.id
    join marked on marked.table_name = kid.table_name)"""


def _plan_sql(only_target: bool) -> str:
    held = ", ".join(f"{{'held': {flag}, 'text': '{text}'}}" for flag, text in drift.REASONS)
    return CTE + _copies(only_target) + f""",
judged as (select *, [{held}] as flags from copies)
select * exclude (flags),
       if(list_aggregate(list_transform(flags, lambda f: (f.held is distinct from false)::int), 'sum') > 0, 'REFRESH', 'SKIP') as action,
       array_to_string(list_transform(list_filter(flags, lambda f: f.held), lambda f: '"' || f.text || '"'), ' ') as reasons
  from judged"""


@register("copy_base_tables", CTE + _KNOWN + "\nfrom known")
def copy_base_tables(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    return drift.tables_with_lineage(t, m, *SRC)


@register("copy_eligible", CTE + _ORIGINALS + "\nfrom originals")
def copy_eligible(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    return drift.eligible_for_copy(drift.tables_with_lineage(t, m, *SRC))


@register("copy_collisions", CTE + _ORIGINALS + f"\nfrom originals where table_name in {_TAKEN}")
def copy_collisions(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    elig = drift.eligible_for_copy(drift.tables_with_lineage(t, m, *SRC))
    return drift.collisions(elig, t, *DST)


@register("copy_first_plan", CTE + _ORIGINALS + f"""
select 'TEST_DB.SC_2' as target_db_sc, table_catalog || '.' || table_schema as source_db_sc, table_name,
       'CREATE OR REPLACE' as action, table_name in {_TAKEN} as collision
  from originals""")
def copy_first_plan(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    return drift.first_copy_plan(t, m, *SRC, *DST, delete_existing=True)


@register("copy_drift_flags", CTE + _SIDE_BY_SIDE + "\nfrom marked")
def copy_drift_flags(spark, sf_dir):
    t, _ = _inputs(spark, sf_dir)
    return drift.drift_flags(t, *SRC, *DST)


@register("copy_refresh_plan", _plan_sql(True))
def copy_refresh_plan(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    return drift.refresh_plan(t, m, *SRC, *DST, scope="target")


@register("copy_refresh_plan_reference", _plan_sql(False))
def copy_refresh_plan_reference(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    return drift.refresh_plan(t, m, *SRC, *DST, scope="reference")


@register("copy_removal_plan", CTE + _copies(True) + "\nselect clone_db_sc, src_db_sc, table_name, 'DROP' as action from copies")
def copy_removal_plan(spark, sf_dir):
    t, m = _inputs(spark, sf_dir)
    return drift.removal_plan(t, m, *SRC, *DST)


@register("copy_refresh_counts", "select count(*) as n, count(*) filter (where action = 'SKIP') as skipped from ("
          + _plan_sql(True) + ") p")
def copy_refresh_counts(spark, sf_dir):
    """Refresh plan totals (rows, of which skipped)."""
    t, m = _inputs(spark, sf_dir)
    p = drift.refresh_plan(t, m, *SRC, *DST)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("action") == "SKIP", 1)).alias("skipped"))



@register("copy_refresh_apply", "select p.clone_db_sc as db_sc, d.table_name, d.l_linenumber, d.l_quantity, "
          "d.l_returnflag from (" + _plan_sql(True) + ") p join (" + oracle_cte("table_data")
          + " select * from table_data) d on d.db_sc = p.src_db_sc and d.table_name = p.table_name "
          "where p.action = 'REFRESH'")
def copy_refresh_apply(spark, sf_dir):
    """The rows every refreshed copy holds after the refresh (its source's rows)."""
    t, m = _inputs(spark, sf_dir)
    plan = drift.refresh_plan(t, m, *SRC, *DST)
    return drift.refresh_rows(plan, fixture(spark, sf_dir, "table_data"))


@register("copy_refresh_versions", "with p as (select * from (" + _plan_sql(True) + """) where action = 'REFRESH'),
d as (select * from (""" + oracle_cte("table_data") + """ select * from table_data)),
names as (select db_sc, table_name from d union select clone_db_sc, table_name from p)
select names.db_sc, names.table_name, count(d.table_name) as n_rows, sum(d.l_quantity::bigint)::bigint as quantity,
       any_value(p.table_name) is not null as rewritten
  from names left join p on p.clone_db_sc = names.db_sc and p.table_name = names.table_name
  left join d on d.db_sc = coalesce(p.src_db_sc, names.db_sc) and d.table_name = names.table_name
 group by names.db_sc, names.table_name""")
def copy_refresh_versions(spark, sf_dir):
    """C10 through a stored dataset: every table after the refresh, and whether the
    refresh wrote it (drifted copies only)."""
    import uuid

    from ledgerline.session import scratch_path
    from ledgerline.sources.datasets import VERSION, Dataset

    path = scratch_path(spark, f"dataset-{uuid.uuid4().hex}")
    store = Dataset(spark, path)
    first = store.create(fixture(spark, sf_dir, "table_data"))
    rows = drift.refresh_dataset(drift.refresh_plan(*_inputs(spark, sf_dir), *SRC, *DST), path)
    held = rows.groupBy("db_sc", "table_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return store.tables().join(held, ["db_sc", "table_name"], "left").select(
        "db_sc", "table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "quantity",
        (F.col(VERSION) != first).alias("rewritten"))
