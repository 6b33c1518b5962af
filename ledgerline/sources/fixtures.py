"""Test inputs derived from the base tables.

The reference ships no data, so the catalog-shaped inputs the operators need
(two tables to reconcile, a table catalog with lineage, grants, role specs,
catalog objects, a manifest, names) are derived from the TPC-H-style tables.
Each fixture is one SQL text that runs on Spark (base tables bound as DataFrame
arguments) and on DuckDB (base tables as views), so the oracle and the Spark
job read identical inputs; only the one-row-per-level generator is spelt for
each of them. Every fixture reads whole tables and keeps
every row: rows a *to* side should be missing get a NULL key instead of being
filtered out — NULL keys are never counted, shared or joined, so they are
missing to the reconciliation while the job still reads and shuffles them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.tables import BASE_TABLES, read_table

# Access levels of the sample account, highest first.
LEVELS = {"db": ("OWN", "EDT", "RUN", "VEW"), "wh": ("OWN", "TUN", "WAT", "OPR")}


def _model_sql(types) -> str:
    """Rows (obj_type, ar_prefix, role_owner, pos, role, privilege, kind) of a model;
    a level without privileges keeps one row without."""
    rows = []
    for obj_type, prefix, owner, levels, grants in types:
        for pos, role in enumerate(levels):
            pairs = [(p, k) for p, kinds in grants[role].items() for k in kinds] or [(None, None)]
            rows += [(obj_type, prefix, owner, pos, role, p, k) for p, k in pairs]
    text = [", ".join("cast(null as string)" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) for r in rows]
    return ("select * from (values " + ",\n".join(f"({t})" for t in text)
            + ") as m(obj_type, ar_prefix, role_owner, pos, role, privilege, kind)")


FIXTURE_SQL: dict[str, str] = {
    # --- tie-out, unique key ------------------------------------------------
    "tie_from": """
select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate,
       o_custkey % 5 as from_extra, o_orderkey as _ignore_me
  from {orders}""",
    "tie_to": """
select case when o_orderkey % 50 = 3 then null when o_orderkey % 97 = 0 then o_orderkey + 100000000
            when o_orderkey % 211 = 5 then null else o_orderkey end as o_orderkey,
       case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey,
       case when o_orderkey % 10 = 0 then null when o_orderkey % 9 = 0 then ''
            else o_orderstatus end as o_orderstatus,
       case when o_orderkey % 7 = 0 then lower(o_orderpriority) else o_orderpriority end
         as o_orderpriority,
       o_orderdate, 'x' as to_extra, o_orderkey + 1 as _ignore_me
  from {orders}""",
    # --- tie-out, duplicate keys -------------------------------------------
    "dup_from": """
select l_orderkey, l_linenumber, l_returnflag, l_linestatus from {lineitem}""",
    "dup_to": """
select case when l_suppkey % 6 = 1 then null else l_orderkey end as l_orderkey, l_linenumber,
       case when l_partkey % 4 = 0 then null else l_returnflag end as l_returnflag,
       l_linestatus
  from {lineitem}""",
    # --- tie-out with one hot key: a third of all rows share order key 0 ----
    "hot_from": """
select case when l_orderkey % 3 = 0 then 0 else l_orderkey end as l_orderkey,
       l_returnflag, l_linestatus, l_quantity
  from {lineitem}""",
    "hot_to": """
select case when l_suppkey % 6 = 1 then null when l_orderkey % 3 = 0 then 0 else l_orderkey end as l_orderkey,
       case when l_partkey % 4 = 0 then null else l_returnflag end as l_returnflag,
       l_linestatus,
       case when l_partkey % 13 = 0 then l_quantity + 1 else l_quantity end as l_quantity
  from {lineitem}""",
    # --- wide tie-out used by the benchmark (all lineitem columns) ----------
    "line_to": """
select case when l_suppkey % 6 = 1 then null else l_orderkey end as l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when l_partkey % 13 = 0 then l_quantity + 1 else l_quantity end as l_quantity,
       l_extendedprice, l_discount,
       case when l_suppkey % 17 = 0 then null else l_tax end as l_tax,
       case when l_partkey % 4 = 0 then lower(l_returnflag) else l_returnflag end as l_returnflag,
       l_linestatus, l_shipdate
  from {lineitem}""",
    "orders_to": """
select case when o_orderkey % 50 = 3 then null when o_orderkey % 97 = 0 then o_orderkey + 100000000
            else o_orderkey end as o_orderkey,
       o_custkey,
       case when o_orderkey % 10 = 0 then null else o_orderstatus end as o_orderstatus,
       case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
       o_orderdate,
       case when o_orderkey % 7 = 0 then lower(o_orderpriority) else o_orderpriority end
         as o_orderpriority
  from {orders}""",
    # --- tie-out of columns whose types differ ------------------------------
    "typed_from": """
select o_orderkey, cast(o_custkey as int) as a_int, cast(o_orderkey % 100 as decimal(10, 2)) as b_dec,
       cast(o_orderdate as date) as c_date, map({list}'a', 'b'{end}, {list}o_orderkey % 7, 2{end}) as d_map, o_orderstatus as e_text
  from {orders}""",
    "typed_to": """
select o_orderkey, cast(o_custkey + case when o_orderkey % 8 = 0 then 1 else 0 end as double) as a_int,
       cast(o_orderkey % 100 as decimal(14, 4)) + cast(case when o_orderkey % 6 = 0 then 0.0001 else 0 end as decimal(5, 4)) as b_dec,
       cast(cast(o_orderdate as date) as timestamp) + interval '1' microsecond * (case when o_orderkey % 5 = 0 then 1 else 0 end) as c_date,
       map({list}'b', 'a'{end}, {list}case when o_orderkey % 9 = 0 then 3 else 2 end, o_orderkey % 7{end}) as d_map, o_orderstatus as e_text
  from {orders}""",
    # One table per order (its number halved), with a column per line; the tables
    # of even and odd orders lie in two schemas.
    "catalog_columns": """
select case when l_orderkey % 2 = 0 then 'SC_1' else 'SC_2' end as table_schema,
       'T_' || cast(cast(floor(l_orderkey / 2) as bigint) as string) as table_name,
       case when l_partkey % 3 = 0 then 'col_' else 'COL_' end || cast(l_linenumber as string) as column_name
  from {lineitem}""",
    # --- copy drift ---------------------------------------------------------
    "cat_tables": """
select 'TEST_DB' as table_catalog,
       case when o_orderkey % 2 = 0 then 'SC_1' else 'SC_2' end as table_schema,
       'T_' || cast(cast(floor(o_orderkey / 2) as bigint) as string) as table_name,
       case when o_orderkey % 17 = 0 then 'VIEW' else 'BASE TABLE' end as table_type,
       case when o_orderkey % 31 = 0 then null else o_custkey % 4 end as row_count,
       o_custkey % 3 as bytes, o_orderdate as created, o_orderdate as last_altered
  from {orders}""",
    "storage_metrics": """
select o_orderkey as id,
       case when o_orderkey % 2 = 1 and o_orderkey % 6 <> 1 then o_orderkey - 1
            when o_orderkey % 22 = 0 and o_orderkey > 0 then o_orderkey - 2
            else o_orderkey end as clone_group_id,
       'TEST_DB' as table_catalog,
       case when o_orderkey % 2 = 0 then 'SC_1' else 'SC_2' end as table_schema,
       'T_' || cast(cast(floor(o_orderkey / 2) as bigint) as string) as table_name,
       o_custkey % 3 as active_bytes, o_custkey % 2 as retained_for_clone_bytes,
       o_orderkey % 20 = 4 as deleted
  from {orders}""",
    # Table contents for the copy-drift catalog: table T_k of SC_1 holds the
    # lines of order 2k, its namesake in SC_2 those of order 2k+1.
    "table_data": """
select case when l_orderkey % 2 = 0 then 'TEST_DB.SC_1' else 'TEST_DB.SC_2' end as db_sc,
       'T_' || cast(cast(floor(l_orderkey / 2) as bigint) as string) as table_name,
       l_linenumber, l_quantity, l_returnflag
  from {lineitem}""",
    # --- access roles -------------------------------------------------------
    "future_grants_schema": """
select n_name as db_name, 'SC_' || cast(c_custkey as string) as sc_name,
       n_name || '.SC_' || cast(c_custkey as string) as db_sc,
       '_SC_' || n_name || '_SC_' || cast(c_custkey as string) || '_' || r.role || '_AR'
         as grantee_name,
       case r.role when 'VEW' then 'SELECT' when 'RUN' then 'USAGE'
            else case when c_custkey % 12 = 5 then 'MODIFY' else 'ALL' end end as privilege,
       case r.role when 'OWN' then 'STAGES' when 'RUN' then 'SCHEMA' else 'TABLES' end as kind
  from {customer} join {nation} on c_nationkey = n_nationkey {each_db}""",
    "role_grants": """
select 'TEAM_' || cast(c_custkey % 25 as string) || '_FR' as role_name,
       case when c_custkey % 40 = 0 then 'OWNERSHIP' when c_custkey % 41 = 0 then 'MONITOR'
            else 'USAGE' end as privilege,
       case when c_custkey % 13 = 0 then 'TEAM_' || cast(c_custkey % 7 as string) || '_FR'
            else '_SC_' || n_name || '_SC_' || cast(c_custkey as string)
                 || case when c_custkey % 2 = 0 then '_VEW_AR' else '_EDT_AR' end end
         as granted_name
  from {customer} join {nation} on c_nationkey = n_nationkey""",
    "role_spec": """
select 'TEAM_' || cast(n_nationkey as string) || '_FR' as role_name, 'INCLUDE' as rule,
       n_name as db_pattern, 'SC_1%' as sc_pattern, 'VEW' as role_type
  from {nation}
union all
select 'TEAM_' || cast(n_nationkey as string) || '_FR', 'EXCLUDE', n_name, '%7', null
  from {nation}""",
    "future_grants_db": """
select n_name as db_name, '_DB_' || n_name || '_' || r.role || '_AR' as grantee_name,
       case when n_nationkey % 4 = 1 then 'INSERT' else 'SELECT' end as privilege, 'TABLES' as kind
  from {nation} {each_db}""",
    "grants_to_roles": """
select 'WH_' || cast(s_suppkey as string) as name,
       case when s_suppkey % 5 = 2 then 'TABLE' else 'WAREHOUSE' end as granted_on,
       case when s_suppkey % 7 = 3 then timestamp '2024-01-01 00:00:00' else null end
         as deleted_on,
       '_WH_WH_' || cast(s_suppkey as string) || '_' || r.role || '_AR' as grantee_name,
       case r.role when 'OWN' then 'ALL' when 'TUN' then 'MODIFY' when 'WAT' then 'USAGE' else 'OPERATE' end as privilege
  from {supplier} {each_wh}""",
    "roles": """
select 'TEAM_' || cast(n_nationkey as string)
         || case when n_nationkey % 3 = 0 then '_AR' else '_FR' end as name,
       case when n_nationkey % 8 = 5 then timestamp '2024-01-01 00:00:00' else null end
         as deleted_on
  from {nation}""",
    "schemata": """
select n_name as catalog_name,
       case when c_custkey % 9 = 0 then 'INFORMATION_SCHEMA'
            when c_custkey % 14 = 0 then 'A-B_' || cast(c_custkey as string)
            else 'SC_' || cast(c_custkey as string) end as schema_name,
       case when c_custkey % 12 = 0 then 'ACCOUNTADMIN' else 'SYSADMIN' end as schema_owner,
       case when c_custkey % 10 = 1 then timestamp '2024-01-01 00:00:00' else null end
         as deleted
  from {customer} join {nation} on c_nationkey = n_nationkey""",
    "databases": """
select n_name as database_name,
       case when n_nationkey % 6 = 0 then 'ACCOUNTADMIN' else 'SYSADMIN' end as database_owner
  from {nation}""",
    # Role spec with every rule kind, one row per rule: the schema rules above,
    # database includes (some naming a level missing from the hierarchy),
    # warehouse includes and excludes, and role includes.
    "role_spec_all": """
select 'TEAM_' || cast(n_nationkey as string) || '_FR' as role_name, 'INCLUDE' as rule,
       'SCHEMA' as obj_type, n_name as db_pattern, 'SC_1%' as sc_pattern,
       cast(null as string) as wh_pattern, cast(null as string) as role_pattern, 'VEW' as role_type
  from {nation}
union all
select 'TEAM_' || cast(n_nationkey as string) || '_FR', 'EXCLUDE', 'SCHEMA', n_name, '%7', null, null, null
  from {nation}
union all
select 'TEAM_' || cast(n_nationkey as string) || '_FR', 'INCLUDE', 'DATABASE', n_name, null, null, null,
       case when n_nationkey % 5 = 0 then 'XX' else 'RUN' end
  from {nation}
union all
select 'TEAM_' || cast(s_suppkey % 30 as string) || '_FR', 'INCLUDE', 'WAREHOUSE', null, null,
       'WH_' || cast(s_suppkey as string), null,
       case when s_suppkey % 4 = 0 then 'WAT' else 'OPR' end
  from {supplier}
union all
select 'TEAM_' || cast(n_nationkey as string) || '_FR', 'EXCLUDE', 'WAREHOUSE', null, null,
       'WH_' || cast(n_nationkey as string) || '%', null, null
  from {nation}
union all
select 'TEAM_' || cast(n_nationkey as string) || '_FR', 'INCLUDE', 'ROLE', null, null, null,
       'TEAM_' || cast((n_nationkey + 1) % 25 as string) || '%', null
  from {nation}
union all
select 'TEAM_' || cast(n_nationkey as string) || '_FR', 'INCLUDE', null, n_name, null, null, null, 'VEW'
  from {nation} where n_nationkey % 3 = 1""",
    # Role-spec documents, one per customer; a role named by several is the last one's.
    "spec_documents": """
select c_custkey as seq, chr(123) || '"TEAM_' || cast(c_custkey % 100 as string) || '_FR":' || chr(123)
       || '"ORDER":"INCEXC","INCLUDE":[' || chr(123) || '"TYPE":"SCHEMA","DATABASE":"' || n_name || '","SCHEMA":"SC_'
       || cast(c_custkey as string) || '","ROLE":"VEW"' || chr(125) || '],"EXCLUDE":[],"CUSTOM_INCLUDE":["X_FR"],'
       || '"CUSTOM_EXCLUDE":[],"SCIM_ROLES":[]' || chr(125) || chr(125) as doc
  from {customer} join {nation} on c_nationkey = n_nationkey""",
    # Documents with faults: keys missing, rules that are no object or no list.
    "spec_documents_faulty": """
select c_custkey as seq, chr(123) || '"U_' || cast(c_custkey as string) || '_FR":' || chr(123)
       || case when c_custkey % 2 = 0 then '"ORDER":"INCEXC",' else '' end
       || '"INCLUDE":' || case c_custkey % 3 when 0 then '["x"]' when 1 then '"x"' else '[]' end
       || ',"EXCLUDE":[],"CUSTOM_INCLUDE":[],"CUSTOM_EXCLUDE":[],"SCIM_ROLES":[]' || chr(125) || chr(125) as doc
  from {customer}""",
    # Per-customer functional-role spec rows (custom lists): grows with customer.
    "role_custom": """
select 'TEAM_' || cast(c_custkey % 25 as string) || '_FR' as role_name,
       case when c_custkey % 3 = 0 then 'CUSTOM_EXCLUDE' else 'CUSTOM_INCLUDE' end as rule,
       case when c_custkey % 5 = 0 then 'TEAM_' || cast(c_custkey % 9 as string) || '_FR'
            when c_custkey % 5 = 1 then 'LOOSE_' || cast(c_custkey as string)
            else '_SC_' || n_name || '_SC_' || cast(c_custkey as string) || '_EDT_AR' end
         as role_ref
  from {customer} join {nation} on c_nationkey = n_nationkey""",
    # --- privilege model ----------------------------------------------------
    # Three object types with owners of their own; every schema kind is named.
    # RUN has no direct privileges at schema level.
    "privilege_model": _model_sql([
        ("DATABASE", "_DB_", "DB_KEEPER", LEVELS["db"], {
            "OWN": {"ALL": ["DATABASE"]}, "EDT": {"CREATE SCHEMA": ["DATABASE"]},
            "RUN": {"USAGE": ["DATABASE"]}, "VEW": {"MONITOR": ["DATABASE"], "SELECT": ["TABLES"]}}),
        ("SCHEMA", "_SC_", "SC_KEEPER", LEVELS["db"], {
            "OWN": {"ALL": ["STAGES", "TASKS", "PIPES"]},
            "EDT": {"ALL": ["TABLES", "EXTERNAL TABLES", "SEQUENCES", "STREAMS", "PROCEDURES"]},
            "RUN": {},
            "VEW": {"ALL": ["VIEWS", "MATERIALIZED VIEWS", "FILE FORMATS", "FUNCTIONS"], "SELECT": ["TABLES"]}}),
        ("WAREHOUSE", "_WH_", "WH_KEEPER", LEVELS["wh"], {
            "OWN": {"ALL": ["WAREHOUSE"]}, "TUN": {"MODIFY": ["WAREHOUSE"]}, "WAT": {"MONITOR": ["WAREHOUSE"]},
            "OPR": {"OPERATE": ["WAREHOUSE"], "USAGE": ["WAREHOUSE"]}}),
    ]),
    # Objects the model is expanded over: one database per nation, one schema
    # per customer (the live schemata above).
    "model_objects": """
select 'DATABASE' as obj_type, n_name as db_nm, cast(null as string) as sc_nm
  from {nation}
union all
select 'SCHEMA', n_name, 'SC_' || cast(c_custkey as string)
  from {customer} join {nation} on c_nationkey = n_nationkey
union all
select 'WAREHOUSE', 'WH_' || cast(s_suppkey as string), null from {supplier}""",
    # --- catalog snapshot ---------------------------------------------------
    # One procedure or function per order, one overload per line item.
    "catalog_objects": """
select 'TEST_DB' as db_nm,
       case when l_orderkey % 3 = 0 then 'SC_2' else 'SC_1' end as sc_nm,
       case when l_orderkey % 2 = 0 then 'PROCEDURE' else 'FUNCTION' end as obj_type,
       'OBJ_' || cast(l_orderkey as string) as obj_name, l_shipdate as last_altered,
       case when l_linenumber = 1 then '()' when l_linenumber = 2 then '(A VARCHAR)'
            else '(A VARCHAR, B NUMBER)' end as argument_signature,
       'CREATE ' || case when l_orderkey % 2 = 0 then 'PROCEDURE' else 'FUNCTION' end
         || ' OBJ_' || cast(l_orderkey as string) || ' -- ' || cast(l_partkey as string)
         as ddl
  from {lineitem}""",
    # The manifest a previous run left: one file per order. Some were written
    # after the object changed (NO_CHANGE), some before (CHANGED), some under an
    # old name (NOT_SEEN, and their objects NEW).
    "export_manifest": """
select 'TEST_DB' as db_nm,
       case when o_orderkey % 3 = 0 then 'SC_2' else 'SC_1' end as sc_nm,
       case when o_orderkey % 10 = 8 then 'OLD_' else 'OBJ_' end || cast(o_orderkey as string)
         || case when o_orderkey % 2 = 0 then '.pr' else '.func' end as file_nm,
       case when o_orderkey % 4 = 1 then o_orderdate + interval 400 day else o_orderdate end
         as file_last_modified
  from {orders}""",
    # information_schema-like listing of tables, views and other kinds.
    "catalog_listing": """
select 'TEST_DB' as db_nm,
       case when o_orderkey % 2 = 0 then 'SC_1' else 'SC_2' end as sc_nm,
       case o_orderkey % 10 when 0 then 'tables' when 1 then 'tables' when 2 then 'tables'
            when 3 then 'external_tables' when 4 then 'views' when 5 then 'file_formats'
            when 6 then 'sequences' when 7 then 'pipes' else 'show' end as source,
       case o_orderkey % 10 when 0 then 'BASE TABLE' when 1 then 'EXTERNAL TABLE'
            when 2 then 'TEMPORARY TABLE' when 8 then 'TASK' when 9 then 'STREAM'
            else null end as table_type,
       'O_' || cast(o_orderkey as string) as obj_name,
       case when o_orderkey % 10 = 8 then null else o_orderdate end as last_altered,
       o_orderdate - interval 30 day as created_on
  from {orders}""",
    # --- name audit ---------------------------------------------------------
    "names": """
select p_partkey as id,
       case when p_partkey % 6 = 0 then p_name when p_partkey % 6 = 1 then '"' || p_name || '"'
            when p_partkey % 6 = 2 then 'P_' || cast(p_partkey as string)
            when p_partkey % 6 = 3 then cast(p_partkey as string) || '_P'
            when p_partkey % 6 = 4 then 'db.' || '"' || p_name || '.x"'
            else 'DB.SC_' || cast(p_partkey as string) end as name
  from {part}""",
}

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def _each(levels: tuple[str, ...], spark: bool) -> str:
    """One row per level beside every row, as r(role): a generator, no join, in Spark."""
    values = ", ".join(f"'{x}'" for x in levels)
    return f"lateral view explode(array({values})) r as role" if spark else f"cross join (select unnest([{values}]) as role) r"


def _text(name: str, spark: bool) -> str:
    sql = FIXTURE_SQL[name]
    for kind, levels in LEVELS.items():
        sql = sql.replace(f"{{each_{kind}}}", _each(levels, spark))
    for mark, ours, theirs in (("{list}", "array(", "["), ("{end}", ")", "]")):
        sql = sql.replace(mark, ours if spark else theirs)
    return sql


def fixture_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(_text(name, True))))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture as a lazy DataFrame over the parquet tables in sf_dir."""
    tables = {t: read_table(spark, sf_dir, t) for t in fixture_tables(name)}
    return spark.sql(_text(name, True), **tables)


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [fixture(spark, sf_dir, n) for n in names]


def oracle_cte(*names: str) -> str:
    """`with a as (...), b as (...)` over the pre-registered base-table views."""
    parts = [f"{n} as ({_text(n, False).format(**{t: t for t in BASE_TABLES}).strip()})" for n in names]
    return "with " + ",\n".join(parts)
