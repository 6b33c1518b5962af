"""Catalog snapshot queries: schemas, objects, overloads, change detection,
content and the next manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import snapshot
from ledgerline.plans.registry import register
from ledgerline.sources.fixtures import fixture, oracle_cte

RUN_TS = "2030-01-01 00:00:00"
CTE = oracle_cte("catalog_objects", "catalog_listing", "export_manifest")


def _objects(spark, sf_dir):
    """Overloaded procedures/functions plus every other listed object."""
    procs = fixture(spark, sf_dir, "catalog_objects")
    others = (snapshot.object_list(fixture(spark, sf_dir, "catalog_listing"))
              .withColumn("argument_signature", F.lit(None).cast("string"))
              .withColumn("ddl", F.concat(F.lit("CREATE "), F.col("obj_type"), F.lit(" "), F.col("obj_name"))))
    return procs.unionByName(others)


_EXT_SQL = """case obj_type when 'TABLE' then '.tbl' when 'EXTERNAL TABLE' then '.tbl' when 'DYNAMIC TABLE' then '.tbl'
  when 'VIEW' then '.vw' when 'PROCEDURE' then '.pr' when 'TASK' then '.tsk' when 'STREAM' then '.stm'
  when 'FILE_FORMAT' then '.ff' when 'PIPE' then '.pipe' when 'FUNCTION' then '.func' when 'SEQUENCE' then '.seq' end"""

_OBJ_SQL = f""",
lst as (
select db_nm, sc_nm,
       case when source = 'tables' then 'TABLE' when source = 'show' then table_type
            when source = 'external_tables' then 'EXTERNAL TABLE' when source = 'views' then 'VIEW'
            when source = 'file_formats' then 'FILE_FORMAT' when source = 'sequences' then 'SEQUENCE'
            when source = 'pipes' then 'PIPE' end as obj_type,
       obj_name,
       case when source = 'show' then created_on else last_altered end as last_altered
  from catalog_listing
 where source <> 'tables' or (table_type like '%TABLE' and table_type not like 'EXTERNAL TABLE')),
objs as (
select db_nm, sc_nm, obj_type, obj_name, last_altered, argument_signature, ddl from catalog_objects
union all
select db_nm, sc_nm, obj_type, obj_name, last_altered, null, 'CREATE ' || obj_type || ' ' || obj_name
  from lst where obj_type is not null),
files as (
select db_nm, sc_nm, obj_type, obj_name, max(last_altered) as obj_last_altered,
       obj_name || {_EXT_SQL} as file_nm
  from objs group by db_nm, sc_nm, obj_type, obj_name),
chg as (
select coalesce(f.db_nm, m.db_nm) as db_nm, coalesce(f.sc_nm, m.sc_nm) as sc_nm,
       coalesce(f.file_nm, m.file_nm) as file_nm, f.obj_type, f.obj_name, f.obj_last_altered, m.file_last_modified,
       case when f.obj_name is null then 'NOT_SEEN' when m.file_last_modified is null then 'NEW'
            when m.file_last_modified >= f.obj_last_altered then 'NO_CHANGE' else 'CHANGED' end as status
  from files f full outer join export_manifest m
    on f.db_nm = m.db_nm and f.sc_nm = m.sc_nm and f.file_nm = m.file_nm)"""


@register("schema_list", oracle_cte("schemata") + """
select catalog_name as database_name, schema_name from schemata
 where deleted is null and schema_name not in ('INFORMATION_SCHEMA')""")
def schema_list(spark, sf_dir):
    return snapshot.schema_list(fixture(spark, sf_dir, "schemata"))


@register("object_list", CTE + _OBJ_SQL + "\nselect * from lst where obj_type is not null")
def object_list(spark, sf_dir):
    return snapshot.object_list(fixture(spark, sf_dir, "catalog_listing"))


@register("snapshot_overloads", CTE + """
select db_nm, sc_nm, obj_type, obj_name, argument_signature,
       max(last_altered) over (partition by db_nm, sc_nm, obj_type, obj_name) as obj_last_altered
  from catalog_objects""")
def snapshot_overloads(spark, sf_dir):
    o = snapshot.with_overload_time(fixture(spark, sf_dir, "catalog_objects"))
    return o.select("db_nm", "sc_nm", "obj_type", "obj_name", "argument_signature", "obj_last_altered")


@register("snapshot_signatures", CTE + """
select distinct obj_type, obj_name, argument_signature,
       case when argument_signature = '()' then '()'
            else '(' || array_to_string(list_filter(string_split(argument_signature, ' '), lambda x, i: i % 2 = 0), ' ')
       end as arguments
  from catalog_objects""")
def snapshot_signatures(spark, sf_dir):
    o = fixture(spark, sf_dir, "catalog_objects")
    return (o.select("obj_type", "obj_name", "argument_signature",
                     snapshot.normalise_signature(F.col("argument_signature")).alias("arguments")).distinct())


@register("snapshot_changes", CTE + _OBJ_SQL + "\nselect * from chg")
def snapshot_changes(spark, sf_dir):
    return snapshot.changes(_objects(spark, sf_dir), fixture(spark, sf_dir, "export_manifest"))


@register("snapshot_scope", CTE + _OBJ_SQL.replace("from objs group by", "from objs where sc_nm = 'SC_1' group by")
          .replace("full outer join export_manifest m", "full outer join (select * from export_manifest where sc_nm = 'SC_1') m")
          + "\nselect db_nm, sc_nm, file_nm, case when status = 'NOT_SEEN' then 'DELETE' else status end as status from chg")
def snapshot_scope(spark, sf_dir):
    scope = spark.createDataFrame([("TEST_DB", "SC_1")], "db_nm string, sc_nm string")
    c = snapshot.changes(_objects(spark, sf_dir), fixture(spark, sf_dir, "export_manifest"), delete=True, scope=scope)
    return c.select("db_nm", "sc_nm", "file_nm", "status")


@register("snapshot_content", CTE + _OBJ_SQL + """
select o.db_nm, o.sc_nm, o.obj_name || """ + _EXT_SQL.replace("obj_type", "o.obj_type") + """ as file_nm,
       string_agg(o.ddl, chr(10) order by coalesce(o.argument_signature, ''), o.ddl) as content,
       count(*) as n_parts
  from objs o join chg c on o.db_nm = c.db_nm and o.sc_nm = c.sc_nm
   and o.obj_name || """ + _EXT_SQL.replace("obj_type", "o.obj_type") + """ = c.file_nm
 where c.status in ('NEW', 'CHANGED')
 group by o.db_nm, o.sc_nm, 3""")
def snapshot_content(spark, sf_dir):
    objs = _objects(spark, sf_dir)
    c = snapshot.changes(objs, fixture(spark, sf_dir, "export_manifest"))
    return snapshot.content(objs, c.filter(F.col("status").isin("NEW", "CHANGED")))


@register("snapshot_manifest", CTE + _OBJ_SQL + f"""
select db_nm, sc_nm, file_nm,
       case when status in ('NEW', 'CHANGED') then timestamp '{RUN_TS}' else file_last_modified end
         as file_last_modified
  from chg""")
def snapshot_manifest(spark, sf_dir):
    c = snapshot.changes(_objects(spark, sf_dir), fixture(spark, sf_dir, "export_manifest"))
    return snapshot.next_manifest(c, F.lit(RUN_TS).cast("timestamp_ntz"))


@register("snapshot_status_counts", CTE + _OBJ_SQL + "\nselect status, count(*) as n from chg group by status")
def snapshot_status_counts(spark, sf_dir):
    c = snapshot.changes(_objects(spark, sf_dir), fixture(spark, sf_dir, "export_manifest"))
    return c.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("snapshot_parts", CTE + _OBJ_SQL + """
select o.db_nm, o.sc_nm, c.file_nm, coalesce(o.argument_signature, '') as part, o.ddl as content
  from objs o join chg c on o.db_nm = c.db_nm and o.sc_nm = c.sc_nm and o.obj_type = c.obj_type and o.obj_name = c.obj_name
 where c.status in ('NEW', 'CHANGED')""")
def snapshot_parts(spark, sf_dir):
    """The rows a run stores: one per overload of a new or changed file."""
    objs = _objects(spark, sf_dir)
    c = snapshot.changes(objs, fixture(spark, sf_dir, "export_manifest"))
    return snapshot.content_parts(objs, c.filter(F.col("status").isin("NEW", "CHANGED")))


# Between two runs, objects of one schema change: some are altered with a new text,
# some are altered but their text cannot be fetched, some vanish.
_LATER = "timestamp '2040-01-01 00:00:00'"


_TWO_RUNS = CTE + _OBJ_SQL + """,
kinds as (select *, obj_name || """ + _EXT_SQL + """ as file_nm, length(obj_name) % 5 as fate from objs),
stored as (
  select k.db_nm, k.sc_nm, k.file_nm, k.argument_signature, k.fate,
         case when c.status in ('NEW', 'CHANGED') then k.ddl end as first_text, k.ddl || ' v2' as second_text, c.status
    from kinds k join chg c using (db_nm, sc_nm, file_nm)),
texts as (
  select db_nm, sc_nm, file_nm, argument_signature,
         case when fate = 2 and sc_nm = 'SC_1' then second_text else first_text end as txt
    from stored where not (fate = 4 and sc_nm = 'SC_1'))
select db_nm, sc_nm, file_nm, string_agg(txt, chr(10) order by coalesce(argument_signature, ''), txt) as content, count(*) as n_parts
  from texts where txt is not null group by db_nm, sc_nm, file_nm"""


def _two_runs(spark, sf_dir) -> str:
    """Two runs into one folder, which is returned."""
    import uuid

    from ledgerline import jobs
    from ledgerline.session import scratch_path

    root = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    objs = _objects(spark, sf_dir)
    jobs.export_snapshot(spark, objs, fixture(spark, sf_dir, "export_manifest"), root, run_ts=F.lit(RUN_TS).cast("timestamp_ntz"))
    fate, here = F.length("obj_name") % 5, F.col("sc_nm") == "SC_1"
    later = (objs.where(~(here & (fate == 4)))
             .withColumn("last_altered", F.when(here & fate.isin(2, 3), F.expr(_LATER).cast(objs.schema["last_altered"].dataType))
                         .otherwise(F.col("last_altered")))
             .withColumn("ddl", F.when(here & (fate == 2), F.concat("ddl", F.lit(" v2")))
                         .when(~(here & (fate == 3)), F.col("ddl"))))
    jobs.export_snapshot(spark, later, jobs.current_manifest(spark, root), root, delete=True,
                         run_ts=F.lit("2041-01-01 00:00:00").cast("timestamp_ntz"))
    return root


@register("snapshot_two_runs", _TWO_RUNS)
def snapshot_two_runs(spark, sf_dir):
    """K5-K7, E4-E7 through the job: two runs into one folder, and all files as they
    then are. Unchanged files keep their text, errors keep the old one, vanished go."""
    from ledgerline import jobs

    return jobs.current_content(spark, _two_runs(spark, sf_dir))


@register("snapshot_vacuumed", "with f as (" + _TWO_RUNS + """)
select *, sum(n_parts) over ()::bigint as stored_parts from f""")
def snapshot_vacuumed(spark, sf_dir):
    """K7, E5: the same files after a vacuum, and how many parts are stored in all:
    those of the files, nothing replaced or vanished."""
    from ledgerline import jobs
    from ledgerline.sources.sinks import read_snapshot

    root = _two_runs(spark, sf_dir)
    jobs.vacuum_snapshot(spark, root)
    stored = read_snapshot(spark, f"{root}/content").count()
    return jobs.current_content(spark, root).withColumn("stored_parts", F.lit(stored).cast("bigint"))
