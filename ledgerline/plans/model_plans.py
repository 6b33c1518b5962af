"""Privilege-model queries: the model expanded over one database per nation,
one schema per customer and one warehouse per supplier."""

from __future__ import annotations

from ledgerline.operators import access, model
from ledgerline.plans.registry import register
from ledgerline.sources.fixtures import fixture, oracle_cte

CTE = oracle_cte("privilege_model", "model_objects")

_ROLES_SQL = """,
lv as (select distinct obj_type, ar_prefix, role_owner, pos, role from privilege_model),
r as (
select o.obj_type, o.db_nm, o.sc_nm,
       case when o.obj_type = 'SCHEMA' then o.db_nm || '.' || o.sc_nm else o.db_nm end as object_name,
       lv.pos, lv.role as level, lv.role_owner,
       lv.ar_prefix || case when o.obj_type = 'SCHEMA' then o.db_nm || '_' || o.sc_nm else o.db_nm end
         || '_' || lv.role || '_AR' as role_name
  from model_objects o join lv on o.obj_type = lv.obj_type)"""

_EDGES_SQL = """,
e as (
select obj_type, object_name, role_name as granted_role,
       coalesce(lag(role_name) over (partition by obj_type, db_nm, sc_nm order by pos), role_owner) as grantee_role,
       'HIERARCHY' as edge, pos
  from r
union all
select r.obj_type, r.object_name, r.role_name, d.ar_prefix || r.db_nm || '_' || r.level || '_AR', 'SCHEMA_TO_DATABASE',
       r.pos
  from r join (select distinct ar_prefix, role from privilege_model where obj_type = 'DATABASE') d on d.role = r.level
 where r.obj_type = 'SCHEMA')"""

_PRIV_SQL = """,
j as (select r.*, p.privilege, p.kind from r join privilege_model p
        on r.obj_type = p.obj_type and r.level = p.role where p.kind is not null),
pv as (
select obj_type, object_name, role_name, privilege, kind, 'OBJECT' as scope, pos from j
 where (obj_type = 'DATABASE' and kind = 'DATABASE') or obj_type = 'WAREHOUSE'
union all
select obj_type, object_name, role_name, privilege, kind, s.scope, pos
  from j cross join (select 'ALL' as scope union all select 'FUTURE') s
 where (obj_type = 'DATABASE' and kind not in ('DATABASE', 'SCHEMA')) or obj_type = 'SCHEMA'
union all
select obj_type, db_nm, role_name, 'USAGE', 'DATABASE', 'BASE', pos from r
 where obj_type = 'SCHEMA' and pos = (select max(pos) from privilege_model where obj_type = 'SCHEMA')
union all
select obj_type, object_name, role_name, 'USAGE', 'SCHEMA', 'BASE', pos from r
 where obj_type = 'SCHEMA' and pos = (select max(pos) from privilege_model where obj_type = 'SCHEMA'))"""

_CREATE_SQL = """,
m as (select role, pos,
             case kind when 'TABLES' then 'TABLE' when 'EXTERNAL TABLES' then 'TABLE' when 'VIEWS' then 'VIEW'
                       when 'MATERIALIZED VIEWS' then 'VIEW' when 'FILE FORMATS' then 'FILE FORMAT'
                       when 'STAGES' then 'STAGE' when 'STREAMS' then 'STREAM' when 'SEQUENCES' then 'SEQUENCE'
                       when 'FUNCTIONS' then 'FUNCTION' when 'PROCEDURES' then 'PROCEDURE' when 'TASKS' then 'TASK'
             end as create_kind
        from privilege_model where obj_type = 'SCHEMA' and privilege = 'ALL' and kind is not null),
ck as (select create_kind, max(pos) as pos from m where create_kind is not null group by create_kind),
ch as (select distinct m.create_kind, m.pos, m.role from m join ck on m.create_kind = ck.create_kind and m.pos = ck.pos),
cp as (select r.obj_type, r.object_name, r.role_name, 'CREATE ' || ch.create_kind as privilege, ch.create_kind, r.pos
         from r join ch on r.pos = ch.pos and r.level = ch.role where r.obj_type = 'SCHEMA')"""


def _inputs(spark, sf_dir):
    return fixture(spark, sf_dir, "privilege_model"), fixture(spark, sf_dir, "model_objects")


@register("model_roles", CTE + _ROLES_SQL + "\nselect * exclude (role_owner) from r")
def model_roles(spark, sf_dir):
    return model.roles(*_inputs(spark, sf_dir))


@register("model_edges", CTE + _ROLES_SQL + _EDGES_SQL
          + "\nselect obj_type, object_name, granted_role, grantee_role, edge from e")
def model_edges(spark, sf_dir):
    return model.edges(*_inputs(spark, sf_dir))


@register("model_privileges", CTE + _ROLES_SQL + _PRIV_SQL
          + "\nselect obj_type, object_name, role_name, privilege, kind, scope from pv")
def model_privileges(spark, sf_dir):
    return model.privileges(*_inputs(spark, sf_dir))


@register("model_create_privileges", CTE + _ROLES_SQL + _CREATE_SQL
          + "\nselect obj_type, object_name, role_name, privilege, create_kind from cp")
def model_create_privileges(spark, sf_dir):
    return model.create_privileges(*_inputs(spark, sf_dir))


@register("model_ownership", CTE + _ROLES_SQL + """
select obj_type as target_type, case when obj_type = 'SCHEMA' then db_nm || '.' || sc_nm else db_nm end as target,
       p.privilege, o.role_owner as owner
  from model_objects cross join (select 'OWNERSHIP' as privilege union all select 'ALL PRIVILEGES') p
  join (select distinct obj_type as kept, role_owner from privilege_model) o on kept = obj_type
union all
select 'ROLE', role_name, 'OWNERSHIP', role_owner from r""")
def model_ownership(spark, sf_dir):
    return model.ownership(*_inputs(spark, sf_dir))


@register("model_reverse_plan", CTE + _ROLES_SQL + _EDGES_SQL + _PRIV_SQL + _CREATE_SQL + """
select 1 as phase, pos, 'REVOKE' as action, role_name, privilege, kind, scope, object_name,
       cast(null as varchar) as from_role
  from pv
union all
select 1, pos, 'REVOKE', role_name, privilege, null, 'CREATE', object_name, null from cp
union all
select 2, pos, 'REVOKE ROLE', granted_role, null, null, edge, object_name, grantee_role from e
union all
select 3, pos, 'DROP ROLE', role_name, null, null, null, object_name, null from r
union all
select 3, 1000000, 'DROP ' || obj_type, null, null, null, null,
       case when obj_type = 'SCHEMA' then db_nm || '.' || sc_nm else db_nm end, null from model_objects""")
def model_reverse_plan(spark, sf_dir):
    return model.reverse_plan(*_inputs(spark, sf_dir))


_AUDIT_CTE = oracle_cte("privilege_model", "model_objects", "future_grants_db", "databases",
                        "future_grants_schema", "schemata", "grants_to_roles")


@register("model_audit", _AUDIT_CTE + _ROLES_SQL + _PRIV_SQL + """,
dbg as (select * from future_grants_db
         where db_name in (select database_name from databases where database_owner not in ('ACCOUNTADMIN'))),
scg as (select g.* from future_grants_schema g
         where exists (select 1 from schemata s where s.catalog_name = g.db_name and s.schema_name = g.sc_name
                         and s.schema_owner not in ('ACCOUNTADMIN') and s.schema_name not like '%-%'
                         and s.schema_name not in ('INTERNAL', 'PUBLIC', 'INFORMATION_SCHEMA')
                         and s.catalog_name not in ('DEMO_DB') and s.deleted is null)),
whg as (select name as wh_name, grantee_name, privilege from grants_to_roles where deleted_on is null and granted_on = 'WAREHOUSE'),
act as (select 'DATABASE' as obj_type, db_name as object_name, grantee_name as role_name, privilege, kind from dbg
        union select 'SCHEMA', db_name || '.' || sc_name, grantee_name, privilege, kind from scg
        union select 'WAREHOUSE', wh_name, grantee_name, privilege, 'WAREHOUSE' from whg),
due as (select distinct obj_type, object_name, role_name, privilege, kind from pv
         where scope = 'FUTURE' or (scope = 'OBJECT' and obj_type = 'WAREHOUSE'))
select *, 'OK' as status from (from due intersect from act)
union all select *, 'MISSING' from (from due except from act)
union all select *, 'EXTRA' from (from act except from due)""")
def model_audit(spark, sf_dir):
    fx = lambda n: fixture(spark, sf_dir, n)
    db = access.future_grants_db(fx("future_grants_db"), fx("databases"))
    sc = access.future_grants_schema(fx("future_grants_schema"), fx("schemata"))
    wh = access.warehouse_grants(fx("grants_to_roles"))
    return model.audit(fx("privilege_model"), fx("model_objects"), db, sc, wh)
