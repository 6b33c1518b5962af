"""Access-role queries over the grant fixtures and the full role spec."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import access
from ledgerline.plans.registry import register
from ledgerline.sources import specs
from ledgerline.sources.fixtures import fixture, oracle_cte

CTE = oracle_cte("future_grants_db", "databases", "future_grants_schema", "schemata", "grants_to_roles",
                 "roles", "role_grants", "role_spec_all", "role_custom", "privilege_model")

_GRANTS_SQL = """,
dbg as (select * from future_grants_db
         where db_name in (select database_name from databases where database_owner not in ('ACCOUNTADMIN'))),
scg as (select g.db_name, g.sc_name, g.db_name || '.' || g.sc_name as db_sc, g.grantee_name, g.privilege, g.kind
          from future_grants_schema g
         where exists (select 1 from schemata s where s.catalog_name = g.db_name and s.schema_name = g.sc_name
                         and s.schema_owner not in ('ACCOUNTADMIN') and s.schema_name not like '%-%'
                         and s.schema_name not in ('INTERNAL', 'PUBLIC', 'INFORMATION_SCHEMA')
                         and s.catalog_name not in ('DEMO_DB') and s.deleted is null)),
whg as (select name as wh_name, name, granted_on, deleted_on, grantee_name, privilege from grants_to_roles
         where deleted_on is null and granted_on = 'WAREHOUSE')"""


def _resolve_sql(rule: str) -> str:
    inc = rule == "INCLUDE"
    g = lambda prefix: f" and g.grantee_name like '{prefix}%_' || s.role_type || '_AR'" if inc else ""
    return f"""
select s.role_name, 'AR' as kind, g.grantee_name as granted_name from role_spec_all s join dbg g
    on g.db_name like s.db_pattern{g('_DB_')} where s.rule = '{rule}' and s.obj_type = 'DATABASE'
union
select s.role_name, 'AR', g.grantee_name from role_spec_all s join scg g
    on g.db_name like s.db_pattern and g.sc_name like s.sc_pattern{g('_SC_')}
 where s.rule = '{rule}' and s.obj_type = 'SCHEMA'
union
select s.role_name, 'AR', g.grantee_name from role_spec_all s join whg g
    on g.wh_name like s.wh_pattern{g('_WH_')} where s.rule = '{rule}' and s.obj_type = 'WAREHOUSE'
union
select s.role_name, 'FR', r.name from role_spec_all s join roles r on r.name like s.role_pattern
 where r.deleted_on is null and s.rule = '{rule}' and s.obj_type = 'ROLE'"""


def _custom_sql(rule: str) -> str:
    return f"""
select role_name, case when regexp_matches(role_ref, '_AR$') then 'AR' else 'FR' end as kind, role_ref as granted_name
  from role_custom where rule = 'CUSTOM_{rule}' and (regexp_matches(role_ref, '_AR$') or regexp_matches(role_ref, '_FR$'))"""


_SETS_SQL = CTE + _GRANTS_SQL + f""",
inc as ({_resolve_sql('INCLUDE')} union {_custom_sql('INCLUDE')}),
exc as ({_resolve_sql('EXCLUDE')} union {_custom_sql('EXCLUDE')}),
want as (select * from inc except select * from exc),
spec_roles as (select role_name from role_spec_all union select role_name from role_custom),
have as (
  select role_name, 'AR' as kind, granted_name from role_grants
   where privilege = 'USAGE' and regexp_matches(granted_name, '_(\\w{{2,3}})_AR$')
     and role_name in (select role_name from spec_roles)
  union
  select role_name, 'FR', granted_name from role_grants
   where privilege = 'USAGE' and regexp_matches(granted_name, '_FR$')
     and role_name in (select role_name from spec_roles))"""


def _inputs(spark, sf_dir):
    fx = lambda n: fixture(spark, sf_dir, n)
    db = access.future_grants_db(fx("future_grants_db"), fx("databases"))
    sc = access.future_grants_schema(fx("future_grants_schema"), fx("schemata"))
    wh = access.warehouse_grants(fx("grants_to_roles"))
    return dict(db_grants=db, sc_grants=sc, wh_grants=wh, roles=fx("roles"),
                role_grants=fx("role_grants"), spec=fx("role_spec_all"), custom=fx("role_custom"))


@register("future_grants_db", CTE + _GRANTS_SQL + "\nselect * from dbg")
def future_grants_db(spark, sf_dir):
    return _inputs(spark, sf_dir)["db_grants"]


@register("future_grants_schema", CTE + _GRANTS_SQL + "\nselect * from scg")
def future_grants_schema(spark, sf_dir):
    return _inputs(spark, sf_dir)["sc_grants"].select("db_name", "sc_name", "db_sc", "grantee_name", "privilege", "kind")


@register("warehouse_grants", CTE + _GRANTS_SQL + "\nselect * from whg")
def warehouse_grants(spark, sf_dir):
    return _inputs(spark, sf_dir)["wh_grants"]


@register("grants_swapped", CTE + _GRANTS_SQL + "\nselect *, 2::bigint as versions_kept from whg")
def grants_swapped(spark, sf_dir):
    """K6 for A3: the grant table built aside and swapped in three times, the last
    build read back through its name; a writer that was overtaken changes nothing."""
    import uuid

    from ledgerline.sources.commits import Conflict
    from ledgerline.sources.sinks import Swap

    name = f"allgrantswh_{uuid.uuid4().hex[:12]}"
    grants = _inputs(spark, sf_dir)["wh_grants"]
    swap, late = Swap(spark, name, keep=2), Swap(spark, name, keep=2)
    stale = late.begin()
    for build in (grants.limit(0), grants.where("wh_name is null"), grants):
        swap.finish(build)
    try:
        late.finish(grants.limit(0), stale)
    except Conflict:
        pass
    return spark.table(name).withColumn("versions_kept", F.lit(len(swap.versions())).cast("bigint"))


def _resolve(spark, sf_dir, rule):
    i = _inputs(spark, sf_dir)
    return access.resolve_rules(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"], rule)


@register("role_include", CTE + _GRANTS_SQL + _resolve_sql("INCLUDE"))
def role_include(spark, sf_dir):
    return _resolve(spark, sf_dir, "INCLUDE")


@register("role_exclude", CTE + _GRANTS_SQL + _resolve_sql("EXCLUDE"))
def role_exclude(spark, sf_dir):
    return _resolve(spark, sf_dir, "EXCLUDE")


@register("role_custom_lists", CTE + "\nselect 'INCLUDE' as rule, * from (" + _custom_sql("INCLUDE")
          + ") union all select 'EXCLUDE', * from (" + _custom_sql("EXCLUDE") + ")")
def role_custom_lists(spark, sf_dir):
    c = _inputs(spark, sf_dir)["custom"]
    return (access.custom_rules(c, "INCLUDE").select(F.lit("INCLUDE").alias("rule"), "*")
            .unionByName(access.custom_rules(c, "EXCLUDE").select(F.lit("EXCLUDE").alias("rule"), "*")))


@register("role_wanted", _SETS_SQL + "\nselect * from want")
def role_wanted(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.wanted(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"], i["custom"])


@register("role_existing", _SETS_SQL + "\nselect * from have")
def role_existing(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.existing(i["role_grants"], access.spec_roles(i["spec"], i["custom"])).distinct()


@register("role_unclassified", CTE + "\nselect * from role_grants where privilege not in ('OWNERSHIP', 'USAGE')")
def role_unclassified(spark, sf_dir):
    return access.unclassified(_inputs(spark, sf_dir)["role_grants"])


_MISSING_SQL = """
select role_name, 'CREATE' as action, cast(null as varchar) as kind, cast(null as varchar) as granted_name
  from spec_roles where role_name not in (select role_name from role_grants)"""


@register("role_missing", _SETS_SQL + _MISSING_SQL)
def role_missing(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.missing_roles(access.spec_roles(i["spec"], i["custom"]), i["role_grants"])


@register("role_delta", _SETS_SQL + """
select role_name, 'GRANT' as action, kind, granted_name from (select * from want except select * from have)
union all
select role_name, 'REVOKE', kind, granted_name from (select * from have except select * from want)
union all""" + _MISSING_SQL)
def role_delta(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.role_delta(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"],
                             i["role_grants"], i["custom"])


_HELD_AR = """,
held as (select distinct role_name, granted_name from role_grants
          where privilege = 'USAGE' and regexp_matches(granted_name, '_(\\w{2,3})_AR$'))"""


_REVERSE_BODY = """
select distinct h.role_name, 'WAREHOUSE' as obj_type, cast(null as varchar) as db_name, cast(null as varchar) as sc_name,
       w.wh_name, regexp_extract(h.granted_name, '_(\\w{2,3})_AR$', 1) as role
  from held h join whg w on h.granted_name = w.grantee_name
union
select h.role_name, 'SCHEMA', c.db_name, c.sc_name, null, regexp_extract(h.granted_name, '_(\\w{2,3})_AR$', 1)
  from held h join scg c on h.granted_name = c.grantee_name
union
select h.role_name, 'DATABASE', d.db_name, null, null, regexp_extract(h.granted_name, '_(\\w{2,3})_AR$', 1)
  from held h join dbg d on h.granted_name = d.grantee_name
union
select role_name, 'ROLE', null, null, null, granted_name from role_grants
 where privilege = 'USAGE' and regexp_matches(granted_name, '_FR$')"""


@register("role_spec_reverse", CTE + _GRANTS_SQL + _HELD_AR + "\n" + _REVERSE_BODY)
def role_spec_reverse(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.reverse_spec(i["role_grants"], i["db_grants"], i["sc_grants"], i["wh_grants"])


_CUSTOM_BODY = """
select distinct role_name, granted_name from held
 where granted_name not in (select grantee_name from dbg union select grantee_name from scg
                            union select grantee_name from whg)"""


@register("role_spec_custom", CTE + _GRANTS_SQL + _HELD_AR + "\n" + _CUSTOM_BODY)
def role_spec_custom(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.reverse_custom(i["role_grants"], i["db_grants"], i["sc_grants"], i["wh_grants"])


@register("role_spec_json", CTE + _GRANTS_SQL + _HELD_AR + """,
rules as (""" + _REVERSE_BODY + """),
cust as (""" + _CUSTOM_BODY + """),
inc as (
  select role_name,
         '[' || string_agg(j, ',' order by obj_type, db_name nulls first, sc_name nulls first,
                                        wh_name nulls first, role nulls first) || ']' as inc
    from (select distinct role_name, obj_type, db_name, sc_name, wh_name, role,
                 '{"TYPE":"' || obj_type || '"' || coalesce(',"DATABASE":"' || db_name || '"', '')
                 || coalesce(',"SCHEMA":"' || sc_name || '"', '') || coalesce(',"WAREHOUSE":"' || wh_name || '"', '')
                 || coalesce(',"ROLE":"' || role || '"', '') || '}' as j
            from rules)
   group by role_name),
cus as (
  select role_name, '[' || string_agg('"' || granted_name || '"', ',' order by granted_name) || ']' as cus
    from (select distinct role_name, granted_name from cust) group by role_name)
select coalesce(i.role_name, c.role_name) as role_name,
       '{"ORDER":"INCEXC","INCLUDE":' || coalesce(i.inc, '[]') || ',"EXCLUDE":[],"CUSTOM_INCLUDE":'
       || coalesce(c.cus, '[]') || ',"CUSTOM_EXCLUDE":[],"SCIM_ROLES":[]}' as spec_json
  from inc i full outer join cus c on i.role_name = c.role_name""")
def role_spec_json(spark, sf_dir):
    """Generated spec document per role (JSON text)."""
    i = _inputs(spark, sf_dir)
    rules = access.reverse_spec(i["role_grants"], i["db_grants"], i["sc_grants"], i["wh_grants"])
    custom = access.reverse_custom(i["role_grants"], i["db_grants"], i["sc_grants"], i["wh_grants"])
    return access.assemble_spec(rules, custom)


@register("role_spec_lint", CTE + """,
lv as (select distinct obj_type as h_type, role as h_role from privilege_model),
s as (select * from role_spec_all left join lv on obj_type = h_type and role_type = h_role),
v as (
  select *, 'invalid TYPE' as violation from s where obj_type is null or obj_type not in ('DATABASE', 'SCHEMA', 'WAREHOUSE')
  union all select *, 'missing ROLE' from s where rule = 'INCLUDE' and role_type is null
  union all select *, 'ROLE not in hierarchy' from s
   where rule = 'INCLUDE' and obj_type in ('DATABASE', 'SCHEMA', 'WAREHOUSE') and role_type is not null and h_role is null
  union all select *, 'missing DATABASE' from s where obj_type in ('DATABASE', 'SCHEMA') and db_pattern is null
  union all select *, 'missing SCHEMA' from s where obj_type = 'SCHEMA' and sc_pattern is null
  union all select *, 'missing WAREHOUSE' from s where obj_type = 'WAREHOUSE' and wh_pattern is null)
select role_name, rule, obj_type, db_pattern, sc_pattern, wh_pattern, role_type, violation from v""")
def role_spec_lint(spark, sf_dir):
    i = _inputs(spark, sf_dir)
    return access.lint_spec(i["spec"], fixture(spark, sf_dir, "privilege_model"))


@register("role_functional", oracle_cte("roles") + "\nselect name, deleted_on from roles where name like '%_FR'")
def role_functional(spark, sf_dir):
    return access.functional_roles(fixture(spark, sf_dir, "roles"))


@register("role_spec_overlay", oracle_cte("spec_documents") + """,
of_role as (select *, 'TEAM_' || (seq % 100)::varchar || '_FR' as role_name from spec_documents),
latest as (select role_name, max(seq) as seq from of_role group by role_name)
select role_name, 'INCLUDE' as rule, 'SCHEMA' as obj_type, json_extract_string(doc, '$.' || role_name || '.INCLUDE[0].DATABASE') as db_pattern,
       'SC_' || seq::varchar as sc_pattern, 'VEW' as role_type
  from latest join of_role using (role_name, seq)""")
def role_spec_overlay(spark, sf_dir):
    """Role-spec documents laid over each other, the last one of a role wins."""
    rules, _ = specs.role_spec_rows(fixture(spark, sf_dir, "spec_documents"))
    return rules.select("role_name", "rule", "obj_type", "db_pattern", "sc_pattern", "role_type")


@register("role_spec_document_lint", oracle_cte("spec_documents_faulty") + """,
r as (select seq, 'U_' || seq::varchar || '_FR' as role_name from spec_documents_faulty)
select role_name, 'missing ORDER' as violation from r where seq % 2 = 1
union all select role_name, 'INCLUDE is not a list' from r where seq % 3 = 1
union all select role_name, 'INCLUDE holds an entry that is no object' from r where seq % 3 = 0""")
def role_spec_document_lint(spark, sf_dir):
    """A21 over whole documents."""
    return access.lint_spec_documents(fixture(spark, sf_dir, "spec_documents_faulty"))


# A role per customer and a rule per role, wild at both ends and in the middle.
_INFIX = """with named as (
  select c_name as name, '%' || substr(c_name, 12, 3) || '_' || substr(c_name, 16, 3) || '%' as pattern from {customer})"""


@register("role_infix_rules", _INFIX.format(customer="customer") + """
select r.name as role_name, 'FR' as kind, n.name as granted_name from named r join named n on n.name like r.pattern""")
def role_infix_rules(spark, sf_dir):
    """A4, A5: as many infix patterns as names, resolved through the gram index."""
    from ledgerline.sources.tables import read_table

    named = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat(
        F.lit("%"), F.substring("c_name", 12, 3), F.lit("_"), F.substring("c_name", 16, 3), F.lit("%")).alias("pattern"))
    none = F.lit(None).cast("string")
    spec = named.select(F.col("name").alias("role_name"), F.lit("INCLUDE").alias("rule"), F.lit("ROLE").alias("obj_type"),
                        none.alias("db_pattern"), none.alias("sc_pattern"), none.alias("wh_pattern"),
                        F.col("pattern").alias("role_pattern"), none.alias("role_type"))
    i = _inputs(spark, sf_dir)
    roles = named.select("name", F.lit(None).cast("timestamp").alias("deleted_on"))
    return access.resolve_rules(spec, i["db_grants"], i["sc_grants"], i["wh_grants"], roles, "INCLUDE")
