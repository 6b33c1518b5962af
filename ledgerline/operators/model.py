"""Privilege-model expansion: roles, edges and grants per object, as rows.

``model`` rows: (obj_type, ar_prefix, role_owner, pos, role, privilege, kind) —
the role hierarchy (``pos`` 0 = highest) crossed with each level's permissions;
a NULL ``kind`` marks a level without direct privileges; ``role_owner`` owns the
objects and roles of its type. ``objects`` rows: (obj_type, db_nm, sc_nm) with
obj_type DATABASE / SCHEMA / WAREHOUSE (a warehouse's name sits in ``db_nm``).

Every output is made in two steps: the model alone is turned into *templates*,
one row per thing that exists for every object of a type; objects, which is
what grows, then meet all templates of their type in one join, and names are
filled in by expressions. Templates, a few for each line of the model, go to every
task: dealt by type, nearly all objects (schemas) would meet in one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plural object kinds of schema privileges → singular kind of
# the matching CREATE privilege.
SINGULAR_KIND = {
    "TABLES": "TABLE",
    "EXTERNAL TABLES": "TABLE",
    "VIEWS": "VIEW",
    "MATERIALIZED VIEWS": "VIEW",
    "FILE FORMATS": "FILE FORMAT",
    "STAGES": "STAGE",
    "STREAMS": "STREAM",
    "SEQUENCES": "SEQUENCE",
    "FUNCTIONS": "FUNCTION",
    "PROCEDURES": "PROCEDURE",
    "TASKS": "TASK",
}
# An object is dropped after all of its roles (sorts after any level).
OBJECT_DROP_POS = 1_000_000

# Columns of a template; the ones a kind of template does not use are NULL.
TEMPLATE = {"what": "string", "obj_type": "string", "ar_prefix": "string", "role_owner": "string", "pos": "int",
            "level": "string", "privilege": "string", "kind": "string", "scope": "string", "other_prefix": "string",
            "other_level": "string"}


def object_name(obj_type: Column, db: Column, sc: Column) -> Column:
    """DATABASE → db, SCHEMA → db.sc, WAREHOUSE → name."""
    return F.when(obj_type == "SCHEMA", F.concat(db, F.lit("."), sc)).otherwise(db)


def _role_name(prefix: Column, obj_type: Column, db: Column, sc: Column, level: Column) -> Column:
    """prefix + db[_sc] + _level + _AR."""
    base = F.when(obj_type == "SCHEMA", F.concat(db, F.lit("_"), sc)).otherwise(db)
    return F.concat(prefix, base, F.lit("_"), level, F.lit("_AR"))


def _template(df: DataFrame, what: str, **columns) -> DataFrame:
    given = {"what": F.lit(what), **columns}
    return df.select(*[(given[n] if n in given else F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
                       for n, t in TEMPLATE.items()])


def levels(model: DataFrame) -> DataFrame:
    return model.select("obj_type", "ar_prefix", "role_owner", F.col("pos").cast("int").alias("pos"),
                        F.col("role").alias("level")).distinct()


def role_templates(model: DataFrame) -> DataFrame:
    """A role per level."""
    return _template(levels(model), "ROLE")


def edge_templates(model: DataFrame) -> DataFrame:
    """Each level is granted to the next higher one, the top one to the
    type's owner. P3: each schema role to the database role of its level."""
    lv = levels(model)
    higher = lv.select("obj_type", (F.col("pos") + 1).alias("pos"), F.col("level").alias("higher"))
    up = lv.join(higher, ["obj_type", "pos"], "left")
    hierarchy = _template(up, "EDGE", scope=F.lit("HIERARCHY"), other_prefix=F.when(
        F.col("higher").isNotNull(), F.col("ar_prefix")), other_level=F.col("higher"))
    db = lv.where("obj_type = 'DATABASE'").select(F.col("ar_prefix").alias("db_prefix"), "level")
    across = lv.where("obj_type = 'SCHEMA'").join(db, "level")
    return hierarchy.unionByName(_template(across, "EDGE", scope=F.lit("SCHEMA_TO_DATABASE"),
                                           other_prefix=F.col("db_prefix"), other_level=F.col("level")))


def privilege_templates(model: DataFrame) -> DataFrame:
    """P4 + P5 + P7. Scope OBJECT: on the object itself (database / warehouse
    kinds); ALL and FUTURE: on all existing / future objects of ``kind`` inside a
    database or schema (a SCHEMA kind at database level is not supported and
    yields nothing, as in the reference); BASE: USAGE on the database and the
    schema for the lowest schema level."""
    named = model.where(F.col("kind").isNotNull()).withColumn("level", F.col("role"))
    itself = ((F.col("obj_type") == "DATABASE") & (F.col("kind") == "DATABASE")) | (F.col("obj_type") == "WAREHOUSE")
    inside = ((F.col("obj_type") == "DATABASE") & ~F.col("kind").isin("DATABASE", "SCHEMA")) | (F.col("obj_type") == "SCHEMA")
    scopes = F.when(itself, F.array(F.lit("OBJECT"))).when(inside, F.array(F.lit("ALL"), F.lit("FUTURE")))
    direct = named.withColumn("scope", F.explode(scopes))
    schema_levels = levels(model).where("obj_type = 'SCHEMA'")
    lowest = schema_levels.agg(F.max(F.struct("pos", "level", "ar_prefix", "role_owner")).alias("x")).where("x is not null")
    base = lowest.select("x.*", F.lit("SCHEMA").alias("obj_type"),
                         F.explode(F.array(F.lit("DATABASE"), F.lit("SCHEMA"))).alias("kind"))
    return _template(direct, "PRIVILEGE").unionByName(
        _template(base, "PRIVILEGE", privilege=F.lit("USAGE"), scope=F.lit("BASE")))


def create_templates(model: DataFrame) -> DataFrame:
    """CREATE <singular kind> on each schema, once per kind, for the lowest
    level whose ALL privilege covers that kind."""
    kinds = F.create_map(*[x for k, v in SINGULAR_KIND.items() for x in (F.lit(k), F.lit(v))])
    every = (model.where((F.col("obj_type") == "SCHEMA") & (F.col("privilege") == "ALL") & F.col("kind").isNotNull())
             .withColumn("create_kind", F.try_element_at(kinds, F.col("kind"))).where("create_kind is not null"))
    lowest = every.groupBy("create_kind").agg(F.max(F.struct(
        F.col("pos").cast("int").alias("pos"), F.col("role").alias("level"), "ar_prefix", "role_owner", "obj_type")).alias("x"))
    return _template(lowest.select("create_kind", "x.*"), "CREATE", scope=F.lit("CREATE"),
                     privilege=F.concat(F.lit("CREATE "), F.col("create_kind")), kind=F.col("create_kind"))


def owner_templates(model: DataFrame) -> DataFrame:
    """One row per object type, with its owner."""
    return _template(model.select("obj_type", "role_owner").distinct(), "OBJECT")


def expand(objects: DataFrame, *templates: DataFrame) -> DataFrame:
    """All objects with all templates of their type, names filled in."""
    every = reduce(lambda a, b: a.unionByName(b), templates)
    t, db, sc = F.col("obj_type"), F.col("db_nm"), F.col("sc_nm")
    other = (F.when(F.col("what") != "EDGE", F.lit(None))
             .when(F.col("other_level").isNull(), F.col("role_owner"))
             .when(F.col("scope") == "SCHEMA_TO_DATABASE",
                   F.concat("other_prefix", db, F.lit("_"), "other_level", F.lit("_AR")))
             .otherwise(_role_name(F.col("other_prefix"), t, db, sc, F.col("other_level"))))
    whole = object_name(t, db, sc)
    # Base usage of a schema's lowest role also covers the schema's database.
    target = F.when((F.col("scope") == "BASE") & (F.col("kind") == "DATABASE"), db).otherwise(whole)
    return objects.select("obj_type", "db_nm", "sc_nm").join(F.broadcast(every), "obj_type").select(
        "what", "obj_type", "db_nm", "sc_nm", target.alias("object_name"), "pos", "level", "privilege", "kind", "scope",
        "role_owner", _role_name(F.col("ar_prefix"), t, db, sc, F.col("level")).alias("role_name"),
        other.alias("grantee_role"))


def roles(model: DataFrame, objects: DataFrame) -> DataFrame:
    """One access role per object and hierarchy level."""
    return expand(objects, role_templates(model)).select(
        "obj_type", "db_nm", "sc_nm", "object_name", "pos", "level", "role_name")


def edges(model: DataFrame, objects: DataFrame) -> DataFrame:
    """P2 + P3: role-to-role grants."""
    return expand(objects, edge_templates(model)).select(
        "obj_type", "object_name", F.col("role_name").alias("granted_role"), "grantee_role", F.col("scope").alias("edge"))


def privileges(model: DataFrame, objects: DataFrame) -> DataFrame:
    """P4 + P5 + P7: object privileges per role."""
    return expand(objects, privilege_templates(model)).select(
        "obj_type", "object_name", "role_name", "privilege", "kind", "scope")


def create_privileges(model: DataFrame, objects: DataFrame) -> DataFrame:
    """P6."""
    return expand(objects, create_templates(model)).select(
        "obj_type", "object_name", "role_name", "privilege", F.col("kind").alias("create_kind"))


def ownership(model: DataFrame, objects: DataFrame) -> DataFrame:
    """The type's owner owns every object and every access role, and holds
    ALL PRIVILEGES on each object."""
    x = expand(objects, owner_templates(model), role_templates(model))
    is_role = F.col("what") == "ROLE"
    held = F.when(is_role, F.array(F.lit("OWNERSHIP"))).otherwise(F.array(F.lit("OWNERSHIP"), F.lit("ALL PRIVILEGES")))
    return x.select(F.when(is_role, F.lit("ROLE")).otherwise(F.col("obj_type")).alias("target_type"),
                    F.when(is_role, F.col("role_name")).otherwise(F.col("object_name")).alias("target"),
                    F.explode(held).alias("privilege"), F.col("role_owner").alias("owner"))


def reverse_plan(model: DataFrame, objects: DataFrame) -> DataFrame:
    """What dropping the objects undoes. Ordered by ``(phase, pos)``:
    phase 1 revokes object privileges, phase 2 revokes role edges, phase 3
    drops the roles and then the object; within a phase the highest level
    (``pos`` 0) goes first — the creation order reversed."""
    x = expand(objects, privilege_templates(model), create_templates(model), edge_templates(model),
               role_templates(model), owner_templates(model))
    what = F.col("what")
    phase = F.when(what.isin("PRIVILEGE", "CREATE"), 1).when(what == "EDGE", 2).otherwise(3)
    action = (F.when(phase == 1, "REVOKE").when(phase == 2, "REVOKE ROLE").when(what == "ROLE", "DROP ROLE")
              .otherwise(F.concat(F.lit("DROP "), F.col("obj_type"))))
    return x.select(
        phase.alias("phase"), F.coalesce("pos", F.lit(OBJECT_DROP_POS)).alias("pos"), action.alias("action"), "role_name",
        "privilege", F.when(what == "PRIVILEGE", F.col("kind")).alias("kind"), "scope", "object_name",
        F.col("grantee_role").alias("from_role"))


def audit(model: DataFrame, objects: DataFrame, db_grants: DataFrame, sc_grants: DataFrame,
          wh_grants: DataFrame) -> DataFrame:
    """P10: the grants the model asks for against the materialised ones, privilege
    by privilege: OK, MISSING (model only) or EXTRA (grants only).

    Future grants of databases and schemas, direct grants of warehouses. A wrong
    privilege on an existing role shows as one MISSING and one EXTRA row.

    Both sides meet in one grouping. Rows are exchanged before any is counted: a task
    that reads many objects would otherwise hold all of their privileges at once.
    """
    keys = ["obj_type", "object_name", "role_name", "privilege", "kind"]
    due = privileges(model, objects).where(
        "scope = 'FUTURE' or (scope = 'OBJECT' and obj_type = 'WAREHOUSE')").select(*keys)

    def held(grants: DataFrame, obj_type: str, name: Column, kind: Column) -> DataFrame:
        return grants.select(F.lit(obj_type).alias("obj_type"), name.alias("object_name"),
                             F.col("grantee_name").alias("role_name"), "privilege", kind.alias("kind"))

    there = (held(db_grants, "DATABASE", F.col("db_name"), F.col("kind"))
             .unionByName(held(sc_grants, "SCHEMA", F.concat_ws(".", "db_name", "sc_name"), F.col("kind")))
             .unionByName(held(wh_grants, "WAREHOUSE", F.col("wh_name"), F.lit("WAREHOUSE"))))
    yes, no = F.lit(True), F.lit(False)
    every = due.withColumns({"_due": yes, "_held": no}).unionByName(there.withColumns({"_due": no, "_held": yes}))
    both = every.repartition(*keys).groupBy(*keys).agg(F.bool_or("_due").alias("_due"), F.bool_or("_held").alias("_held"))
    return both.select(*keys, F.when(F.col("_due") & F.col("_held"), F.lit("OK"))
                       .when(F.col("_due"), F.lit("MISSING")).otherwise(F.lit("EXTRA")).alias("status"))
