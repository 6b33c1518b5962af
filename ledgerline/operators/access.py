"""Access-role analytics: resolve pattern-based role specs against grants.

Inputs (one row per grant / role / rule):

* ``db_grants(db_name, grantee_name)`` — future grants per database;
* ``sc_grants(db_name, sc_name, db_sc, grantee_name)`` — future grants per schema;
* ``wh_grants(wh_name, grantee_name)`` — warehouse grants;
* ``roles(name, deleted_on)`` — the account's roles;
* ``role_grants(role_name, privilege, granted_name)`` — what each role holds now;
* ``spec(role_name, rule, obj_type, db_pattern, sc_pattern, wh_pattern,
  role_pattern, role_type)`` — one row per INCLUDE / EXCLUDE rule;
* ``custom(role_name, rule, role_ref)`` — CUSTOM_INCLUDE / CUSTOM_EXCLUDE entries.

Patterns are SQL LIKE patterns (``_`` is a wildcard too, also inside the
``_SC_`` prefix). They are resolved against the distinct object names by one
equi-join. Between its ``%`` a pattern has segments of fixed width; a segment's
*shape* is where it is anchored and which of its places are holes (``_``). Names
are cut to the shapes that the patterns ask for, with the same holes, so that a
name meets a pattern only where all literal places of a segment agree, and LIKE
runs on what meets. Of several segments the rarest is used. Beyond SHAPES shapes,
the rest is looked up by the rarest of its literal beginning, its literal end and
the grams (up to three characters) of its literal pieces. Includes and excludes of
all object kinds go through the same join; only a pattern without any literal,
which nearly every name matches, meets all names, dealt over salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Access-role prefixes and the suffix patterns of role names.
AR_PREFIX = {"DATABASE": "_DB_", "SCHEMA": "_SC_", "WAREHOUSE": "_WH_"}
AR_SUFFIX = r"_(\w{2,3})_AR$"
FR_SUFFIX = r"_FR$"

# Places of a segment that are used for the lookup.
LOOKUP = 32
SHAPES = 64  # shapes that names are cut to, the most asked for
GRAM = 3  # longest gram of the index for patterns of other shapes
ANY_SALTS = 32  # names are dealt over so many for patterns without a literal


# --- A1-A3: materialised grant tables ---------------------------------------
def future_grants_db(raw: DataFrame, databases: DataFrame) -> DataFrame:
    """A1: future grants of databases not owned by ACCOUNTADMIN."""
    keep = databases.filter(~F.col("database_owner").isin("ACCOUNTADMIN")).select(
        F.col("database_name").alias("db_name"))
    return raw.join(keep, "db_name", "left_semi")


def grant_schemas(schemata: DataFrame) -> DataFrame:
    """Schemas whose future grants are materialised."""
    return schemata.filter(
        ~F.col("schema_owner").isin("ACCOUNTADMIN")
        & ~F.col("schema_name").like("%-%")
        & ~F.col("schema_name").isin("INTERNAL", "PUBLIC", "INFORMATION_SCHEMA")
        & ~F.col("catalog_name").isin("DEMO_DB")
        & F.col("deleted").isNull())


def future_grants_schema(raw: DataFrame, schemata: DataFrame) -> DataFrame:
    """A2: future grants of the S12 schemas, tagged ``db_sc``."""
    keep = grant_schemas(schemata).select(F.col("catalog_name").alias("db_name"),
                                          F.col("schema_name").alias("sc_name"))
    return (raw.join(keep, ["db_name", "sc_name"], "left_semi")
            .withColumn("db_sc", F.concat_ws(".", "db_name", "sc_name")))


def warehouse_grants(grants_to_roles: DataFrame) -> DataFrame:
    """Live warehouse grants, name copied to ``wh_name``."""
    return (grants_to_roles
            .filter(F.col("deleted_on").isNull() & (F.col("granted_on") == "WAREHOUSE"))
            .select(F.col("name").alias("wh_name"), "*"))


def live_roles(roles: DataFrame) -> DataFrame:
    """S13."""
    return roles.filter(F.col("deleted_on").isNull())


def functional_roles(roles: DataFrame) -> DataFrame:
    """Every functional role (name LIKE '%_FR'); the literal ALL, which
    callers use to ask for this list, is never part of it."""
    return roles.filter(F.col("name").like("%_FR") & (F.col("name") != "ALL")).select("name", "deleted_on")


# --- A4-A7: resolve rules to granted names ------------------------------------
SEGMENT = "struct<kind: string, at: int, size: int, body: string>"


def _segment(kind: Column, at: Column, size: Column, body: Column) -> Column:
    return F.struct(kind.alias("kind"), at.cast("int").alias("at"), size.cast("int").alias("size"), body.alias("body"))


def segments(pattern: Column) -> Column:
    """What a LIKE pattern can be looked up by, one entry per segment with a literal.

    kind: ``=`` the whole name (of ``size`` characters), ``<`` its beginning, ``>``
    its end, ``~`` anywhere, ``!`` a pattern without a wildcard, ``*`` one without a
    literal (or with an escape, left to LIKE). body: the segment from its first to
    its last literal, at most LOOKUP characters, ``at`` characters from its anchor."""
    parts, mark, none = F.split(pattern, "%"), F.lit("_"), F.lit(0)

    def segment(part: Column, i: Column) -> Column:
        kind = (F.when(F.size(parts) == 1, "=").when(i == 0, "<").when(i == F.size(parts) - 1, ">").otherwise("~"))
        lead, trail = F.ltrim(part, mark), F.rtrim(part, mark)
        body = F.when(kind == ">", F.ltrim(F.right(trail, F.lit(LOOKUP)), mark)).otherwise(
            F.rtrim(F.left(lead, F.lit(LOOKUP)), mark))
        at = F.when(kind == "~", none).otherwise(F.length(part) - F.length(F.when(kind == ">", trail).otherwise(lead)))
        return _segment(kind, at, F.when(kind == "=", F.length(part)).otherwise(none), body)

    every = F.filter(F.transform(parts, segment), lambda s: s["body"] != "")
    return (F.when(~pattern.rlike(r"[^%_]") & (pattern != "") | pattern.contains("\\"),
                   F.array(_segment(F.lit("*"), none, none, F.lit(""))))
            .when(~pattern.rlike("[%_]"), F.array(_segment(F.lit("!"), none, none, pattern)))
            .otherwise(every).cast(f"array<{SEGMENT}>"))


def shape(segment: Column) -> Column:
    """A segment's kind, place, width and holes, as one text."""
    holes = F.when(segment["kind"] == "!", F.lit("")).otherwise(F.regexp_replace(segment["body"], "[^_]", "x"))
    return F.concat_ws(" ", segment["kind"], segment["at"].cast("string"), segment["size"].cast("string"), holes)


def pattern_token(pattern: Column) -> Column:
    """The first lookup key of a pattern: a shape and a text, or ``*``."""
    first = segments(pattern)[0]
    return F.when(first["kind"] == "*", F.lit("*")).otherwise(F.concat_ws(" ", shape(first), first["body"]))


def rest_segments(pattern: Column) -> Column:
    """The lookup of patterns whose own shapes are not kept: their literal beginning
    and end, and the grams of their literal pieces."""
    start = F.left(F.regexp_extract(pattern, r"\A([^%_]*)", 1), F.lit(LOOKUP))
    end = F.right(F.regexp_extract(pattern, r"([^%_]*)\z", 1), F.lit(LOOKUP))
    none = F.lit(0)
    entry = lambda kind: lambda body: _segment(F.lit(kind), none, none, body)
    every = F.concat(F.array(entry("<")(start), entry(">")(end)), F.transform(literal_grams(pattern), entry("~")))
    return F.filter(every, lambda s: s["body"] != "")


# The shapes of rest_segments, and the two that need no cutting.
REST_SHAPES = [*[f"{kind} 0 0 {'x' * n}" for kind, longest in (("<", LOOKUP), (">", LOOKUP), ("~", GRAM))
                 for n in range(1, longest + 1)], "! 0 0 ", "* 0 0 "]


def name_texts(name: Column, shapes: list[str]) -> Column:
    """``name`` cut to every shape that fits: an array of (place of the shape in
    ``shapes``, text)."""
    def spelt(i: int, text: str) -> Column:
        kind, at, size, holes = text.split(" ")
        return F.struct(F.lit(i).alias("shape"), F.lit(kind).alias("kind"), F.lit(int(at)).alias("at"),
                        F.lit(int(size)).alias("size"), F.lit(len(holes)).alias("width"),
                        F.array(*[F.lit(n + 1) for n, c in enumerate(holes) if c == "_"]).cast("array<int>").alias("holes"))

    def cut(s: Column) -> Column:
        last = F.length(name) - s["width"] + 1
        starts = (F.when(s["kind"] == "~", F.sequence(F.lit(1), last)).when(s["kind"] == ">", F.array(last - s["at"]))
                  .otherwise(F.array(s["at"] + 1)))
        texts = F.transform(starts, lambda p: F.aggregate(
            s["holes"], F.substr(name, p, s["width"]), lambda text, hole: F.overlay(text, F.lit("_"), hole, F.lit(1))))
        salt = F.pmod(F.xxhash64(name), F.lit(ANY_SALTS)).cast("string")
        whole = F.when(s["kind"] == "!", F.array(name)).when(s["kind"] == "*", F.array(salt))
        return F.transform(whole.otherwise(F.array_distinct(texts)), lambda t: F.struct(s["shape"].alias("shape"), t.alias("text")))

    fits = F.filter(F.array(*[spelt(i, text) for i, text in enumerate(shapes)]), lambda s: F.when(
        s["kind"] == "=", F.length(name) == s["size"]).otherwise(F.length(name) >= s["at"] + s["width"]))
    return F.flatten(F.transform(fits, cut))


def grams(text: Column, size: Column) -> Column:
    """Every run of ``size`` characters of ``text``."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, size))


def literal_grams(pattern: Column) -> Column:
    """The grams that every name matching ``pattern`` holds: of its literal pieces, as
    long as the longest piece allows, at most GRAM."""
    pieces = F.filter(F.split(pattern, "[%_]+"), lambda x: x != "")
    size = F.least(F.array_max(F.transform(pieces, lambda x: F.length(x))), F.lit(GRAM))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda x: grams(x, size))))


def meetings(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(obj_type, pattern, name) that LIKE has to look at, each pair once: all that
    match, and those that agree in the segment the pattern is looked up by. Which
    shapes the patterns have is asked first. Neither side is ever broadcast: their
    sizes before the names are cut say nothing about them."""
    asked = patterns.withColumn("segments", segments(F.col("pattern")))
    seen = (asked.select(F.size("segments").alias("n"), F.explode("segments").alias("s"))
            .groupBy(shape(F.col("s")).alias("shape")).agg(F.count(F.lit(1)).alias("patterns"), F.max("n").alias("n"))
            .orderBy(F.desc("patterns"), "shape").limit(SHAPES + 1).collect())
    shapes, more = [r["shape"] for r in seen[:SHAPES]], len(seen) > SHAPES
    if more:
        shapes += [x for x in REST_SHAPES if x not in shapes]
    if not shapes:
        return patterns.join(names.limit(0), "obj_type")
    place = F.create_map(*[x for i, text in enumerate(shapes) for x in (F.lit(text), F.lit(i))])
    keys = lambda found: F.filter(F.transform(found, lambda s: F.struct(
        F.try_element_at(place, shape(s)).alias("shape"), s["body"].alias("text"))), lambda k: k["shape"].isNotNull())
    own = keys(F.col("segments"))
    if more:
        own = F.when(F.size(own) > 0, own).otherwise(keys(rest_segments(F.col("pattern"))))
    salts = F.transform(F.sequence(F.lit(0), F.lit(ANY_SALTS - 1)), lambda i: F.struct(
        F.lit(shapes.index("* 0 0 ") if "* 0 0 " in shapes else -1).alias("shape"), i.cast("string").alias("text")))
    anything = F.col("segments")[0]["kind"] == "*"
    keyed = asked.select("obj_type", "pattern", F.explode(F.when(anything, salts).otherwise(own)).alias("k"), anything.alias("anything")
                         ).select("obj_type", "pattern", "anything", "k.*")
    by_text = names.select("obj_type", "name", F.explode(name_texts(F.col("name"), shapes)).alias("k")).select("obj_type", "name", "k.*")
    text = ["obj_type", "shape", "text"]
    if more or any(r["n"] > 1 for r in seen):
        # Of a pattern's segments, the one that the fewest names hold; the others are left out.
        holders = by_text.groupBy(*text).agg(F.count(F.lit(1)).alias("names"))
        rarest = (keyed.where("not anything").hint("merge").join(holders, text, "left").groupBy("obj_type", "pattern")
                  .agg(F.min_by(F.struct("shape", "text"), F.struct(F.coalesce("names", F.lit(0)), "shape", "text")).alias("k"))
                  .select("obj_type", "pattern", "k.*"))
        keyed = keyed.where("anything").select("obj_type", "pattern", "shape", "text").unionByName(rarest)
    return keyed.hint("merge").join(by_text, text).select("obj_type", "pattern", "name")


def matching_names(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(obj_type, pattern, name) of distinct ``patterns`` (obj_type, pattern) and
    ``names`` (obj_type, name) that match, each pair once."""
    return meetings(patterns, names).where("name like pattern")


def resolved(spec: DataFrame, db_grants: DataFrame, sc_grants: DataFrame, wh_grants: DataFrame,
             roles: DataFrame) -> DataFrame:
    """``(role_name, rule, kind, granted_name)`` matched by INCLUDE and EXCLUDE rules.

    INCLUDE also requires the grantee to be an access role of the rule's level;
    EXCLUDE does not, so it removes every level of the matched object.
    kind is AR for access roles, FR for roles matched by ROLE rules.
    """
    def things(df: DataFrame, obj_type: str, name: Column, part: Column, granted: Column) -> DataFrame:
        return df.select(F.lit(obj_type).alias("obj_type"), name.alias("name"), part.alias("part"), granted.alias("granted_name"))

    none = F.lit(None).cast("string")
    granted = reduce(lambda a, b: a.unionByName(b), [
        things(db_grants, "DATABASE", F.col("db_name"), none, F.col("grantee_name")),
        things(sc_grants, "SCHEMA", F.col("db_name"), F.col("sc_name"), F.col("grantee_name")),
        things(wh_grants, "WAREHOUSE", F.col("wh_name"), none, F.col("grantee_name")),
        things(live_roles(roles), "ROLE", F.col("name"), none, F.col("name"))]).distinct()
    of_type = (F.when(F.col("obj_type").isin("DATABASE", "SCHEMA"), F.col("db_pattern"))
               .when(F.col("obj_type") == "WAREHOUSE", F.col("wh_pattern")).when(F.col("obj_type") == "ROLE", F.col("role_pattern")))
    rules = spec.select("role_name", "rule", "obj_type", of_type.alias("pattern"), "sc_pattern", "role_type").where(
        "pattern is not null").distinct()
    matches = matching_names(rules.select("obj_type", "pattern").distinct(), granted.select("obj_type", "name").distinct())
    prefix = F.create_map(*[x for k, v in AR_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    level = F.concat(F.try_element_at(prefix, F.col("obj_type")), F.lit("%_"), "role_type", F.lit("_AR"))
    whole = (F.col("obj_type") != "SCHEMA") | F.like("part", F.col("sc_pattern"))
    due = (F.col("rule") != "INCLUDE") | (F.col("obj_type") == "ROLE") | F.like("granted_name", level)
    return (matches.hint("merge").join(granted, ["obj_type", "name"])
            .join(rules.hint("merge"), ["obj_type", "pattern"]).where(whole & due)
            .select("role_name", "rule", F.when(F.col("obj_type") == "ROLE", "FR").otherwise("AR").alias("kind"), "granted_name")
            .distinct())


def resolve_rules(spec: DataFrame, db_grants: DataFrame, sc_grants: DataFrame,
                  wh_grants: DataFrame, roles: DataFrame, rule: str) -> DataFrame:
    """``(role_name, kind, granted_name)`` matched by the INCLUDE or EXCLUDE rules."""
    return resolved(spec.where(F.col("rule") == rule), db_grants, sc_grants, wh_grants, roles).drop("rule")


def custom_rules(custom: DataFrame, rule: str) -> DataFrame:
    """CUSTOM_INCLUDE / CUSTOM_EXCLUDE names routed by suffix; others dropped."""
    c = custom.filter(F.col("rule") == f"CUSTOM_{rule}")
    kind = (F.when(F.col("role_ref").rlike("_AR$"), F.lit("AR"))
            .when(F.col("role_ref").rlike(FR_SUFFIX), F.lit("FR")))
    return (c.select("role_name", kind.alias("kind"), F.col("role_ref").alias("granted_name"))
            .filter(F.col("kind").isNotNull()))


GRANT_KEYS = ["role_name", "kind", "granted_name"]


def _flagged(spec, db_grants, sc_grants, wh_grants, roles, custom=None) -> DataFrame:
    """Rows (role_name, kind, granted_name, inc, exc) of all rules and custom lists."""
    rows = resolved(spec, db_grants, sc_grants, wh_grants, roles)
    if custom is not None:
        for rule in ("INCLUDE", "EXCLUDE"):
            rows = rows.unionByName(custom_rules(custom, rule).withColumn("rule", F.lit(rule)))
    return rows.select(*GRANT_KEYS, (F.col("rule") == "INCLUDE").alias("inc"), (F.col("rule") == "EXCLUDE").alias("exc"))


def wanted(spec, db_grants, sc_grants, wh_grants, roles, custom=None) -> DataFrame:
    """(include ∪ custom include) − (exclude ∪ custom exclude), per kind."""
    rows = _flagged(spec, db_grants, sc_grants, wh_grants, roles, custom)
    return rows.groupBy(*GRANT_KEYS).agg(F.bool_or("inc").alias("inc"), F.bool_or("exc").alias("exc")).where(
        "inc and not exc").select(*GRANT_KEYS)


def existing(role_grants: DataFrame, spec_roles: DataFrame | None = None) -> DataFrame:
    """USAGE grants of access roles (AR) and functional roles (FR)."""
    g = role_grants
    if spec_roles is not None:
        g = g.join(spec_roles, "role_name", "left_semi")
    g = g.filter((F.col("privilege") != "OWNERSHIP") & (F.col("privilege") == "USAGE"))
    ar = g.filter(F.col("granted_name").rlike(AR_SUFFIX)).select("role_name", F.lit("AR").alias("kind"), "granted_name")
    fr = g.filter(F.col("granted_name").rlike(FR_SUFFIX)).select("role_name", F.lit("FR").alias("kind"), "granted_name")
    return ar.unionByName(fr)


def unclassified(role_grants: DataFrame) -> DataFrame:
    """A10: grants that are neither OWNERSHIP nor USAGE (cannot be expressed in a spec)."""
    return role_grants.filter(~F.col("privilege").isin("OWNERSHIP", "USAGE"))


def spec_roles(spec: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    r = spec.select("role_name")
    if custom is not None:
        r = r.unionByName(custom.select("role_name"))
    return r.distinct()


def missing_roles(roles_in_spec: DataFrame, role_grants: DataFrame) -> DataFrame:
    """Spec roles holding no grants at all → CREATE."""
    return (roles_in_spec.join(role_grants.select("role_name"), "role_name", "left_anti")
            .select("role_name", F.lit("CREATE").alias("action"),
                    F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("granted_name")))


def role_delta(spec, db_grants, sc_grants, wh_grants, roles, role_grants, custom=None) -> DataFrame:
    """GRANT (wanted − existing), REVOKE (existing − wanted), CREATE (no grants).

    Rules, custom lists and present grants meet in one grouping."""
    no, sr = F.lit(False), spec_roles(spec, custom)
    due = _flagged(spec, db_grants, sc_grants, wh_grants, roles, custom).withColumn("held", no)
    have = existing(role_grants, sr).select(*GRANT_KEYS, no.alias("inc"), no.alias("exc"), F.lit(True).alias("held"))
    both = due.unionByName(have).groupBy(*GRANT_KEYS).agg(*[F.bool_or(x).alias(x) for x in ("inc", "exc", "held")])
    want = F.col("inc") & ~F.col("exc")
    action = F.when(want & ~F.col("held"), "GRANT").when(~want & F.col("held"), "REVOKE")
    return (both.withColumn("action", action).where("action is not null").select("role_name", "action", "kind", "granted_name")
            .unionByName(missing_roles(sr, role_grants)))


# --- A15-A20: reverse a spec from present grants -------------------------------
def reverse_spec(role_grants: DataFrame, db_grants: DataFrame, sc_grants: DataFrame,
                 wh_grants: DataFrame) -> DataFrame:
    """For each role, the rules its present grants correspond to.

    Columns: role_name, obj_type, db_name, sc_name, wh_name, role (level of the
    access role, or the granted functional role for obj_type ROLE).
    """
    held = existing(role_grants)
    ar = held.filter(F.col("kind") == "AR").select("role_name", "granted_name").alias("h")
    level = F.regexp_extract(F.col("h.granted_name"), AR_SUFFIX, 1)
    null = F.lit(None).cast("string")
    wh = (ar.join(wh_grants.select("wh_name", "grantee_name").distinct().alias("w"),
                  F.col("h.granted_name") == F.col("w.grantee_name"))
          .select("h.role_name", F.lit("WAREHOUSE").alias("obj_type"), null.alias("db_name"),
                  null.alias("sc_name"), "w.wh_name", level.alias("role")))
    sc = (ar.join(sc_grants.select("db_name", "sc_name", "grantee_name").distinct().alias("c"),
                  F.col("h.granted_name") == F.col("c.grantee_name"))
          .select("h.role_name", F.lit("SCHEMA").alias("obj_type"), "c.db_name", "c.sc_name",
                  null.alias("wh_name"), level.alias("role")))
    db = (ar.join(db_grants.select("db_name", "grantee_name").distinct().alias("d"),
                  F.col("h.granted_name") == F.col("d.grantee_name"))
          .select("h.role_name", F.lit("DATABASE").alias("obj_type"), "d.db_name", null.alias("sc_name"),
                  null.alias("wh_name"), level.alias("role")))
    fr = (held.filter(F.col("kind") == "FR")
          .select("role_name", F.lit("ROLE").alias("obj_type"), null.alias("db_name"), null.alias("sc_name"),
                  null.alias("wh_name"), F.col("granted_name").alias("role")))
    return wh.unionByName(sc).unionByName(db).unionByName(fr).distinct()


def reverse_custom(role_grants: DataFrame, db_grants: DataFrame, sc_grants: DataFrame,
                   wh_grants: DataFrame) -> DataFrame:
    """Held access roles that no grant table explains → CUSTOM_INCLUDE."""
    ar = existing(role_grants).filter(F.col("kind") == "AR").select("role_name", "granted_name")
    known = (db_grants.select("grantee_name").unionByName(sc_grants.select("grantee_name"))
             .unionByName(wh_grants.select("grantee_name")).distinct()
             .withColumnRenamed("grantee_name", "granted_name"))
    return ar.join(known, "granted_name", "left_anti").select("role_name", "granted_name").distinct()


def assemble_spec(rules: DataFrame, custom: DataFrame) -> DataFrame:
    """One JSON document per role (ORDER INCEXC, empty excludes)."""
    inc = (rules.groupBy("role_name")
           .agg(F.sort_array(F.collect_set(F.struct(
               F.col("obj_type").alias("TYPE"), F.col("db_name").alias("DATABASE"),
               F.col("sc_name").alias("SCHEMA"), F.col("wh_name").alias("WAREHOUSE"),
               F.col("role").alias("ROLE")))).alias("INCLUDE")))
    cus = custom.groupBy("role_name").agg(F.sort_array(F.collect_set("granted_name")).alias("CUSTOM_INCLUDE"))
    empty = F.array().cast("array<string>")
    doc = F.struct(F.lit("INCEXC").alias("ORDER"),
                   F.coalesce(F.col("INCLUDE"), F.array()).alias("INCLUDE"),
                   empty.alias("EXCLUDE"),
                   F.coalesce(F.col("CUSTOM_INCLUDE"), empty).alias("CUSTOM_INCLUDE"),
                   empty.alias("CUSTOM_EXCLUDE"), empty.alias("SCIM_ROLES"))
    return (inc.join(cus, "role_name", "full_outer")
            .select("role_name", F.to_json(doc).alias("spec_json")))


# --- A21: spec lint --------------------------------------------------------------
def lint_spec(spec: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Violations per rule row: bad TYPE, missing ROLE / DATABASE / SCHEMA /
    WAREHOUSE, include level not in the type's hierarchy.

    ``hierarchy(obj_type, role)`` lists the levels of each object type.
    """
    levels = hierarchy.select(F.col("obj_type").alias("h_type"), F.col("role").alias("h_role")).distinct()
    s = spec.join(levels,
                  (spec["obj_type"] == levels["h_type"]) & (spec["role_type"] == levels["h_role"]), "left")
    inc = F.col("rule") == "INCLUDE"
    checks = [
        (F.col("obj_type").isNull() | ~F.col("obj_type").isin("DATABASE", "SCHEMA", "WAREHOUSE"), "invalid TYPE"),
        (inc & F.col("role_type").isNull(), "missing ROLE"),
        (inc & F.col("obj_type").isin("DATABASE", "SCHEMA", "WAREHOUSE") & F.col("role_type").isNotNull()
         & F.col("h_role").isNull(), "ROLE not in hierarchy"),
        (F.col("obj_type").isin("DATABASE", "SCHEMA") & F.col("db_pattern").isNull(), "missing DATABASE"),
        ((F.col("obj_type") == "SCHEMA") & F.col("sc_pattern").isNull(), "missing SCHEMA"),
        ((F.col("obj_type") == "WAREHOUSE") & F.col("wh_pattern").isNull(), "missing WAREHOUSE"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]))
    return (s.select("role_name", "rule", "obj_type", "db_pattern", "sc_pattern", "wh_pattern",
                     "role_type", F.explode(problems).alias("violation")))


# Keys every role entry of a spec needs, and which must be lists.
SPEC_KEYS = ("ORDER", "INCLUDE", "EXCLUDE", "CUSTOM_INCLUDE", "CUSTOM_EXCLUDE", "SCIM_ROLES")
SPEC_LIST_KEYS = ("INCLUDE", "EXCLUDE", "CUSTOM_INCLUDE", "CUSTOM_EXCLUDE", "SCIM_ROLES")


def lint_spec_documents(docs: DataFrame) -> DataFrame:
    """A21, document level: per role, missing keys, keys that are not lists and
    rules that are not objects.

    ``docs(doc STRING)`` holds role-spec JSON documents. Each role entry is
    parsed as key → raw JSON text, so a wrong shape is reported instead of
    silently becoming NULL.
    """
    roles = docs.select(F.explode(F.from_json("doc", "map<string,map<string,string>>")).alias("role_name", "entry"))
    checks = [F.when(~F.map_contains_key("entry", k), F.lit(f"missing {k}")) for k in SPEC_KEYS]
    checks += [F.when(F.map_contains_key("entry", k) & ~F.ltrim(F.col("entry")[k]).startswith("["),
                      F.lit(f"{k} is not a list")) for k in SPEC_LIST_KEYS]
    for k in ("INCLUDE", "EXCLUDE"):
        rules = F.from_json(F.try_element_at(F.col("entry"), F.lit(k)), "array<string>")
        checks.append(F.when(F.exists(rules, lambda x: ~F.ltrim(x).startswith("{")), F.lit(f"{k} holds an entry that is no object")))
    return (roles.select("role_name", F.explode(F.array_compact(F.array(*checks))).alias("violation")))


def lint_hierarchies(model: DataFrame) -> DataFrame:
    """Databases and schemas must have the same levels in the same order, since
    schema roles are granted to the database role of their level. One row per level
    that differs: pos, db_role, sc_role."""
    def of(obj_type: str, name: str) -> DataFrame:
        return model.where(F.col("obj_type") == obj_type).select("pos", F.col("role").alias(name)).distinct()

    return of("DATABASE", "db_role").join(of("SCHEMA", "sc_role"), "pos", "full_outer").where(
        ~F.col("db_role").eqNullSafe(F.col("sc_role")))
