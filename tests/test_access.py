"""Role delta on the schema-only spec, and delta idempotence."""

from pyspark.sql import functions as F

from ledgerline.operators import access
from ledgerline.sources.fixtures import fixture


def _inputs(spark, sf):
    fx = lambda n: fixture(spark, sf, n)
    spec = fx("role_spec").select("role_name", "rule", F.lit("SCHEMA").alias("obj_type"), "db_pattern", "sc_pattern",
                                  F.lit(None).cast("string").alias("wh_pattern"),
                                  F.lit(None).cast("string").alias("role_pattern"), "role_type")
    return dict(spec=spec, db_grants=fx("future_grants_db"), sc_grants=fx("future_grants_schema"),
                wh_grants=access.warehouse_grants(fx("grants_to_roles")), roles=fx("roles"),
                role_grants=fx("role_grants"))


def test_schema_only_counts(spark, sf):
    i = _inputs(spark, sf)
    want = access.wanted(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"])
    have = access.existing(i["role_grants"], access.spec_roles(i["spec"])).filter("kind = 'AR'").distinct()
    assert (want.count(), have.count()) == (55, 132)
    delta = access.role_delta(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"], i["role_grants"])
    ar = delta.filter("kind = 'AR'")
    assert (ar.filter("action = 'GRANT'").count(), ar.filter("action = 'REVOKE'").count()) == (54, 131)


def test_applying_delta_empties_next_delta(spark, sf):
    i = _inputs(spark, sf)
    delta = access.role_delta(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"], i["role_grants"])
    g = i["role_grants"]
    revoked = delta.filter("action = 'REVOKE'").select("role_name", "granted_name")
    granted = delta.filter("action = 'GRANT'").select("role_name", F.lit("USAGE").alias("privilege"), "granted_name")
    after = g.join(revoked, ["role_name", "granted_name"], "left_anti").unionByName(granted)
    again = access.role_delta(i["spec"], i["db_grants"], i["sc_grants"], i["wh_grants"], i["roles"], after)
    assert again.filter(F.col("action").isin("GRANT", "REVOKE")).count() == 0


def test_like_underscore_is_a_wildcard(spark):
    df = spark.createDataFrame([("XSCYDB_X_RO_AR",)], "g string")
    assert df.filter(F.expr("g like '_SC_%_RO_AR'")).count() == 1


def test_many_rules_resolve_without_a_cap(spark):
    rows = [(f"R_{i}_FR", "INCLUDE", "WAREHOUSE", None, None, f"WH_{i}", None, "OPR") for i in range(250_000)]
    spec = spark.createDataFrame(rows, "role_name string, rule string, obj_type string, db_pattern string, sc_pattern string, "
                                       "wh_pattern string, role_pattern string, role_type string")
    wh = spark.createDataFrame([(f"WH_{i}", f"_WH_WH_{i}_OPR_AR") for i in range(0, 250_000, 1000)], "wh_name string, grantee_name string")
    none = spark.createDataFrame([], "db_name string, sc_name string, grantee_name string")
    roles = spark.createDataFrame([], "name string, deleted_on timestamp")
    got = access.resolve_rules(spec, none, none, wh, roles, "INCLUDE")
    # "_" is a wildcard: WH_1 also matches a name like WHx1, of which there is none.
    assert got.count() == 250


def test_patterns_meet_every_name_they_match(spark):
    from itertools import product

    patterns = ["AB", "A%", "%B", "%", "_B", "A_", "%A%", "A%B", "", "AB%CD", "_%_"]
    names = ["AB", "A", "B", "", "XB", "AXB", "ABxxCD", "BA", "Ax" * 40, "x" * 40 + "B"]
    p = spark.createDataFrame([("ROLE", x) for x in patterns], "obj_type string, pattern string")
    n = spark.createDataFrame([("ROLE", x) for x in names], "obj_type string, name string")
    got = {(r.pattern, r.name) for r in access.matching_names(p, n).collect()}
    import fnmatch
    want = {(a, b) for a, b in product(patterns, names) if fnmatch.fnmatchcase(b, a.replace("%", "*").replace("_", "?"))}
    assert got == want




def test_hierarchies_must_agree(spark):
    rows = [("DATABASE", 0, "OWN"), ("DATABASE", 1, "VEW"), ("SCHEMA", 0, "OWN"), ("SCHEMA", 1, "EDT"), ("SCHEMA", 2, "VEW")]
    model = spark.createDataFrame(rows, "obj_type string, pos int, role string")
    assert sorted(map(tuple, access.lint_hierarchies(model).collect())) == [(1, "VEW", "EDT"), (2, None, "VEW")]
    same = model.where("pos = 0")
    assert access.lint_hierarchies(same).count() == 0


def test_infix_patterns_meet_through_their_rarest_gram(spark):
    import random
    import re

    draw = random.Random(4)
    names = sorted({"".join(draw.choices("ABCDE_0", k=draw.randint(1, 9))) for _ in range(400)} | {"AAA", "B", "_", ""})
    infix = {f"%{''.join(draw.choices('ABCDE0', k=draw.randint(1, 3)))}_{''.join(draw.choices('ABCDE0', k=draw.randint(1, 3)))}%"
             for _ in range(10_000)}
    patterns = sorted(infix | {"%", "_", "%%", "", "_A%", "%A_", "A%B", "%_B_%", "_%_", "ABC", "%\\_%", "A\\_%", "%é%"})
    sides = [spark.createDataFrame([(t, x) for x in values for t in "RW"], f"obj_type string, {n} string")
             for n, values in (("pattern", patterns), ("name", names))]
    tokens = sides[0].select("pattern", access.pattern_token(F.col("pattern")).alias("token")).distinct().collect()
    assert {r.pattern for r in tokens if r.token == "*"} == {"%", "_", "%%", "_%_", "%\\_%", "A\\_%"}

    def regex(pattern):
        out, i = "", 0
        while i < len(pattern):
            if pattern[i] == "\\":
                i += 1
                out += re.escape(pattern[i])
            else:
                out += {"%": ".*", "_": "."}.get(pattern[i], re.escape(pattern[i]))
            i += 1
        return re.compile(out + r"\Z", re.S)

    want = sorted((p, n) for p in patterns for n in filter(regex(p).match, names))
    got = access.matching_names(*sides).collect()
    for kind in "RW":
        assert sorted((r.pattern, r.name) for r in got if r.obj_type == kind) == want


def _sides(spark, patterns, names):
    return (spark.createDataFrame([("R", x) for x in patterns], "obj_type string, pattern string"),
            spark.createDataFrame([("R", x) for x in names], "obj_type string, name string"))


def test_patterns_with_a_common_beginning_do_not_meet_all_names(spark):
    """``_`` in ``WH_17`` is a wildcard; the lookup reads the places after it, too."""
    sides = _sides(spark, [f"WH_{i}" for i in range(2_000)], [f"WH_{i}" for i in range(2_000)])
    assert access.meetings(*sides).count() == 2_000
    infix = _sides(spark, [f"%{i // 1000 % 1000:03}_{i % 1000:03}%" for i in range(0, 90_000, 7)],
                   [f"N#{i:09}" for i in range(0, 90_000, 7)])
    met = access.meetings(*infix)
    assert met.count() == met.where("name like pattern").count()


def test_names_cut_to_shapes_are_not_broadcast(spark):
    sides = _sides(spark, ["%A_C%", "WH_1"], ["XABCX", "WHx1"])
    plan = access.matching_names(*sides)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_more_shapes_than_are_kept(spark):
    import random
    import re

    draw = random.Random(9)
    text = lambda most, letters: "".join(draw.choices(letters, k=draw.randint(1, most)))
    patterns = sorted({text(7, "ABCD__%") for _ in range(1_500)} | {"%", "", "_", "AB", "é_%", "A\\_B"} | {"A" * 40 + "_%B"})
    names = sorted({text(7, "ABCD_") for _ in range(300)} | {"", "é1", "A\nB", "A" * 41 + "CB", "A" * 41})
    sides = _sides(spark, patterns, names)
    shapes = sides[0].select(F.explode(access.segments(F.col("pattern"))).alias("s")).select(access.shape(F.col("s"))).distinct().count()
    assert shapes > access.SHAPES
    escaped = lambda p: re.escape(p).replace("%", ".*").replace("_", ".") if "\\" not in p else re.escape("A_B")
    want = sorted((p, n) for p in patterns for n in names if re.fullmatch(escaped(p), n, re.S))
    assert sorted((r.pattern, r.name) for r in access.matching_names(*sides).collect()) == want
