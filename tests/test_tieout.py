"""Tie-out: expected counts, invariants, NULL rules and a hot duplicate key."""

import itertools

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.tieout import Tieout
from ledgerline.sources.fixtures import fixture


@pytest.fixture(scope="module")
def ord_pair(spark, sf):
    return fixture(spark, sf, "tie_from"), fixture(spark, sf, "tie_to")


def _summary(t):
    return {r["col_nm"]: r["col_diff_cnt"] for r in t.summary.collect()}


def test_overview_counts(ord_pair):
    f, t = ord_pair
    r = Tieout(f, t, ["o_orderkey"], ignore_cols=["_ignore_me"]).key_stats.first()
    assert (r.from_rowcount, r.to_rowcount, r.from_unique, r.to_unique, r.overlap_rowcount) == (1500, 1462, 54, 16, 1446)
    assert (r.from_dup_keys, r.to_dup_keys) == (0, 1)  # the NULL key group counts


def test_column_counts_and_flags(ord_pair):
    f, t = ord_pair
    base = dict(ignore_cols=["_ignore_me"])
    assert _summary(Tieout(f, t, ["o_orderkey"], **base)) == {
        "o_custkey": 131, "o_orderstatus": 292, "o_orderpriority": 207, "o_orderdate": 0}
    assert _summary(Tieout(f, t, ["o_orderkey"], case_insensitive=True, **base))["o_orderpriority"] == 0
    assert _summary(Tieout(f, t, ["o_orderkey"], null_as_blank=True, **base))["o_orderstatus"] == 292


def test_skipped_and_key_case_insensitive(spark, ord_pair):
    f, t = ord_pair
    tt = Tieout(f, t, ["O_ORDERKEY"], ignore_cols=["_IGNORE_ME"])
    assert sorted((r.tbl_nm, r.col_nm) for r in tt.skipped(spark).collect()) == [("FROM", "from_extra"), ("TO", "to_extra")]
    with pytest.raises(ValueError):
        Tieout(f, t, ["no_such_key"])


def test_self_compare_is_perfect(ord_pair):
    f, _ = ord_pair
    t = Tieout(f, f, ["o_orderkey"])
    r = t.key_stats.first()
    assert r.overlap_rowcount == 1500 and r.from_unique == 0 and r.to_unique == 0
    assert set(_summary(t).values()) == {0}


def test_swapping_sides_swaps_counts(ord_pair):
    f, t = ord_pair
    a = Tieout(f, t, ["o_orderkey"], ignore_cols=["_ignore_me"]).key_stats.first()
    b = Tieout(t, f, ["o_orderkey"], ignore_cols=["_ignore_me"]).key_stats.first()
    assert (a.from_unique, a.to_unique, a.from_rowcount) == (b.to_unique, b.from_unique, b.to_rowcount)


def test_duplicate_keys_multiplicity(spark, sf):
    f, t = fixture(spark, sf, "dup_from"), fixture(spark, sf, "dup_to")
    key = ["l_orderkey", "l_linenumber"]
    ref = Tieout(f, t, key)
    assert _summary(ref)["l_returnflag"] == 16161
    assert _summary(Tieout(f, t, key, multiplicity="pairs"))["l_returnflag"] == 3231
    from_detail = {r.col_nm: r.col_diff_cnt for r in ref.summary_from_detail(ref.detail_rows()).collect()}
    assert from_detail == _summary(ref)


def test_detail_expand_repeats_rows(spark, sf):
    f, t = fixture(spark, sf, "dup_from"), fixture(spark, sf, "dup_to")
    d = Tieout(f, t, ["l_orderkey", "l_linenumber"]).detail()
    total = d.agg(F.sum("diff_cnt")).first()[0]
    assert d.count() < total == Tieout(f, t, ["l_orderkey", "l_linenumber"]).detail(expand=True).count()


def _brute(frows, trows, cmp=lambda x: x):
    """Reference semantics: every differing pair of a key, counted m*n times."""
    out = {}
    keys = {k for k, _ in frows} & {k for k, _ in trows}
    for k in keys:
        fv = [v for kk, v in frows if kk == k]
        tv = [v for kk, v in trows if kk == k]
        w = len(fv) * len(tv)
        out[k] = sum(w for a, b in itertools.product(fv, tv) if cmp(a) != cmp(b))
    return sum(out.values())


def test_hot_key_matches_brute_force(spark):
    # One key holds most rows on both sides, with repeated and distinct values
    # and NULLs; the pair-free formula must equal the explicit pair count.
    frows = [(1, f"v{i % 7}" if i % 11 else None) for i in range(300)] + [(2, "a"), (3, "b"), (None, "z")]
    trows = [(1, f"v{i % 5}" if i % 13 else None) for i in range(200)] + [(2, "a"), (3, "B"), (3, "b")]
    f = spark.createDataFrame(frows, "k int, v string")
    t = spark.createDataFrame(trows, "k int, v string")
    got = _summary(Tieout(f, t, ["k"]))["v"]
    assert got == _brute(frows, trows)
    got_ci = _summary(Tieout(f, t, ["k"], case_insensitive=True))["v"]
    assert got_ci == _brute(frows, trows, lambda x: None if x is None else x.upper())
    d = Tieout(f, t, ["k"]).detail_rows()
    assert d.agg(F.sum("diff_cnt")).first()[0] == got


def test_null_as_blank_on_non_string_types(spark):
    f = spark.createDataFrame([(1, None, None), (2, 5, "2020-01-01")], "k int, n int, d string").withColumn("d", F.to_date("d"))
    t = spark.createDataFrame([(1, None, None), (2, 6, "2020-01-01")], "k int, n int, d string").withColumn("d", F.to_date("d"))
    assert _summary(Tieout(f, t, ["k"], null_as_blank=True, case_insensitive=True)) == {"n": 1, "d": 0}


def test_composite_key_nulls_excluded_from_counts(spark):
    f = spark.createDataFrame([(1, 2), (1, None), (None, None)], "a int, b int")
    t = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    r = Tieout(f, t, ["a", "b"]).key_stats.first()
    assert (r.from_rowcount, r.overlap_rowcount, r.from_unique, r.to_unique) == (1, 1, 0, 0)


@pytest.mark.parametrize("ci,nb", [(False, False), (True, True)])
def test_pair_path_equals_count_path(spark, sf, ci, nb):
    """Every key through the value-count path (limit 1) or through row pairs
    (huge limit) must give the same summary and the same detail."""
    f, t = fixture(spark, sf, "dup_from"), fixture(spark, sf, "dup_to")
    key = ["l_orderkey", "l_linenumber"]
    opts = dict(case_insensitive=ci, null_as_blank=nb)
    lo, hi = Tieout(f, t, key, pair_limit=1, **opts), Tieout(f, t, key, pair_limit=10**9, **opts)
    assert _summary(lo) == _summary(hi)
    a, b = lo.detail_rows(), hi.detail_rows()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    p1, p2 = (Tieout(f, t, key, pair_limit=1, multiplicity="pairs", **opts),
              Tieout(f, t, key, pair_limit=10**9, multiplicity="pairs", **opts))
    assert _summary(p1) == _summary(p2)


def test_negative_zero_equals_zero_on_both_paths(spark):
    rows_f = [(1, 0.0), (2, -0.0), (2, -0.0)]
    rows_t = [(1, -0.0), (2, 0.0), (2, 0.0)]
    f = spark.createDataFrame(rows_f, "k int, x double")
    t = spark.createDataFrame(rows_t, "k int, x double")
    assert _summary(Tieout(f, t, ["k"], pair_limit=1)) == {"x": 0}
    assert _summary(Tieout(f, t, ["k"], pair_limit=100)) == {"x": 0}


def test_column_names_may_be_anything(spark):
    f = spark.createDataFrame([(1, "x", 2, 3, 4, 5)], "`a.b` int, idx string, c int, m int, n int, cmp int")
    t = spark.createDataFrame([(1, "y", 2, 3, 4, 6)], "`a.b` int, idx string, c int, m int, n int, cmp int")
    assert _summary(Tieout(f, t, ["a.b"])) == {"idx": 1, "c": 0, "m": 0, "n": 0, "cmp": 1}
    assert _summary(Tieout(f, t, ["c", "m"])) == {"a.b": 0, "idx": 1, "n": 0, "cmp": 1}
    row = Tieout(f, t, ["a.b"]).detail().where("col_nm = 'cmp'").first()
    assert row.data_vals == '{"a.b":1,"__to_val":6,"__from_val":5}'


def test_hot_key_weight_exceeds_a_bigint(spark):
    f = spark.range(60_000).select(F.lit(1).alias("k"), F.lit("a").alias("v"))
    t = spark.range(60_000).select(F.lit(1).alias("k"), F.lit("b").alias("v"))
    assert _summary(Tieout(f, t, ["k"])) == {"v": 60_000 ** 4}


def test_unlike_types_are_compared_by_value(spark):
    f = spark.sql("select 1 as k, cast(1.5 as decimal(10,2)) as d, 1 as i, date'2024-01-02' as t, "
                  "map('a', 1, 'b', 2) as m, struct(timestamp'2024-01-01 00:00:00.000001' as x) as s, 1.0f as r")
    t = spark.sql("select 1 as k, cast(1.5 as decimal(12,4)) as d, 1.0d as i, timestamp'2024-01-02 00:00:00' as t, "
                  "map('b', 2, 'a', 1) as m, struct(timestamp'2024-01-01 00:00:00.000002' as x) as s, cast('1' as string) as r")
    want = {"d": 0, "i": 0, "t": 0, "m": 0, "s": 1, "r": 1}  # 1.0 and the text 1 have no common type
    assert _summary(Tieout(f, t, ["k"])) == want
    twice = [x.union(x) for x in (f, t)]
    assert _summary(Tieout(*twice, ["k"], multiplicity="pairs")) == {k: 4 * v for k, v in want.items()}


def test_value_counts_of_a_hot_key(spark):
    f = spark.createDataFrame([(1, f"v{i}") for i in range(1000)] + [(2, "a"), (3, "a")], "k int, v string")
    t = spark.createDataFrame([(1, f"v{i + 1}") for i in range(1000)] + [(2, "b"), (4, "a")], "k int, v string")
    got = sorted(tuple(r) for r in Tieout(f, t, ["k"]).value_counts().collect())
    assert got == [(1, "v", "v0", 1, 0), (1, "v", "v1000", 0, 1), (2, "v", "a", 1, 0), (2, "v", "b", 0, 1)]


def test_key_columns_may_be_called_like_the_counts(spark):
    f = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (2, 6, "b")], "from_cnt int, to_cnt int, name string")
    t = spark.createDataFrame([(1, 5, "x"), (2, 7, "b")], "from_cnt int, to_cnt int, name string")
    tie = Tieout(f, t, ["from_cnt", "to_cnt"])
    r = tie.key_stats.first()
    assert (r.from_rowcount, r.overlap_rowcount, r.from_unique, r.to_unique, r.from_dup_keys) == (3, 1, 1, 1, 1)
    assert _summary(tie) == {"name": 1} and tie.detail().count() == 1
    assert _summary(Tieout(f, t, ["from_cnt"])) == {"to_cnt": 4, "name": 1}  # two of key 2's pairs, twice each


def test_keys_of_unlike_types_meet_as_text(spark):
    f = spark.createDataFrame([("1", "a"), ("x", "b")], "k string, v string")
    t = spark.createDataFrame([(1, "c"), (2, "b")], "k int, v string")
    tie = Tieout(f, t, ["k"])
    r = tie.key_stats.first()
    assert (r.overlap_rowcount, r.from_unique, r.to_unique) == (1, 1, 1) and _summary(tie) == {"v": 1}


def test_heavy_keys_are_dealt_over_salts_and_others_are_not(spark):
    """A third of the rows under one key, many keys above and below the pair limit."""
    f = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("int").alias("k"),
                                   (F.col("id") % 11).alias("v"))
    t = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 900).cast("int").alias("k"),
                                   (F.col("id") % 13).alias("v"))
    tie = Tieout(f, t, ["k"], multiplicity="pairs")
    salts = {r["__tie_k0"]: r["__tie_salts"] for r in tie._shared_keys().collect()}
    assert salts[0] > 100 and sum(s > 1 for s in salts.values()) == 1
    side = [df.groupBy("k", "v").count().collect() for df in (f, t)]
    want = sum(a["count"] * b["count"] for a in side[0] for b in side[1] if a.k == b.k and a.v != b.v)
    assert _summary(tie) == {"v": want}
    assert tie.detail_rows().agg(F.sum("diff_cnt")).first()[0] == want
    spread = tie._keyed_rows("f").where("__tie_k0 = 0").select("__tie_salt").distinct().count()
    assert spread > 50 and tie._keyed_rows("f").count() == f.join(t.select("k").distinct(), "k", "left_semi").count()


def test_exact_numbers_across_types(spark):
    from decimal import Decimal as D

    big, small = 1 << 53, D("0.10000000000000000001")
    cases = [  # from type and value, to type and value, differs
        ("bigint", big + 1, "double", float(big), True), ("bigint", big, "double", float(big), False),
        ("bigint", 1 << 60, "double", float(1 << 60), False), ("bigint", (1 << 60) + 1, "double", float(1 << 60), True),
        ("bigint", (1 << 63) - 1, "double", float(1 << 63), True), ("bigint", -(1 << 63), "double", -float(1 << 63), False),
        ("decimal(20,2)", D("0.10"), "double", 0.1, False), ("decimal(20,2)", D("0.11"), "double", 0.1, True),
        ("decimal(38,20)", small, "double", 0.1, True), ("decimal(38,0)", D(10**37), "decimal(38,20)", D("1E-20"), True),
        ("decimal(38,0)", D(-7), "decimal(38,20)", D("-7"), False),
        ("decimal(38,0)", D(-7), "decimal(38,20)", D("-7.00000000000000000001"), True),
        ("bigint", -7, "decimal(38,30)", D("-7"), False), ("bigint", 3, "double", float("nan"), True),
        ("bigint", None, "double", 0.0, True), ("bigint", None, "double", None, False),
        ("bigint", 0, "double", -0.0, False), ("int", 5, "double", 5.0, False)]
    sides = []
    for kind, value in ((0, 1), (2, 3)):
        names = ", ".join(f"c{i} {case[kind]}" for i, case in enumerate(cases))
        sides.append(spark.createDataFrame([(1, *[case[value] for case in cases])], f"k int, {names}"))
    want = {f"c{i}": int(case[4]) for i, case in enumerate(cases)}
    assert _summary(Tieout(*sides, ["k"])) == want
    twice = Tieout(*[x.union(x) for x in sides], ["k"], multiplicity="pairs", pair_limit=1)
    assert _summary(twice) == {c: 4 * n for c, n in want.items()}
    assert {r.col_nm for r in twice.detail_rows().collect()} == {c for c, n in want.items() if n}


def test_positions_are_gapless_and_in_order(spark):
    from ledgerline.operators.ordering import with_position

    df = spark.range(5_000).select((F.col("id") * 7_919 % 5_003).alias("x"), (F.col("id") % 3).alias("y"))
    got = with_position(df, F.desc("y"), "x").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 5_001))
    assert [(r.y, r.x) for r in got] == sorted(((r.y, r.x) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert with_position(df.where("false"), "x").count() == 0
    plan = with_position(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_stored_keys_change_the_work_not_the_result(spark, tmp_path):
    """Whether large keys exist is asked once; without any, each side is read once."""
    rows = [(k, i % 3 if k == 1 else k % 2, f"x{i % 2}") for k in range(40) for i in range(20 if k == 1 else 1 + k % 2)]
    f = spark.createDataFrame(rows, "k int, a int, b string")
    t = spark.createDataFrame([(k if k != 7 else None, a + (k % 5 == 0), b) for k, a, b in rows], "k int, a int, b string")
    for n, limit in enumerate((1, 64, 10_000)):
        plain, stored = (Tieout(f, t, ["k"], pair_limit=limit) for _ in range(2))
        stored.store_keys(str(tmp_path / str(n)))
        for out in (lambda x: x.overview, lambda x: x.summary, lambda x: x.detail(), lambda x: x.value_counts()):
            assert sorted(map(str, out(plain).collect())) == sorted(map(str, out(stored).collect())), limit
        assert stored._large == (limit < 400)
        scans = stored.detail()._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
        assert scans == (2 if limit == 10_000 else 4) or limit < 400
    alone = Tieout(f, t.where("k is null"), ["k"]).store_keys(str(tmp_path / "none"))
    assert alone.detail().count() == 0 and {r.col_diff_cnt for r in alone.summary.collect()} == {0}
