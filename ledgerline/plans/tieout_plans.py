"""Tie-out queries: the sample validation target with two validations.

ORD compares ``tie_from`` with ``tie_to`` (unique key, NULL and moved keys,
NULL/blank/case differences, one-sided and ignored columns). DUP compares
``dup_from`` with ``dup_to`` (non-unique key).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import reports, tieout
from ledgerline.operators.tieout import Tieout, Validation, run_validations
from ledgerline.plans.registry import register
from ledgerline.sources.fixtures import fixture, oracle_cte

ORD = Validation("ORD", ("o_orderkey",), "TEST_DB.TIE.TIE_FROM", "TEST_DB.TIE.TIE_TO", ("_ignore_me",))
DUP = Validation("DUP", ("l_orderkey", "l_linenumber"), "TEST_DB.TIE.DUP_FROM", "TEST_DB.TIE.DUP_TO")
ORD_COLS = ["o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
DUP_COLS = ["l_linestatus", "l_returnflag"]
_FIX = {"TEST_DB.TIE.TIE_FROM": "tie_from", "TEST_DB.TIE.TIE_TO": "tie_to",
        "TEST_DB.TIE.DUP_FROM": "dup_from", "TEST_DB.TIE.DUP_TO": "dup_to"}
CTE = oracle_cte("tie_from", "tie_to", "dup_from", "dup_to")


def _tieout(spark, sf_dir, v: Validation, **opts) -> Tieout:
    f = fixture(spark, sf_dir, _FIX[v.from_tbl])
    t = fixture(spark, sf_dir, _FIX[v.to_tbl])
    return Tieout(f, t, list(v.key), name=v.name, from_tbl=v.from_tbl, to_tbl=v.to_tbl,
                  ignore_cols=v.ignore_cols, **opts)


def _int(df, *names):
    """Difference counts as BIGINT: they fit for these tables, and the engine's
    exact decimals and the oracle's integers are then the same type."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names or ("col_diff_cnt",)})


def _tables(spark, sf_dir):
    return {k: fixture(spark, sf_dir, v) for k, v in _FIX.items()}


# --- oracle helpers -----------------------------------------------------------
def _nn(keys, alias=""):
    p = f"{alias}." if alias else ""
    return " and ".join(f"{p}{k} is not null" for k in keys)


def _keycount_sql(v: Validation, src: str) -> str:
    return f"(select count(*) filter (where {_nn(v.key)}) from {src})"


def _overlap_sql(v: Validation, f: str, t: str) -> str:
    k = ", ".join(v.key)
    return f"""
{v.name}_fk as (select {k} from {f} except select {k} from {t}),
{v.name}_tk as (select {k} from {t} except select {k} from {f}),
{v.name}_bk as (select {k} from {f} intersect select {k} from {t})"""


def _stats_select(v: Validation, f: str, t: str) -> str:
    return (f"select '{v.name}' as name, {_keycount_sql(v, f)} as from_rowcount, "
            f"{_keycount_sql(v, t)} as to_rowcount, {_keycount_sql(v, v.name + '_fk')} as from_unique, "
            f"{_keycount_sql(v, v.name + '_tk')} as to_unique, "
            f"{_keycount_sql(v, v.name + '_bk')} as overlap_rowcount")


def _cmp(expr: str, mode: str) -> str:
    if mode == "ci":
        return f"upper(cast({expr} as varchar))"
    if mode == "nb":
        return f"coalesce(cast({expr} as varchar), '')"
    if mode == "cinb":
        return f"upper(coalesce(cast({expr} as varchar), ''))"
    return expr


def _summary_sql(v: Validation, cols, f: str, t: str, mode: str = "plain") -> str:
    """The reference's shape: shared_keys (not distinct) x from x to, per column."""
    on_ft = " and ".join(f"f.{k} = t.{k}" for k in v.key)
    on_s = " and ".join(f"s.{k} = f.{k} and s.{k} = t.{k}" for k in v.key)
    sk = f"(select {', '.join('f.' + k for k in v.key)} from {f} f join {t} t on {on_ft})"
    parts = []
    for c in cols:
        parts.append(
            f"select '{v.name}' as name, '{c}' as col_nm, count(*) as col_diff_cnt "
            f"from {sk} s join {f} f on {' and '.join(f's.{k} = f.{k}' for k in v.key)} "
            f"join {t} t on {on_s} "
            f"where {_cmp('f.' + c, mode)} is distinct from {_cmp('t.' + c, mode)}")
    return "\nunion all\n".join(parts)


def _detail_sql(v: Validation, cols, f: str, t: str) -> str:
    on_ft = " and ".join(f"f.{k} = t.{k}" for k in v.key)
    on_s = " and ".join(f"s.{k} = f.{k} and s.{k} = t.{k}" for k in v.key)
    sk = f"(select {', '.join('f.' + k for k in v.key)} from {f} f join {t} t on {on_ft})"
    keys = ", ".join(f"s.{k}" for k in v.key)
    parts = []
    for c in cols:
        parts.append(
            f"select '{v.name}' as name, '{c}' as col_nm, {keys}, cast(f.{c} as varchar) as from_val, "
            f"cast(t.{c} as varchar) as to_val, count(*) as diff_cnt "
            f"from {sk} s join {f} f on {' and '.join(f's.{k} = f.{k}' for k in v.key)} "
            f"join {t} t on {on_s} where f.{c} is distinct from t.{c} "
            f"group by {keys}, f.{c}, t.{c}")
    return "\nunion all\n".join(parts)


# --- key-level queries --------------------------------------------------------
@register("tieout_duplicate_keys", CTE + f"""
select 'ORD' as name,
       (select count(*) from (select o_orderkey from tie_from group by o_orderkey having count(*) > 1)) as from_dup_keys,
       (select count(*) from (select o_orderkey from tie_to group by o_orderkey having count(*) > 1)) as to_dup_keys
union all
select 'DUP',
       (select count(*) from (select 1 from dup_from group by l_orderkey, l_linenumber having count(*) > 1)),
       (select count(*) from (select 1 from dup_to group by l_orderkey, l_linenumber having count(*) > 1))""")
def tieout_duplicate_keys(spark, sf_dir):
    return (_tieout(spark, sf_dir, ORD).duplicate_keys
            .unionByName(_tieout(spark, sf_dir, DUP).duplicate_keys))


@register("tieout_key_overlap", CTE + "," + _overlap_sql(ORD, "tie_from", "tie_to") + ","
          + _overlap_sql(DUP, "dup_from", "dup_to") + "\n"
          + _stats_select(ORD, "tie_from", "tie_to") + "\nunion all\n"
          + _stats_select(DUP, "dup_from", "dup_to"))
def tieout_key_overlap(spark, sf_dir):
    cols = ["from_rowcount", "to_rowcount", "from_unique", "to_unique", "overlap_rowcount"]
    out = []
    for v in (ORD, DUP):
        out.append(_tieout(spark, sf_dir, v).key_stats.select(F.lit(v.name).alias("name"), *cols))
    return out[0].unionByName(out[1])


@register("tieout_overview", CTE + "," + _overlap_sql(ORD, "tie_from", "tie_to") + f"""
select 'ORD' as name, 'o_orderkey' as key_names,
       {_keycount_sql(ORD, 'ORD_bk')} as overlap_rowcount,
       '{ORD.from_tbl}' as from_tbl, {_keycount_sql(ORD, 'tie_from')} as from_rowcount,
       {_keycount_sql(ORD, 'ORD_fk')} as from_unique,
       '{ORD.to_tbl}' as to_tbl, {_keycount_sql(ORD, 'tie_to')} as to_rowcount,
       {_keycount_sql(ORD, 'ORD_tk')} as to_unique""")
def tieout_overview(spark, sf_dir):
    o = _tieout(spark, sf_dir, ORD).overview
    return o.select("name", F.concat_ws(",", "key").alias("key_names"),
                    *[c for c in o.columns if c not in ("name", "key")])


# --- column-level queries -----------------------------------------------------
_COLUMNS_SQL = oracle_cte("catalog_columns") + """,
sided as (select table_name, lower(column_name) as low, table_schema, min(column_name) as column_name
            from catalog_columns group by all),
shared as (select table_name from sided group by table_name having count(distinct table_schema) = 2),
paired as (select table_name, low, list(table_schema order by table_schema) as owners, arg_min(column_name, table_schema) as col_nm
             from sided semi join shared using (table_name) group by table_name, low)"""


@register("tieout_columns_reconciled", _COLUMNS_SQL + """
select table_name, col_nm, case when len(owners) = 2 then 'BOTH' when owners[1] = 'SC_1' then 'FROM' else 'TO' end as source,
       case when len(owners) = 1 then owners[1] end as owner
  from paired""")
def tieout_columns_reconciled(spark, sf_dir):
    """S3 + T6 over a column catalog: all tables of two schemas at once."""
    return tieout.reconcile_columns(fixture(spark, sf_dir, "catalog_columns"), "SC_1", "SC_2")


@register("tieout_columns_skipped", _COLUMNS_SQL + """
select table_name as name, owners[1] || '.' || table_name as tbl_nm, col_nm from paired where len(owners) = 1""")
def tieout_columns_skipped(spark, sf_dir):
    """T7 + K4 rows: columns that only one side of a table pair has."""
    c = tieout.reconcile_columns(fixture(spark, sf_dir, "catalog_columns"), "SC_1", "SC_2").where("source <> 'BOTH'")
    return c.select(F.col("table_name").alias("name"), F.concat_ws(".", "owner", "table_name").alias("tbl_nm"), "col_nm")


@register("tieout_columns_summary", CTE + "\n" + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to"))
def tieout_columns_summary(spark, sf_dir):
    return _int(_tieout(spark, sf_dir, ORD).summary)


@register("tieout_summary_duplicate_keys", CTE + "\n" + _summary_sql(DUP, DUP_COLS, "dup_from", "dup_to"))
def tieout_summary_duplicate_keys(spark, sf_dir):
    return _int(_tieout(spark, sf_dir, DUP).summary)


_PAIRS = "\nunion all\n".join(
    f"select 'DUP' as name, '{c}' as col_nm, count(*) as col_diff_cnt from dup_from f join dup_to t "
    f"on f.l_orderkey = t.l_orderkey and f.l_linenumber = t.l_linenumber "
    f"where f.{c} is distinct from t.{c}" for c in DUP_COLS)


@register("tieout_summary_pairs", CTE + "\n" + _PAIRS)
def tieout_summary_pairs(spark, sf_dir):
    return _int(_tieout(spark, sf_dir, DUP, multiplicity="pairs").summary)


@register("tieout_columns_multi", CTE + "\n" + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to")
          + "\nunion all\n" + _summary_sql(DUP, DUP_COLS, "dup_from", "dup_to"))
def tieout_columns_multi(spark, sf_dir):
    return _int(run_validations(spark, _tables(spark, sf_dir), [ORD, DUP])["summary"])


@register("tieout_case_insensitive", CTE + "\n" + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to", "ci"))
def tieout_case_insensitive(spark, sf_dir):
    return _int(_tieout(spark, sf_dir, ORD, case_insensitive=True).summary)


@register("tieout_null_as_blank", CTE + "\n" + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to", "nb"))
def tieout_null_as_blank(spark, sf_dir):
    return _int(_tieout(spark, sf_dir, ORD, null_as_blank=True).summary)


@register("tieout_ci_null_blank", CTE + "\n" + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to", "cinb"))
def tieout_ci_null_blank(spark, sf_dir):
    return _int(_tieout(spark, sf_dir, ORD, case_insensitive=True, null_as_blank=True).summary)


@register("tieout_columns_detail", CTE + "\n" + _detail_sql(ORD, ORD_COLS, "tie_from", "tie_to"))
def tieout_columns_detail(spark, sf_dir):
    d = _int(_tieout(spark, sf_dir, ORD).detail(), "diff_cnt")
    return d.select("name", "col_nm", F.get_json_object("data_vals", "$.o_orderkey").cast("bigint")
                    .alias("o_orderkey"), "from_val", "to_val", "diff_cnt")


@register("tieout_detail_duplicate_keys", CTE + "\n" + _detail_sql(DUP, DUP_COLS, "dup_from", "dup_to"))
def tieout_detail_duplicate_keys(spark, sf_dir):
    return (_int(_tieout(spark, sf_dir, DUP).detail_rows(), "diff_cnt")
            .select(F.lit("DUP").alias("name"), "col_nm", "l_orderkey", "l_linenumber",
                    "from_val", "to_val", "diff_cnt"))


def _soundex_sql(x: str) -> str:
    """Spark's soundex in DuckDB string functions (DuckDB has none): first
    letter kept, H/W ignored, runs of one code collapsed, vowels and
    non-letters separate runs, padded to four; non-letter first character →
    input unchanged."""
    s = f"upper({x})"
    codes = (f"translate(regexp_replace({s}, '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             f"'01230127022455012623017202')")
    col = f"replace({codes}, '7', '')"
    for d in "0123456":
        col = f"regexp_replace({col}, '{d}+', '{d}', 'g')"
    rest = f"replace(substr({col}, 2), '0', '')"
    return (f"case when {x} = '' then '' when not regexp_matches(substr({x}, 1, 1), '^[A-Za-z]$') then {x} "
            f"else substr({s}, 1, 1) || rpad(substr({rest}, 1, 3), 3, '0') end")


# --- reports ------------------------------------------------------------------
def _multi(spark, sf_dir, *wanted):
    """The outputs named (overview, summary, detail) of both validations."""
    import uuid

    from ledgerline.session import scratch_path

    ts = [_tieout(spark, sf_dir, v) for v in (ORD, DUP)]
    if len(wanted) > 1:  # both need the keys' counts
        ts = [t.store_keys(scratch_path(spark, f"keys-{uuid.uuid4().hex}")) for t in ts]
    of = {"overview": lambda t: t.overview, "summary": lambda t: t.summary, "detail": lambda t: t.detail()}
    return [of[w](ts[0]).unionByName(of[w](ts[1])) for w in wanted]


_OVERVIEW_CTE = (CTE + "," + _overlap_sql(ORD, "tie_from", "tie_to") + "," + _overlap_sql(DUP, "dup_from", "dup_to")
                 + ",\nov as (" + _stats_select(ORD, "tie_from", "tie_to") + "\nunion all\n"
                 + _stats_select(DUP, "dup_from", "dup_to") + ")"
                 + ",\nsm as (" + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to") + "\nunion all\n"
                 + _summary_sql(DUP, DUP_COLS, "dup_from", "dup_to") + ")")


@register("sum_overview", _OVERVIEW_CTE + """
select name, overlap_rowcount, from_unique,
       round(cast(from_unique as double) * 100 / nullif(overlap_rowcount, 0), 3) as from_pct,
       to_unique,
       round(cast(to_unique as double) * 100 / nullif(overlap_rowcount, 0), 3) as to_pct
  from ov""")
def sum_overview(spark, sf_dir):
    return reports.sum_overview(*_multi(spark, sf_dir, "overview"))


_SUM_COLUMN_SQL = """
select ov.name, sm.col_nm, ov.overlap_rowcount, sm.col_diff_cnt,
       round(100 - cast(sm.col_diff_cnt as double) * 100 / nullif(ov.overlap_rowcount, 0), 3) as col_pct,
       case when sm.col_diff_cnt = 0 then 'PERFECT' else 'IMPERFECT' end as col_match
  from ov join sm on ov.name = sm.name"""


@register("sum_column", _OVERVIEW_CTE + _SUM_COLUMN_SQL)
def sum_column(spark, sf_dir):
    o, s = _multi(spark, sf_dir, "overview", "summary")
    return _int(reports.sum_column(o, s))


@register("sum_field", _OVERVIEW_CTE + ",\nsc as (" + _SUM_COLUMN_SQL + """)
select name, cast(sum(overlap_rowcount) as bigint) as tot_fields, cast(sum(col_diff_cnt) as bigint) as tot_diff,
       round(cast(sum(col_diff_cnt) as double) * 100 / nullif(sum(overlap_rowcount), 0), 3) as diff_pct,
       100 - round(cast(sum(col_diff_cnt) as double) * 100 / nullif(sum(overlap_rowcount), 0), 3) as tot_pct
  from sc group by name""")
def sum_field(spark, sf_dir):
    o, s = _multi(spark, sf_dir, "overview", "summary")
    return _int(reports.sum_field(reports.sum_column(o, s)), "tot_diff")


@register("sum_detail", _OVERVIEW_CTE + ",\ndt as (" + _detail_sql(ORD, ORD_COLS, "tie_from", "tie_to").replace(
    "s.o_orderkey,", "") + "\nunion all\n" + _detail_sql(DUP, DUP_COLS, "dup_from", "dup_to").replace(
    "s.l_orderkey, s.l_linenumber,", "") + """)
select dt.name, ov.overlap_rowcount, dt.col_nm,
       case dt.name when 'ORD' then 'o_orderkey' else 'l_orderkey,l_linenumber' end as key_names,
       dt.from_val, dt.to_val, cast(sum(dt.diff_cnt) as bigint) as col_diff_cnt,
       round(cast(sum(dt.diff_cnt) as double) * 100 / nullif(ov.overlap_rowcount, 0), 3) as col_diff_pct,
       round(jaro_winkler_similarity(dt.from_val, dt.to_val), 4) as jarowinkler_score,
       cast(round(jaro_winkler_similarity(dt.from_val, dt.to_val) * 100) as integer) as jarowinkler_similarity,
       levenshtein(dt.from_val, dt.to_val) as editdistance,
       (SDX_FROM) = (SDX_TO) as soundex
  from dt join ov on dt.name = ov.name
 group by dt.name, ov.overlap_rowcount, dt.col_nm, dt.from_val, dt.to_val""".replace(
    "SDX_FROM", _soundex_sql("dt.from_val")).replace("SDX_TO", _soundex_sql("dt.to_val")))
def sum_detail(spark, sf_dir):
    o, d = _multi(spark, sf_dir, "overview", "detail")
    r = _int(reports.sum_detail(o, d))
    return r.select("name", "overlap_rowcount", "col_nm", F.concat_ws(",", "key_vals").alias("key_names"),
                    "from_val", "to_val", "col_diff_cnt", "col_diff_pct", "jarowinkler_score",
                    "jarowinkler_similarity", "editdistance", "soundex")


@register("value_similarity", CTE + ",\ndt as (" + _detail_sql(ORD, ORD_COLS, "tie_from", "tie_to") + """)
select distinct from_val, to_val,
       round(jaro_winkler_similarity(from_val, to_val), 4) as jarowinkler_score,
       cast(round(jaro_winkler_similarity(from_val, to_val) * 100) as integer) as jarowinkler_similarity,
       levenshtein(from_val, to_val) as editdistance
  from dt""")
def value_similarity(spark, sf_dir):
    from ledgerline.functions.similarity import edit_distance, jaro_winkler_similarity
    pairs = _tieout(spark, sf_dir, ORD).detail_rows().select("from_val", "to_val").distinct()
    s = jaro_winkler_similarity(F.col("from_val"), F.col("to_val"))
    return pairs.select("from_val", "to_val", F.round(s, 4).alias("jarowinkler_score"),
                        F.round(s * 100).cast("int").alias("jarowinkler_similarity"),
                        edit_distance(F.col("from_val"), F.col("to_val")).alias("editdistance"))


@register("value_soundex", CTE + ",\ndt as (" + _detail_sql(ORD, ORD_COLS, "tie_from", "tie_to") + """),
pv as (select distinct from_val, to_val from dt)
select from_val, to_val, """ + _soundex_sql("from_val") + " as from_soundex, " + _soundex_sql("to_val")
          + " as to_soundex, (" + _soundex_sql("from_val") + ") = (" + _soundex_sql("to_val") + ") as soundex from pv")
def value_soundex(spark, sf_dir):
    """Soundex codes and their equality for the differing value pairs."""
    from ledgerline.functions.similarity import soundex_equal
    pairs = _tieout(spark, sf_dir, ORD).detail_rows().select("from_val", "to_val").distinct()
    return pairs.select("from_val", "to_val", F.soundex("from_val").alias("from_soundex"),
                        F.soundex("to_val").alias("to_soundex"),
                        soundex_equal(F.col("from_val"), F.col("to_val")).alias("soundex"))


# --- one hot key ----------------------------------------------------------------
HOT_COLS = ["l_linestatus", "l_quantity", "l_returnflag"]


def _hot_sql() -> str:
    """Differing pairs per column from per-(key, value) counts (each pair once)."""
    parts = []
    for c in HOT_COLS:
        parts.append(f"""
select 'HOT' as name, '{c}' as col_nm,
       cast(coalesce(sum(kk.m * kk.n - coalesce(eq.e, 0)), 0) as bigint) as col_diff_cnt
  from kk left join (
        select fv.l_orderkey, sum(fv.c * tv.c) as e
          from (select l_orderkey, {c} as v, count(*) as c from hot_from group by 1, 2) fv
          join (select l_orderkey, {c} as v, count(*) as c from hot_to group by 1, 2) tv
            on fv.l_orderkey = tv.l_orderkey and fv.v is not distinct from tv.v
         group by 1) eq on kk.l_orderkey = eq.l_orderkey""")
    return (oracle_cte("hot_from", "hot_to") + """,
kk as (select f.l_orderkey, f.m, t.n
         from (select l_orderkey, count(*) as m from hot_from where l_orderkey is not null group by 1) f
         join (select l_orderkey, count(*) as n from hot_to where l_orderkey is not null group by 1) t
           on f.l_orderkey = t.l_orderkey)""" + "\nunion all".join(parts))


@register("tieout_hot_key_summary", _hot_sql())
def tieout_hot_key_summary(spark, sf_dir):
    """A third of all rows under one key: counted without emitting its pairs."""
    f, t = fixture(spark, sf_dir, "hot_from"), fixture(spark, sf_dir, "hot_to")
    return _int(Tieout(f, t, ["l_orderkey"], name="HOT", multiplicity="pairs").summary)


# --- sinks: written, read back ----------------------------------------------------
# Validation names that look like numbers or dates must stay text in partition folders.
NAMES = ("01", "1", "2024-01-01", "ABC")


def _written(spark, sf_dir, from_name: str, to_name: str):
    """The four stored outputs of one validation run under several names."""
    import uuid

    from ledgerline.session import scratch_path
    from ledgerline.sources.sinks import write_tieout_frames

    f, t = fixture(spark, sf_dir, from_name), fixture(spark, sf_dir, to_name)
    runs = [Tieout(f, t, list(ORD.key), name=n, from_tbl=ORD.from_tbl, to_tbl=ORD.to_tbl, ignore_cols=ORD.ignore_cols)
            for n in NAMES]
    return write_tieout_frames(spark, runs, scratch_path(spark, f"tieout-{uuid.uuid4().hex}"))


def _stamped(df):
    return df.withColumn("stamped", F.col("tieout_dt").isNotNull()).drop("tieout_dt")


_NAMES_SQL = "(select unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) as run) names"


@register("sink_overview", CTE + "," + _overlap_sql(ORD, "tie_from", "tie_to") + f"""
select run as name, 'o_orderkey' as key_names, s.overlap_rowcount, '{ORD.from_tbl}' as from_tbl, s.from_rowcount,
       s.from_unique, '{ORD.to_tbl}' as to_tbl, s.to_rowcount, s.to_unique, true as stamped
  from ({_stats_select(ORD, "tie_from", "tie_to")}) s cross join {_NAMES_SQL}""")
def sink_overview(spark, sf_dir):
    """K1 + K5 + K8: the overview as read back."""
    o = _stamped(_written(spark, sf_dir, "tie_from", "tie_to")["1_OVERVIEW"])
    return o.withColumn("key_names", F.concat_ws(",", "key")).drop("key")


@register("sink_summary", CTE + f"\nselect run as name, s.col_nm, s.col_diff_cnt, true as stamped from ("
          + _summary_sql(ORD, ORD_COLS, "tie_from", "tie_to") + f") s cross join {_NAMES_SQL}")
def sink_summary(spark, sf_dir):
    """K2 + K8: the per-column summary as read back, derived from the stored detail."""
    return _int(_stamped(_written(spark, sf_dir, "tie_from", "tie_to")["2_COLUMNS_SUMMARY"]))


@register("sink_detail", CTE + f"\nselect run as name, s.col_nm, s.from_val, s.to_val, sum(s.diff_cnt)::bigint as diff_cnt from ("
          + _detail_sql(ORD, ORD_COLS, "tie_from", "tie_to") + f") s cross join {_NAMES_SQL} group by all")
def sink_detail(spark, sf_dir):
    """K3: the stored detail, rolled up to value pairs."""
    d = _written(spark, sf_dir, "tie_from", "tie_to")["3_COLUMNS_DETAIL"]
    return _int(d.groupBy("name", "col_nm", "from_val", "to_val").agg(F.sum("diff_cnt").alias("diff_cnt")), "diff_cnt")


@register("sink_skipped", CTE + f"""
select run as name, tbl_nm, col_nm, o.n > 0 as stamped
  from (select '{ORD.from_tbl}' as tbl_nm, column_name as col_nm from (describe tie_from)
         where column_name not in (select column_name from (describe tie_to))
        union all select '{ORD.to_tbl}', column_name from (describe tie_to)
         where column_name not in (select column_name from (describe tie_from))) s
  cross join {_NAMES_SQL} cross join (select count(*) as n from tie_from) o""")
def sink_skipped(spark, sf_dir):
    """K4 + K8."""
    return _stamped(_written(spark, sf_dir, "tie_from", "tie_to")["4_COLUMNS_SKIPPED"])


@register("sink_equal_tables", CTE + f"""
select run as name, c.col_nm, 0::bigint as col_diff_cnt, count(o_orderkey) as overlap_rowcount, 0::bigint as detail_rows
  from tie_from cross join {_NAMES_SQL} cross join (select unnest({[*ORD_COLS, 'from_extra']}) as col_nm) c
 group by run, c.col_nm""")
def sink_equal_tables(spark, sf_dir):
    """Two equal tables: nothing to store in the detail, and every report still there."""
    out = _written(spark, sf_dir, "tie_from", "tie_from")
    o = out["1_OVERVIEW"].select("name", "overlap_rowcount")
    d = out["3_COLUMNS_DETAIL"].groupBy("name").agg(F.count(F.lit(1)).alias("detail_rows"))
    return _int(out["2_COLUMNS_SUMMARY"].join(o, "name").join(d, "name", "left").select(
        "name", "col_nm", "col_diff_cnt", "overlap_rowcount", F.coalesce("detail_rows", F.lit(0)).alias("detail_rows")))


# --- widened types, nested values, hot keys -----------------------------------------
TYPE_CTE = oracle_cte("typed_from", "typed_to")
TYPED_COLS = ["a_int", "b_dec", "c_date", "d_map", "e_text"]


@register("tieout_widened_types", TYPE_CTE + "\n" + "\nunion all\n".join(
    f"select 'TYPED' as name, '{c}' as col_nm, count(*) as col_diff_cnt from typed_from f join typed_to t using (o_orderkey) "
    f"where f.{c} is distinct from {'t.d_map' if c == 'd_map' else 't.' + c}" for c in TYPED_COLS))
def tieout_widened_types(spark, sf_dir):
    """int against double, decimals of two scales, a date against a timestamp, maps."""
    f, t = fixture(spark, sf_dir, "typed_from"), fixture(spark, sf_dir, "typed_to")
    return _int(Tieout(f, t, ["o_orderkey"], name="TYPED").summary)


_HOT_REF = _hot_sql().replace("cast(coalesce(sum(kk.m * kk.n - coalesce(eq.e, 0)), 0) as bigint)",
                              "cast(coalesce(sum(kk.m::hugeint * kk.n * (kk.m::hugeint * kk.n - coalesce(eq.e, 0))), 0) as bigint)")


@register("tieout_hot_key_reference", _HOT_REF)
def tieout_hot_key_reference(spark, sf_dir):
    """The hot key with the default multiplicity: every differing pair m*n times."""
    f, t = fixture(spark, sf_dir, "hot_from"), fixture(spark, sf_dir, "hot_to")
    s = Tieout(f, t, ["l_orderkey"], name="HOT").summary
    return s.withColumn("col_diff_cnt", F.expr("try_cast(col_diff_cnt as bigint)"))


@register("tieout_value_counts", oracle_cte("hot_from", "hot_to") + """,
both_keys as (select l_orderkey from hot_from where l_orderkey is not null intersect select l_orderkey from hot_to)"""
          + "\n" + "\nunion all\n".join(f"""
select coalesce(f.l_orderkey, t.l_orderkey) as l_orderkey, '{c}' as col_nm, coalesce(f.v, t.v) as value,
       coalesce(f.n, 0) as from_cnt, coalesce(t.n, 0) as to_cnt
  from (select l_orderkey, cast({c} as varchar) as v, count(*) as n from hot_from semi join both_keys using (l_orderkey) group by 1, 2) f
  full join (select l_orderkey, cast({c} as varchar) as v, count(*) as n from hot_to semi join both_keys using (l_orderkey) group by 1, 2) t
    on f.l_orderkey = t.l_orderkey and f.v is not distinct from t.v
 where coalesce(f.n, 0) <> coalesce(t.n, 0)""" for c in ("l_linestatus", "l_returnflag")))
def tieout_value_counts(spark, sf_dir):
    """T15 without pairs: per value its rows on both sides, where they differ."""
    f, t = (fixture(spark, sf_dir, n).drop("l_quantity") for n in ("hot_from", "hot_to"))
    return Tieout(f, t, ["l_orderkey"], name="HOT").value_counts()


# --- the YAML target, published outputs, awkward key names ----------------------------
@register("tieout_yaml_target", _OVERVIEW_CTE + _SUM_COLUMN_SQL)
def tieout_yaml_target(spark, sf_dir):
    """S15 + T18 + K5: the target of a YAML file, and the column report as read back
    from the outputs published last."""
    import os
    import uuid

    from ledgerline import jobs
    from ledgerline.session import scratch_path
    from ledgerline.sources.sinks import current_outputs

    root = scratch_path(spark, f"target-{uuid.uuid4().hex}")
    spec = os.path.join(os.path.dirname(__file__), "sample_validations.yaml")
    jobs.tieout_from_yaml(spark, [spec], "SAMPLE", _tables(spark, sf_dir), root)
    return _int(current_outputs(spark, f"{root}/TIEOUT_SAMPLE")["6_SUM_COLUMN"])


_AWKWARD = oracle_cte("tie_from", "tie_to") + """,
f as (select o_orderkey as from_cnt, o_custkey as to_cnt, o_orderstatus as name from tie_from),
t as (select o_orderkey as from_cnt, o_custkey as to_cnt, o_orderstatus as name from tie_to)"""


@register("tieout_awkward_names", _AWKWARD + """
select 'from_rowcount' as what, count(*) as n from f where from_cnt is not null
union all select 'to_rowcount', count(*) from t where from_cnt is not null
union all select 'overlap_rowcount', count(*) from (select from_cnt from f intersect select from_cnt from t) where from_cnt is not null
union all select 'to_cnt', count(*) from f join t using (from_cnt) where f.to_cnt is distinct from t.to_cnt
union all select 'name', count(*) from f join t using (from_cnt) where f.name is distinct from t.name""")
def tieout_awkward_names(spark, sf_dir):
    """T4: the key column is called from_cnt, a compared one to_cnt."""
    f, t = (fixture(spark, sf_dir, n).select(
        F.col("o_orderkey").alias("from_cnt"), F.col("o_custkey").alias("to_cnt"), F.col("o_orderstatus").alias("name"))
        for n in ("tie_from", "tie_to"))
    tie = Tieout(f, t, ["from_cnt"], name="K")
    stats = tie.key_stats.unpivot([], ["from_rowcount", "to_rowcount", "overlap_rowcount"], "what", "n")
    return stats.unionByName(_int(tie.summary).select(F.col("col_nm").alias("what"), F.col("col_diff_cnt").alias("n")))


# Numbers no one type holds without loss: bigints around 2^53 against doubles, and
# decimals that need 58 digits together. Integers 2^53 + 1 and + 3 are no doubles.
@register("tieout_exact_numbers", """
select 'NUM' as name, 'big' as col_nm, count(*) filter (o_orderkey % 4 in (1, 3)) as col_diff_cnt from orders
union all select 'NUM', 'wide', count(*) filter (o_orderkey % 3 = 0) from orders
union all select 'NUM', 'part', count(*) filter (o_orderkey is null) from orders""")
def tieout_exact_numbers(spark, sf_dir):
    """2^53 + 1 is not the double 2^53, a last digit beyond 38 counts, and
    numbers both types hold are equal."""
    from ledgerline.sources.tables import read_table

    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    key, big = F.col("o_orderkey"), F.lit(1 << 53) + F.col("o_orderkey") % 4
    last = F.when(key % 3 == 0, F.lit("." + "0" * 19 + "1")).otherwise(F.lit(".0"))
    f = o.select(key, big.alias("big"), key.cast("decimal(38,0)").alias("wide"),
                 (key.cast("decimal(20,3)") / 8).cast("decimal(20,3)").alias("part"))
    t = o.select(key, big.cast("double").alias("big"),
                 F.concat(key.cast("string"), last).cast("decimal(38,20)").alias("wide"), (key.cast("double") / 8).alias("part"))
    return _int(Tieout(f, t, ["o_orderkey"], name="NUM").summary)
