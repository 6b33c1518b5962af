"""Table tie-out: compare two tables by key, by column and by value.

Plan shape (per validation):

* **key profile** — keys of both sides, tagged, unioned and grouped once:
  ``(key, from_cnt, to_cnt)``. Partial aggregation runs map-side, so a hot key
  collapses before the shuffle. Duplicate keys, row counts, one-sided keys and
  the overlap all come from this one frame.
* **rows meet their key's counts** — each side's rows are exchanged once, on the
  key, and joined with the profile. Heavy keys (more than 1/HEAVY_SHARE of all
  shared rows, so at most HEAVY_SHARE of them) are found from the profile and
  broadcast; only their rows are dealt over salts, as many as the key's size
  asks for, and only their profile rows are repeated. Every other key is joined
  plainly, without a copy.
* **small keys** (``m`` from-rows times ``n`` to-rows at most ``pair_limit``, the
  unique ones among them) — the two sides, already partitioned by key, are joined
  and every shared column is compared in that pass. The reference re-joins both
  tables once per column.
* **large keys** — never expanded into row pairs: unpivoted and counted per (key,
  column, value), partial counts leaving each task before the exchange on all
  three. With per-value counts ``cF(v)``, ``cT(v)`` the differing pairs of a key
  are ``m*n - sum_v cF(v)*cT(v)``. The reference counts every differing pair
  ``m*n`` times (its shared-key CTE is not distinct); ``multiplicity='reference'``
  keeps that, ``'pairs'`` counts once. Weights of large keys are decimals: four
  factors of a hot key exceed a BIGINT.
* **stored keys** — jobs that write results count the keys once (``store_keys``) and
  ask whether any key is large. If none is, no salts and no counts are needed and the
  to side's rows join the from side's plainly.
* **detail** — one row per distinct differing value pair of a key, its
  multiplicity in ``diff_cnt``. ``value_counts`` is the form for columns with
  many values under one key: per value its counts on both sides, no pairs.

A column pair is compared in one form everywhere: typed, in the common type of
both sides, maps as sorted entries; as text only where there is no common type.
Helper columns carry the prefix ``__tie_``, so key and value columns may have
any other name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerline.functions.compare import (JSON_OPTIONS, as_json, as_text, common_type, compare_type, compare_value,
                                          differs, has_map)

MULTIPLICITIES = ("reference", "pairs")
HEAVY_SHARE = 1024  # a key with more than this part of all shared rows is dealt over salts
PAIR_LIMIT = 64  # keys with at most so many row pairs are compared pair by pair
VALUES_PER_SALT = 4096  # values of a key and column that one task pairs with the other side's
WEIGHT = "decimal(38,0)"
REPEAT = 10_000  # rows one explode adds when detail rows are repeated


def column(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Validation:
    """One entry of a validation spec (NAME, KEY, FROM_TBL, TO_TBL, IGNORE_COLS)."""

    name: str
    key: tuple[str, ...]
    from_tbl: str
    to_tbl: str
    ignore_cols: tuple[str, ...] = field(default_factory=tuple)


def _resolve(df: DataFrame, names: Iterable[str], what: str) -> list[str]:
    """Map requested column names to the frame's spelling, case-insensitively."""
    by_lower = {c.lower(): c for c in df.columns}
    out = []
    for n in names:
        if n.lower() not in by_lower:
            raise ValueError(f"{what}: column {n!r} not found in {df.columns}")
        out.append(by_lower[n.lower()])
    return out


def _all_not_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [column(c).isNotNull() for c in cols])


def key_profile(from_df: DataFrame, to_df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key..., from_cnt, to_cnt)`` for every key value seen on either side.

    NULL key parts group together (null-safe), as GROUP BY and set operations do.
    """
    keys = [column(k) for k in key]
    names = _key_names(key)
    p = _profile(*[df.select(*[k.alias(n) for k, n in zip(keys, names)]) for df in (from_df, to_df)], names)
    return p.select(*[F.col(n).alias(k) for n, k in zip(names, key)],
                    F.col("__tie_m").alias("from_cnt"), F.col("__tie_n").alias("to_cnt"))


def _key_names(key: Sequence[str]) -> list[str]:
    return [f"__tie_k{i}" for i in range(len(key))]


def _profile(f: DataFrame, t: DataFrame, names: list[str]) -> DataFrame:
    """Row counts __tie_m, __tie_n of every value of the columns ``names``."""
    both = f.withColumns({"__tie_m": F.lit(1), "__tie_n": F.lit(0)}).unionByName(
        t.withColumns({"__tie_m": F.lit(0), "__tie_n": F.lit(1)}))
    return both.groupBy(*names).agg(*[F.sum(n).cast("bigint").alias(n) for n in ("__tie_m", "__tie_n")])


def column_reconciliation(from_cols: Sequence[str], to_cols: Sequence[str],
                          key: Sequence[str], ignore_cols: Sequence[str] = ()) -> list[tuple[str, str]]:
    """``[(source, column)]`` with source FROM / TO / BOTH, ordered by column name.

    Key and ignored columns are left out (matched case-insensitively). Runs on
    schema metadata only, which is driver-sized by nature.
    """
    skip = {c.lower() for c in list(ignore_cols) + list(key)}
    f = {c.lower(): c for c in from_cols if c.lower() not in skip}
    t = {c.lower(): c for c in to_cols if c.lower() not in skip}
    rows = []
    for low in sorted(set(f) | set(t)):
        if low in f and low in t:
            rows.append(("BOTH", f[low]))
        elif low in f:
            rows.append(("FROM", f[low]))
        else:
            rows.append(("TO", t[low]))
    return sorted(rows, key=lambda r: r[1])


def reconcile_columns(columns: DataFrame, from_schema: str, to_schema: str) -> DataFrame:
    """S3 + T6 + T7 over a column catalog ``(table_schema, table_name, column_name)``:
    for every table present in both schemas, each column with its source (FROM, TO,
    BOTH), matched case-insensitively, and the schema that owns a one-sided one."""
    def of(schema: str, side: str) -> DataFrame:
        return columns.where(F.col("table_schema") == schema).groupBy(
            "table_name", F.lower("column_name").alias("low")).agg(F.min("column_name").alias(side))

    f, t = of(from_schema, "f"), of(to_schema, "t")
    tables = f.select("table_name").distinct().join(t.select("table_name").distinct(), "table_name", "left_semi")
    both = f.join(t, ["table_name", "low"], "full_outer").join(tables, "table_name", "left_semi")
    source = F.when(F.col("t").isNull(), "FROM").when(F.col("f").isNull(), "TO").otherwise("BOTH")
    owner = F.when(F.col("t").isNull(), from_schema).when(F.col("f").isNull(), to_schema)
    return both.select("table_name", F.coalesce("f", "t").alias("col_nm"), source.alias("source"), owner.alias("owner"))


class Tieout:
    """Lazily built tie-out of two DataFrames; every attribute is a DataFrame.

    ``pair_limit`` is the number of row pairs up to which a key is compared pair
    by pair; it changes the work, not the result. A key column whose types have
    no common type is compared as text, as other columns are.
    """

    def __init__(self, from_df: DataFrame, to_df: DataFrame, key: Sequence[str], *,
                 name: str = "TIEOUT", from_tbl: str = "FROM", to_tbl: str = "TO",
                 ignore_cols: Sequence[str] = (), case_insensitive: bool = False,
                 null_as_blank: bool = False, multiplicity: str = "reference", pair_limit: int = PAIR_LIMIT):
        if not key:
            raise ValueError("a tie-out needs at least one key column")
        if multiplicity not in MULTIPLICITIES:
            raise ValueError(f"multiplicity must be one of {MULTIPLICITIES}")
        self.name, self.from_tbl, self.to_tbl = name, from_tbl, to_tbl
        self.case_insensitive, self.null_as_blank = case_insensitive, null_as_blank
        self.multiplicity, self.pair_limit = multiplicity, pair_limit
        fkey = _resolve(from_df, key, f"{name} from-table key")
        tkey = _resolve(to_df, key, f"{name} to-table key")
        # Canonical spelling = from side; rename the to side's key to match.
        for fk, tk in zip(fkey, tkey):
            if fk != tk:
                to_df = to_df.withColumnRenamed(tk, fk)
            kinds = [df.select(column(fk)).schema[0].dataType for df in (from_df, to_df)]
            if common_type(from_df, *kinds) is None:
                from_df, to_df = (df.withColumn(fk, as_text(column(fk), kind)) for df, kind in zip((from_df, to_df), kinds))
        self.key = fkey
        self.columns = column_reconciliation(from_df.columns, to_df.columns, fkey, ignore_cols)
        self.shared = [c for s, c in self.columns if s == "BOTH"]
        tmap = {c.lower(): c for c in to_df.columns}
        self._to_name = {c: tmap[c.lower()] for c in self.shared}
        self.from_df, self.to_df = from_df, to_df
        self._k = _key_names(fkey)
        self._counted = None
        self._large = True  # whether keys of more than pair_limit pairs may exist
        ft = {f.name: f.dataType for f in from_df.schema.fields}
        tt = {f.name: f.dataType for f in to_df.schema.fields}
        self._types = [(ft[c], tt[self._to_name[c]]) for c in self.shared]
        self._common = [common_type(from_df, a, b) for a, b in self._types]

    # -- keys ---------------------------------------------------------------
    @property
    def profile(self) -> DataFrame:
        return key_profile(self.from_df, self.to_df, self.key)

    def _all_keys(self) -> DataFrame:
        """The profile under helper names: __tie_k0.., __tie_m, __tie_n."""
        if self._counted is None:
            sides = [df.select(*[column(n).alias(k) for n, k in zip(self.key, self._k)]) for df in (self.from_df, self.to_df)]
            self._counted = _profile(*sides, self._k)
        return self._counted

    def store_keys(self, path: str) -> "Tieout":
        """Write the key counts to ``path``, once for all outputs, and ask them whether
        any shared key is large: what has nothing to do is then left out of the plans."""
        p = self._all_keys()
        if any("void" in f.dataType.simpleString() for f in p.schema.fields):
            return self  # no table holds such a column
        p.write.parquet(path)
        self._counted = p.sparkSession.read.schema(p.schema).parquet(path)
        large = self._shared().agg(F.max(~self._small())).first()[0]
        self._large = bool(large)
        return self

    @property
    def key_stats(self) -> DataFrame:
        """One row: row counts, one-sided keys, overlap, duplicate-key counts."""
        nn, f, t = F.col("__tie_nn"), F.col("__tie_m"), F.col("__tie_n")
        p = self._all_keys().select(_all_not_null(self._k).alias("__tie_nn"), f, t)
        return p.agg(
            F.coalesce(F.sum(F.when(nn, f)), F.lit(0)).cast("bigint").alias("from_rowcount"),
            F.coalesce(F.sum(F.when(nn, t)), F.lit(0)).cast("bigint").alias("to_rowcount"),
            F.count(F.when(nn & (f > 0) & (t == 0), 1)).cast("bigint").alias("from_unique"),
            F.count(F.when(nn & (t > 0) & (f == 0), 1)).cast("bigint").alias("to_unique"),
            F.count(F.when(nn & (f > 0) & (t > 0), 1)).cast("bigint").alias("overlap_rowcount"),
            F.count(F.when(f > 1, 1)).cast("bigint").alias("from_dup_keys"),
            F.count(F.when(t > 1, 1)).cast("bigint").alias("to_dup_keys"),
        )

    @property
    def duplicate_keys(self) -> DataFrame:
        """Number of key values with more than one row, per side (NULL key counts)."""
        return self.key_stats.select(F.lit(self.name).alias("name"), "from_dup_keys", "to_dup_keys")

    @property
    def overview(self) -> DataFrame:
        """K1 row: name, key names, overlap, per-side table, row count and one-sided keys."""
        return self.key_stats.select(
            F.lit(self.name).alias("name"),
            F.array(*[F.lit(k) for k in self.key]).alias("key"),
            "overlap_rowcount",
            F.lit(self.from_tbl).alias("from_tbl"), "from_rowcount", "from_unique",
            F.lit(self.to_tbl).alias("to_tbl"), "to_rowcount", "to_unique",
        )

    # -- columns ------------------------------------------------------------
    def skipped(self, spark=None) -> DataFrame:
        """K4 rows: one-sided columns with the table that owns them."""
        spark = spark or self.from_df.sparkSession
        rows = [(self.name, self.from_tbl if s == "FROM" else self.to_tbl, c)
                for s, c in self.columns if s != "BOTH"]
        schema = StructType([StructField("name", StringType(), False),
                             StructField("tbl_nm", StringType(), False),
                             StructField("col_nm", StringType(), False)])
        return spark.createDataFrame(rows, schema)

    # -- rows ---------------------------------------------------------------
    def _rows(self, side: str) -> DataFrame:
        """One side's rows with a complete key: __tie_k0.., __tie_v0..."""
        df = self.from_df if side == "f" else self.to_df
        names = self.shared if side == "f" else [self._to_name[c] for c in self.shared]
        rows = df.select(*[column(n).alias(k) for n, k in zip(self.key, self._k)],
                         *[column(n).alias(f"__tie_v{i}") for i, n in enumerate(names)])
        return rows.where(_all_not_null(self._k))

    def _dtype(self, side: str, i: int):
        return self._types[i][0 if side == "f" else 1]

    def _cmp(self, side: str, i: int, value: Column) -> Column:
        return compare_value(value, self._dtype(side, i), self._common[i], self.case_insensitive, self.null_as_blank)

    def _shared(self) -> DataFrame:
        """(key, __tie_m, __tie_n) of the keys on both sides."""
        return self._all_keys().where(_all_not_null(self._k)).where("__tie_m > 0 and __tie_n > 0")

    def _shared_keys(self) -> DataFrame:
        """The same with __tie_salts."""
        rows = F.col("__tie_m") + F.col("__tie_n")
        p = self._shared()
        # Keys up to pair_limit never have salts, so pairs meet in one place.
        share = p.agg(F.greatest(F.sum(rows) / HEAVY_SHARE, F.lit(float(self.pair_limit + 1)))).scalar()
        return p.withColumn("__tie_salts", F.ceil(rows / share).cast("int"))

    def _keyed_rows(self, side: str) -> DataFrame:
        """One side's rows with their key's counts: __tie_k.., __tie_salt, __tie_v.., __tie_m, __tie_n."""
        if not self._large:
            return self._rows(side).join(self._shared().hint("merge"), self._k).withColumn("__tie_salt", F.lit(0))
        keys = self._shared_keys()
        heavy = F.broadcast(keys.where("__tie_salts > 1").select(*self._k, "__tie_salts"))  # at most HEAVY_SHARE
        # The salt is the row's own hash and its partition, the same on a retry.
        values = [F.col(f"__tie_v{i}") for i in range(len(self.shared)) if not _hashless(self._dtype(side, i))]
        own = F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.col("__tie_salts")).cast("int")
        dealt = self._rows(side).join(heavy, self._k, "left").withColumn(
            "__tie_salt", F.coalesce(own, F.lit(0))).drop("__tie_salts")
        spread = keys.withColumn("__tie_salt", F.explode(F.sequence(F.lit(0), F.col("__tie_salts") - 1))).drop("__tie_salts")
        return dealt.join(spread, [*self._k, "__tie_salt"])

    def _small(self) -> Column:
        return F.col("__tie_m") <= F.lit(float(self.pair_limit)) / F.col("__tie_n")

    def _row_pairs(self) -> DataFrame:
        """Every pair of rows of the small keys: both rows as structs __tie_f, __tie_t,
        and __tie_w, how often the pair counts."""
        values = F.struct(*[F.col(f"__tie_v{i}") for i in range(len(self.shared))])
        weight = F.col("__tie_m") * F.col("__tie_n") if self.multiplicity == "reference" else F.lit(1).cast("bigint")
        if not self._large:
            return (self._keyed_rows("f").select(*self._k, "__tie_salt", values.alias("__tie_f"), weight.alias("__tie_w"))
                    .join(self._rows("t").select(*self._k, values.alias("__tie_t")), self._k))
        f = self._keyed_rows("f").where(self._small()).select(*self._k, "__tie_salt", values.alias("__tie_f"), weight.alias("__tie_w"))
        t = self._keyed_rows("t").where(self._small()).select(*self._k, "__tie_salt", values.alias("__tie_t"))
        return f.join(t, [*self._k, "__tie_salt"])

    def _pair_flags(self) -> list[Column]:
        return [differs(self._cmp("f", i, F.col(f"__tie_f.__tie_v{i}")), self._cmp("t", i, F.col(f"__tie_t.__tie_v{i}")))
                for i in range(len(self.shared))]

    def _slots(self) -> list[tuple[str, object]]:
        """The distinct types columns are compared in, a helper column for each."""
        kinds = {}
        for i in range(len(self.shared)):
            t = self._slot_type(i)
            kinds.setdefault(t.simpleString(), t)
        return [(f"__tie_c{n}", t) for n, t in enumerate(kinds.values())]

    def _slot_type(self, i: int):
        t = compare_type(self._common[i], self.case_insensitive, self.null_as_blank)
        if t is None:
            return StringType()
        if not has_map(t):
            return t
        # What comparable() makes of the type: maps become sorted entries.
        value = self._rows("f").select(self._cmp("f", i, F.col(f"__tie_v{i}")))
        return value.schema[0].dataType

    def _counts(self, side: str, with_raw: bool, only_large: bool = True) -> DataFrame:
        """Counts per (key, column, value) of one side: key, __tie_i, the value in
        the slot of its type, [text and JSON form], __tie_c, __tie_m, __tie_n; of
        the large keys or of all shared ones."""
        slots = self._slots()
        items = []
        for i in range(len(self.shared)):
            v, own = F.col(f"__tie_v{i}"), self._slot_type(i).simpleString()
            fields = [F.lit(i).alias("__tie_i")]
            fields += [(self._cmp(side, i, v) if t.simpleString() == own else F.lit(None)).cast(t).alias(n) for n, t in slots]
            if with_raw:
                fields += [as_text(v, self._dtype(side, i)).alias("__tie_raw"), as_json(v).alias("__tie_js")]
            items.append(F.struct(*fields))
        rows = self._keyed_rows(side)
        if only_large:
            rows = rows.where(~self._small())
        rows = rows.select(*self._k, "__tie_m", "__tie_n", F.explode(F.array(*items)).alias("__tie_x"))
        group = [*self._k, "__tie_i", *[n for n, _ in slots]] + (["__tie_raw", "__tie_js"] if with_raw else [])
        return (rows.select(*self._k, "__tie_m", "__tie_n", "__tie_x.*").groupBy(*group)
                .agg(F.count(F.lit(1)).alias("__tie_c"), F.max("__tie_m").alias("__tie_m"),
                     F.max("__tie_n").alias("__tie_n")))

    def _weight(self, m: Column, n: Column) -> Column:
        if self.multiplicity == "reference":
            return _big(m) * _big(n)
        return F.lit(1).cast("decimal(1,0)")

    def _same_value(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n, _ in self._slots()])

    def _same_key(self) -> list[Column]:
        return [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*self._k, "__tie_i"]]

    # -- per-column summary -----------------------------------------------
    def _columns_frame(self) -> DataFrame:
        spark = self.from_df.sparkSession
        idx_schema = StructType([StructField("idx", LongType(), False),
                                 StructField("col_nm", StringType(), False)])
        return spark.createDataFrame([(i, c) for i, c in enumerate(self.shared)], idx_schema)

    @property
    def summary(self) -> DataFrame:
        """K2: one row per shared column, also when it has no differences.

        Count-only path: never builds detail rows or row pairs.
        """
        cols = self._columns_frame()
        if not self.shared:
            return cols.select(F.lit(self.name).alias("name"), "col_nm", F.lit(0).cast(WEIGHT).alias("col_diff_cnt"))
        wide = self._row_pairs().agg(*[F.sum(F.when(d, F.col("__tie_w"))).alias(f"d{i}")
                                       for i, d in enumerate(self._pair_flags())])
        small = wide.select(F.explode(F.array(*[
            F.struct(F.lit(i).cast("bigint").alias("idx"), F.col(f"d{i}").alias("n"))
            for i in range(len(self.shared))])).alias("x")).select("x.idx", "x.n")
        if not self._large:
            return cols.join(small, "idx", "left").select(
                F.lit(self.name).alias("name"), "col_nm", F.coalesce(F.col("n").cast(WEIGHT), F.lit(0)).cast(WEIGHT).alias("col_diff_cnt"))

        # Differing pairs = m*n - sum_v cF(v)*cT(v) per key and column. Since
        # sum_v cF(v) = m, the from-side counts left-joined to the to-side counts
        # give both terms in one aggregate: sum(w*cF*(n - cT)).
        fv = self._counts("f", with_raw=False).alias("a")
        tv = self._counts("t", with_raw=False).alias("b")
        missing = F.col("a.__tie_n") - F.coalesce(F.col("b.__tie_c"), F.lit(0))
        pairs = _big(F.col("a.__tie_c")) * _big(missing)
        large = (fv.join(tv, [*self._same_key(), self._same_value()], "left")
                 .groupBy(F.col("a.__tie_i").cast("bigint").alias("idx"))
                 .agg(F.sum((self._weight(F.col("a.__tie_m"), F.col("a.__tie_n")) * pairs).cast(WEIGHT)).alias("dn")))
        return (cols.join(small, "idx", "left").join(large, "idx", "left")
                .select(F.lit(self.name).alias("name"), "col_nm",
                        (F.coalesce(F.col("n").cast(WEIGHT), F.lit(0)) + F.coalesce(F.col("dn"), F.lit(0)))
                        .cast(WEIGHT).alias("col_diff_cnt")))

    def summary_from_detail(self, detail: DataFrame) -> DataFrame:
        """K2 derived from already written K3 rows (sum of diff_cnt per column)."""
        per = detail.groupBy("col_nm").agg(F.sum("diff_cnt").alias("n"))
        return (self._columns_frame().join(per, "col_nm", "left")
                .select(F.lit(self.name).alias("name"), "col_nm",
                        F.coalesce(F.col("n"), F.lit(0)).cast(WEIGHT).alias("col_diff_cnt")))

    # -- per-value detail ---------------------------------------------------
    def _differences(self) -> DataFrame:
        """Every differing value pair: __tie_k.., col_nm, from and to value as text
        and as JSON, diff_cnt."""
        flags = self._pair_flags()
        items = []
        for i, c in enumerate(self.shared):
            f, t = F.col(f"__tie_f.__tie_v{i}"), F.col(f"__tie_t.__tie_v{i}")
            # Only values that differ are written out as text and JSON.
            items.append(F.when(flags[i], F.struct(
                F.lit(c).alias("col_nm"), as_text(f, self._types[i][0]).alias("from_val"),
                as_text(t, self._types[i][1]).alias("to_val"), as_json(f).alias("__tie_fj"),
                as_json(t).alias("__tie_tj"))))
        same = [*self._k, "col_nm", "from_val", "to_val", "__tie_fj", "__tie_tj"]
        # Pairs lie where their key lies: summing equal ones moves nothing.
        small = (self._row_pairs().where(reduce(lambda a, b: a | b, flags))
                 .select(*self._k, "__tie_salt", "__tie_w", F.explode(F.array(*items)).alias("x")).where("x is not null")
                 .select(*self._k, "__tie_salt", "__tie_w", "x.col_nm", "x.from_val", "x.to_val", "x.__tie_fj", "x.__tie_tj")
                 .groupBy("__tie_salt", *same).agg(F.sum("__tie_w").cast(WEIGHT).alias("diff_cnt")).drop("__tie_salt"))
        if not self._large:
            return small
        # A key with many values on the from side is shared by as many tasks as they fill.
        salts = F.ceil(F.col("__tie_m") / VALUES_PER_SALT).cast("int")
        fl = self._counts("f", with_raw=True).withColumn("__tie_salt", F.pmod(F.xxhash64("__tie_raw"), salts).cast("int")).alias("a")
        tl = self._counts("t", with_raw=True).withColumn("__tie_salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("b")
        names = F.array(*[F.lit(c) for c in self.shared])
        counts = _big(F.col("a.__tie_c")) * _big(F.col("b.__tie_c"))
        large = (fl.join(tl, [*self._same_key(), F.col("a.__tie_salt") == F.col("b.__tie_salt"), ~self._same_value()])
                 .select(*[F.col(f"a.{k}").alias(k) for k in self._k],
                         F.element_at(names, F.col("a.__tie_i") + 1).alias("col_nm"),
                         F.col("a.__tie_raw").alias("from_val"), F.col("b.__tie_raw").alias("to_val"),
                         F.col("a.__tie_js").alias("__tie_fj"), F.col("b.__tie_js").alias("__tie_tj"),
                         (self._weight(F.col("a.__tie_m"), F.col("a.__tie_n")) * counts).cast(WEIGHT).alias("diff_cnt")))
        return small.unionByName(large)

    def _named_keys(self) -> list[Column]:
        return [F.col(k).alias(n) for n, k in zip(self.key, self._k)]

    def detail_rows(self) -> DataFrame:
        """``(key..., col_nm, from_val, to_val, diff_cnt)`` for every differing pair.

        Values are the raw values (as text), also when compared case-insensitively
        or with NULL as blank. ``diff_cnt`` is how many detail rows the reference
        would repeat for this value pair.
        """
        if not self.shared:
            return self._no_rows([("col_nm", "string"), ("from_val", "string"), ("to_val", "string"), ("diff_cnt", WEIGHT)])
        return self._differences().select(*self._named_keys(), "col_nm", "from_val", "to_val", "diff_cnt")

    def value_counts(self) -> DataFrame:
        """``(key..., col_nm, value, from_cnt, to_cnt)`` for every value whose number
        of rows differs between the sides, for all shared keys: rows grow with the
        values of a key, not with their pairs."""
        if not self.shared:
            return self._no_rows([("col_nm", "string"), ("value", "string"), ("from_cnt", "bigint"), ("to_cnt", "bigint")])

        def side(s: str) -> DataFrame:
            group = [*self._k, "__tie_i", *[n for n, _ in self._slots()]]
            return self._counts(s, with_raw=True, only_large=False).groupBy(*group).agg(
                F.min("__tie_raw").alias("__tie_raw"), F.sum("__tie_c").alias("__tie_c"))

        fl, tl = side("f").alias("a"), side("t").alias("b")
        both = fl.join(tl, [*self._same_key(), self._same_value()], "full_outer")
        f, t = (F.coalesce(F.col(f"{x}.__tie_c"), F.lit(0)).cast("bigint") for x in "ab")
        names = F.array(*[F.lit(c) for c in self.shared])
        return both.where(f != t).select(
            *[F.coalesce(f"a.{k}", f"b.{k}").alias(n) for n, k in zip(self.key, self._k)],
            F.element_at(names, F.coalesce("a.__tie_i", "b.__tie_i") + 1).alias("col_nm"),
            F.coalesce("a.__tie_raw", "b.__tie_raw").alias("value"), f.alias("from_cnt"), t.alias("to_cnt"))

    def _no_rows(self, extra) -> DataFrame:
        types = {f.name: f.dataType for f in self.from_df.schema.fields}
        schema = StructType([StructField(k, types[k]) for k in self.key])
        for n, t in extra:
            schema = schema.add(n, t)
        return self.from_df.sparkSession.createDataFrame([], schema)

    def detail(self, expand: bool = False) -> DataFrame:
        """K3 rows: name, col_nm, key_vals (key *names*), data_vals JSON, values, count.

        ``data_vals`` keeps NULLs and types: ``{"k": 1, "__to_val": null, "__from_val": "A"}``.
        ``expand=True`` repeats each row ``diff_cnt`` times like the reference.
        """
        if not self.shared:
            rows = self._no_rows([]).select(*[column(n).alias(k) for n, k in zip(self.key, self._k)], *[
                F.lit(None).cast(t).alias(n) for n, t in (
                    ("col_nm", "string"), ("from_val", "string"), ("to_val", "string"), ("__tie_fj", "string"),
                    ("__tie_tj", "string"), ("diff_cnt", WEIGHT))])
        else:
            rows = self._differences()
        keys = F.to_json(F.struct(*self._named_keys()), JSON_OPTIONS)
        doc = F.concat(F.substring(keys, F.lit(1), F.length(keys) - 1), F.lit(',"__to_val":'), F.col("__tie_tj"),
                       F.lit(',"__from_val":'), F.col("__tie_fj"), F.lit("}"))
        out = rows.select(F.lit(self.name).alias("name"), "col_nm", F.array(*[F.lit(k) for k in self.key]).alias("key_vals"),
                          doc.alias("data_vals"), "from_val", "to_val", "diff_cnt")
        if expand:
            # In two steps, so that no array grows with the square of a key's rows.
            blocks = F.ceil(F.col("diff_cnt") / REPEAT).cast("bigint")
            out = out.withColumn("__tie_b", F.explode(F.sequence(F.lit(1).cast("bigint"), blocks)))
            left = F.least(F.lit(REPEAT).cast(WEIGHT), F.col("diff_cnt") - (F.col("__tie_b") - 1) * REPEAT).cast("bigint")
            out = (out.withColumn("__tie_r", F.explode(F.sequence(F.lit(1).cast("bigint"), left)))
                   .drop("__tie_b", "__tie_r").withColumn("diff_cnt", F.lit(1).cast(WEIGHT)))
        return out


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _hashless(dtype) -> bool:
    return "map<" in dtype.simpleString() or "variant" in dtype.simpleString()


def run_validations(spark, tables: dict[str, DataFrame], validations: Sequence[Validation],
                    **options) -> dict[str, DataFrame]:
    """All validations of one target, each output unioned across them.

    ``tables`` maps table names used in the spec to DataFrames. Returns the four
    stored outputs (overview, summary, detail, skipped), each one DataFrame.
    """
    if not validations:
        raise ValueError("no validations given")
    outs = {"overview": [], "summary": [], "detail": [], "skipped": []}
    for v in validations:
        for tbl in (v.from_tbl, v.to_tbl):
            if tbl not in tables:
                raise ValueError(f"{v.name}: table {tbl!r} not provided; known: {sorted(tables)}")
        t = Tieout(tables[v.from_tbl], tables[v.to_tbl], list(v.key), name=v.name,
                   from_tbl=v.from_tbl, to_tbl=v.to_tbl, ignore_cols=v.ignore_cols, **options)
        outs["overview"].append(t.overview)
        outs["summary"].append(t.summary)
        outs["detail"].append(t.detail())
        outs["skipped"].append(t.skipped(spark))
    return {k: reduce(lambda a, b: a.unionByName(b), v) for k, v in outs.items()}
