"""Identifier checks as Column expressions (JVM regex, no Python per row).

Identifiers are unquoted (``[A-Za-z_][A-Za-z0-9_$]{0,254}``, compared
upper-cased) or quoted (``"..."`` with inner quotes doubled).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns.
UNQUOTED = r"[A-Za-z_][A-Za-z0-9_$]{0,254}"
QUOTED_PRINTABLE = r'"[\x20-\x7E]{1,253}"'
NAME = f"(?:{UNQUOTED})|(?:{QUOTED_PRINTABLE})"
SCHEMA = f"(?:(?:{NAME})\\.)?(?:{NAME})"


def _full(c: Column, pattern: str) -> Column:
    return c.rlike(f"\\A(?:{pattern})\\z")


def _count(c: Column, sub: str) -> Column:
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def is_unquoted_name(c: Column) -> Column:
    """No quote, 1-255 characters, the whole string matches UNQUOTED."""
    return F.coalesce(~c.contains('"') & _full(c, UNQUOTED), F.lit(False))


def is_quoted_name(c: Column) -> Column:
    """Starts and ends with a quote, inner quotes come in adjacent pairs;
    3-255 characters, allowing one extra per doubled quote beyond the first."""
    q = _count(c, '"')
    d = F.floor(q / 2).cast("int") - 2
    length_ok = F.when(q == 2, F.length(c).between(3, 255)).otherwise(
        F.length(c).between(F.lit(3) + d, F.lit(255) + d))
    shape = c.rlike(r'\A"(?:[^"]|"")+"\z')
    return F.coalesce((q % 2 == 0) & (q >= 2) & shape & length_ok, F.lit(False))


def is_name(c: Column) -> Column:
    return is_unquoted_name(c) | is_quoted_name(c)


def matches_name(c: Column) -> Column:
    """Full match of the name pattern (quoted part printable ASCII)."""
    return F.coalesce(_full(c, NAME), F.lit(False))


def matches_schema(c: Column) -> Column:
    """Full match of ``[name.]name``."""
    return F.coalesce(_full(c, SCHEMA), F.lit(False))


def split_db_sc(c: Column) -> Column:
    """STRUCT(db, sc), or NULL when the text is not a valid two-part name.

    One period: both parts as given. More periods: the separator must be
    ``"."`` (both quoted), ``".`` (quoted then unquoted, upper-cased) or
    ``."`` (unquoted, upper-cased, then quoted), tried in that order.
    """
    periods = _count(c, ".")

    def part(sep, idx):
        return F.substring_index(c, sep, idx)

    one_db, one_sc = part(".", 1), part(".", -1)
    both_db, both_sc = F.concat(part('"."', 1), F.lit('"')), F.concat(F.lit('"'), part('"."', -1))
    pre_db, pre_sc = F.concat(part('".', 1), F.lit('"')), part('".', -1)
    post_db, post_sc = part('."', 1), F.concat(F.lit('"'), part('."', -1))

    def st(db, sc):
        return F.struct(db.alias("db"), sc.alias("sc"))

    null = F.lit(None).cast("struct<db:string,sc:string>")
    return (F.when(periods == 1, F.when(is_name(one_db) & is_name(one_sc), st(one_db, one_sc)).otherwise(null))
            .when(periods == 0, null)
            .when(_count(c, '"."') == 1,
                  F.when(is_quoted_name(both_db) & is_quoted_name(both_sc), st(both_db, both_sc)).otherwise(null))
            .when(_count(c, '".') == 1,
                  F.when(is_quoted_name(pre_db) & is_unquoted_name(pre_sc), st(pre_db, F.upper(pre_sc))).otherwise(null))
            .when(_count(c, '."') == 1,
                  F.when(is_unquoted_name(post_db) & is_quoted_name(post_sc), st(F.upper(post_db), post_sc))
                  .otherwise(null))
            .otherwise(null))


def split_db_sc_obj(c: Column) -> Column:
    """STRUCT(db, sc, obj) when there are exactly two periods and every
    part is a valid name; NULL otherwise."""
    parts = F.split(c, r"\.")
    db, sc, obj = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    ok = (_count(c, ".") == 2) & is_name(db) & is_name(sc) & is_name(obj)
    return F.when(ok, F.struct(db.alias("db"), sc.alias("sc"), obj.alias("obj")))


def parse_name(c: Column) -> Column:
    """First NAME match anywhere in the text (unanchored: ``0_X`` → ``_X``).

    STRUCT(name, quoted, error): error 'no match' when nothing matches, and
    'match length incorrect' when several matches exist and the first is not
    one character long.
    """
    matches = F.regexp_extract_all(c, F.lit(f"({NAME})"), 1)
    first = F.get(matches, 0)
    n = F.size(matches)
    err = (F.when(n == 0, F.lit("no match"))
           .when((n != 1) & (F.length(first) != 1), F.lit("match length incorrect")))
    return F.struct(F.when(err.isNull(), first).alias("name"),
                    F.when(err.isNull(), first.contains('"')).alias("quoted"),
                    err.alias("error"))


def parse_schema(c: Column) -> Column:
    """Anchored ``db.sc`` parse; STRUCT(db, sc, quoted_db, quoted_sc, error)."""
    pat = f"\\A(?:({NAME})\\.)({NAME})\\z"
    ok = c.rlike(pat)
    db, sc = F.regexp_extract(c, pat, 1), F.regexp_extract(c, pat, 2)
    return F.struct(F.when(ok, db).alias("db"), F.when(ok, sc).alias("sc"),
                    F.when(ok, db.contains('"')).alias("quoted_db"),
                    F.when(ok, sc.contains('"')).alias("quoted_sc"),
                    F.when(~ok, F.lit("no match")).alias("error"))
