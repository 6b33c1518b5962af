"""Helpers shared by the operators: lineage cuts, hot-key joins, column forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.arrowtext import small_batches
from ledgerline.session import scratch_path

# The six ASCII white-space characters of the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are
# never more than HOT_SHARE hot keys: that is the size bound of the broadcast.
HOT_SHARE = 1024
SALTS = 32


def c(name: str) -> Column:
    """A top-level column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder, in folders ``by``
    column values if any are named, and read it back.

    Cuts the lineage and survives lost executors; the schema is passed on, so
    an empty frame reads back empty.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    with small_batches(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a bound variable)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the runs of characters outside [\\x20\\x09-\\x0D]; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def total_of(groups: DataFrame, weight: str) -> int:
    return int(groups.agg(F.sum(c(weight))).first()[0] or 0)


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, salt_by: str,
           merge: bool = False) -> DataFrame:
    """Left-join ``rows`` with ``groups`` (one row per ``key``, ``weight`` = its
    row count) without sending a hot key to one task.

    The keys holding more than 1/1024 of all rows, at most 1024 of them, are
    broadcast; their rows are dealt over 32 salts by ``salt_by`` and their
    group row is repeated once per salt. ``groups`` should be a cut table. A
    key that is null never matches. With ``merge`` the groups themselves are
    never broadcast, however small they look.
    """
    limit = F.lit(total_of(groups, weight) / HOT_SHARE)
    hot = groups.where(c(weight) > limit).select(c(key), F.lit(True).alias("_hot"))
    dealt = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(c(salt_by)), F.lit(SALTS)))
                    .otherwise(F.lit(0)).cast("int"))
        .drop("_hot")
    )
    copies = F.when(c(weight) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = groups.withColumn("_salt", F.explode(copies))
    return dealt.join(spread.hint("merge") if merge else spread, [key, "_salt"], "left").drop("_salt")
