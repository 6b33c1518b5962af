"""Tie-out reports (the reference's four summary views) over stored outputs.

All four read the small stored frames (overview: one row per validation,
summary: one row per column, detail: one row per differing value pair), never
the compared tables again. Percentages are NULL when the overlap is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.similarity import edit_distance, jaro_winkler_similarity, soundex_equal


def pct(num: Column, den: Column) -> Column:
    """round(num*100/den, 3) in double; NULL instead of a division-by-zero error."""
    return F.round(F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double")), 3)


def sum_overview(overview: DataFrame) -> DataFrame:
    """V5: one-sided key shares relative to the overlap."""
    return overview.select(
        "name", "overlap_rowcount", "from_unique",
        pct(F.col("from_unique"), F.col("overlap_rowcount")).alias("from_pct"),
        "to_unique",
        pct(F.col("to_unique"), F.col("overlap_rowcount")).alias("to_pct"))


def sum_column(overview: DataFrame, summary: DataFrame) -> DataFrame:
    """V6: per column, share of matching keys and PERFECT / IMPERFECT."""
    o = overview.select("name", "overlap_rowcount")
    return (summary.join(o, "name", "inner")
            .select("name", "col_nm", "overlap_rowcount", "col_diff_cnt",
                    F.round(F.lit(100.0) - F.try_divide(F.col("col_diff_cnt").cast("double") * F.lit(100.0),
                                                        F.col("overlap_rowcount").cast("double")), 3)
                    .alias("col_pct"),
                    F.when(F.col("col_diff_cnt") == 0, F.lit("PERFECT"))
                    .otherwise(F.lit("IMPERFECT")).alias("col_match")))


def sum_detail(overview: DataFrame, detail: DataFrame, similarity: bool = True) -> DataFrame:
    """V7: differing value pairs counted per column, with similarity scalars.

    Grouping happens first (partial aggregation, one shuffle on the value
    pair); the scalars then run once per distinct pair.
    """
    o = overview.select("name", "overlap_rowcount")
    g = (detail.join(o, "name", "inner")
         .groupBy("name", "overlap_rowcount", "col_nm", "key_vals", "from_val", "to_val")
         .agg(F.sum("diff_cnt").cast("decimal(38,0)").alias("col_diff_cnt")))
    g = g.withColumn("col_diff_pct", pct(F.col("col_diff_cnt"), F.col("overlap_rowcount")))
    if similarity:
        score = jaro_winkler_similarity(F.col("from_val"), F.col("to_val"))
        g = (g.withColumn("jarowinkler_score", F.round(score, 4))
             .withColumn("jarowinkler_similarity", F.round(score * 100).cast("int"))
             .withColumn("editdistance", edit_distance(F.col("from_val"), F.col("to_val")))
             .withColumn("soundex", soundex_equal(F.col("from_val"), F.col("to_val"))))
    return g


def sum_field(sum_col: DataFrame) -> DataFrame:
    """V8: per validation, fields compared, fields differing and their shares."""
    return (sum_col.groupBy("name")
            .agg(F.sum("overlap_rowcount").cast("bigint").alias("tot_fields"),
                 F.sum("col_diff_cnt").cast("decimal(38,0)").alias("tot_diff"))
            .withColumn("diff_pct", pct(F.col("tot_diff"), F.col("tot_fields")))
            .withColumn("tot_pct", F.lit(100.0) - F.col("diff_pct")))
