"""Global order as a column: the place of every row in a total order.

Rows are range partitioned and sorted, and written once with their partition and
their place in it. The partitions' sizes, one number each, are added up on the
driver; a row's position is its place after the rows of the partitions before
it. No task sees more than its range, unlike a window without partition keys.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

# monotonically_increasing_id: the partition above, the row in it below these bits.
ROW_BITS = 33


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: 1 for the first row in the order of ``order``, without gaps.

    Rows that tie in all of ``order`` are placed one after another in no set order:
    name enough columns where that matters. The result is a stored table.
    """
    spark = df.sparkSession
    ordered = df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id())
    path = scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
    ordered.write.parquet(path)
    stored = spark.read.schema(ordered.schema).parquet(path).withColumn("__range", F.shiftright("__place", ROW_BITS))
    sizes = sorted(map(tuple, stored.groupBy("__range").count().collect()))  # a row per partition
    before = [0, *accumulate(n for _, n in sizes)]
    starts = spark.createDataFrame([(r, b) for (r, _), b in zip(sizes, before)], "__range bigint, __before bigint")
    here = F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (stored.join(F.broadcast(starts), "__range")
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + here + 1).alias(name)))
