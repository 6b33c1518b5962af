"""Mixing sources to target weights by entropy balancing.

DataFrame functions only. Among all document rates between 0 and MOST whose words
meet every source's target, entropy balancing takes those closest (in relative
entropy, each document weighing alike) to taking every document once: a rate is
exp(l_s * size), held at MOST. Its dual is convex in one multiplier l_s per
source. Every Newton step is one aggregation over the documents of all sources:
sum(size * rate) and sum(size^2 * rate), the latter of the rates that are not
held; a step that leaves the bracket known so far is replaced by its middle.
Documents of one source and size have one rate, so they are counted before
anything is exchanged, and sums are of decimals, the same in any order.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share all words; a target stops at MOST times its source's words and the excess
is shared again by weight until none is above.

Rates become whole copies: down the sizes of a source, the running sum of rates
is rounded, which gives each size its number of copies. What the source then
lacks or has too much is corrected by single whole copies, the largest that fit
first, until no document of the source fits into the gap. Copies of one size go
to its documents evenly, in an order of their ids.

Defined results: a null text has size 0 and is taken once; a source without words
has target 0; repeated rows and ids are mixed each; an empty table gives no rows;
columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.common import attach, c, cut

WEIGHTS = (5, 2, 1)
MOST = 3
IDS_PER_BLOCK = 16_384
STEEPEST = 64.0  # largest multiplier, in units of one over a source's mean size
STEPS = 60


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without null: 1 and the source, or 0 for null."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def targets(stats: DataFrame) -> DataFrame:
    """Add ``target`` to (source, words): water-filling over the sources, one row
    each, in the order in which they reach their limit."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = stats.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    by_limit = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = weighed.withColumns({
        "total": F.sum("words").over(every),
        "left": F.sum("words").over(every) - MOST * F.coalesce(F.sum("words").over(up_to), F.lit(0)),
        "open": F.sum("weight").over(onward),
    })
    # At its limit: what the sources before it leave, shared by weight, is above it.
    full = level.withColumn("full", F.col("left") * F.col("weight") > MOST * F.col("words") * F.col("open"))
    rest = full.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), MOST * F.col("words"))).over(every), F.lit(0)),
        "shares": F.sum(F.when(~F.col("full"), F.col("weight"))).over(every),
    })
    share = F.col("rest") * F.col("weight") / F.col("shares")
    return rest.select("key", "rows", "words", F.when(
        F.col("full"), (MOST * F.col("words")).cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def _exact(x: Column) -> Column:
    """A term whose sum does not depend on the order of the rows."""
    return F.round(x, 6).cast("decimal(38,6)")


def balance(classes: DataFrame, planned: DataFrame) -> DataFrame:
    """(key, tilt) per source: the multiplier of its documents' sizes. ``classes``: key,
    size, n documents; ``planned``: key, rows, words, target."""
    mean = F.col("words") / F.col("rows")
    state = cut(planned.where((F.col("words") > 0) & (F.col("target") < MOST * F.col("words"))).select(
        "key", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-STEEPEST).alias("low"),
        F.lit(STEEPEST).alias("high"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        step = F.col("tilt") * F.col("size") / F.col("mean")
        rate = F.least(F.exp(step), F.lit(float(MOST)))
        taken = F.col("n") * F.col("size") * rate
        free = F.when(F.exp(step) < MOST, taken * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        sums = classes.where("size > 0").join(state.where("not done"), "key").groupBy("key").agg(
            F.sum(_exact(taken)).cast("double").alias("taken"), F.sum(_exact(free)).cast("double").alias("slope"))
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.round(F.col("tilt") - F.try_divide(gap, F.col("slope")), 12)
        moved = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        there = (F.abs(gap) <= 0.5) | (high - low < 1e-9)
        state = cut(state.join(sums, "key", "left").select(
            "key", "target", "mean", F.when(F.col("done") | there, F.col("tilt")).otherwise(moved).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | there).alias("done")))
        if not state.where("not done").take(1):
            break
    return state.select("key", (F.col("tilt") / F.col("mean")).alias("tilt"))


def whole_copies(classes: DataFrame, planned: DataFrame, tilts: DataFrame) -> DataFrame:
    """``classes`` with ``copies``, the number of copies taken of a size's n documents."""
    rate = F.least(F.exp(F.col("tilt") * F.col("size")), F.lit(float(MOST)))
    full = F.when((F.col("words") > 0) & (F.col("size") > 0), F.lit(float(MOST))).otherwise(F.lit(1.0))
    rated = classes.join(planned, "key").join(tilts, "key", "left").withColumn("rate", F.coalesce(rate, full))
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    so_far = F.floor(F.sum(F.col("n") * F.col("rate")).over(down) + 0.5)
    rounded = rated.withColumn("upto", so_far).withColumn("copies", F.greatest(F.lit(0), F.least(
        F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)), MOST * F.col("n"))).cast("long"))
    now = cut(rounded.select("key", "size", "n", "words", "target", "copies"))
    source = Window.partitionBy("key")
    while True:
        # A source's gap, and of each size the copies that may be added or given back.
        gap = F.round("target").cast("long") - F.sum(F.col("copies") * F.col("size")).over(source)
        some = now.withColumn("gap", gap)
        spare = F.when(F.col("gap") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        some = some.withColumn("spare", F.when(fits, spare).otherwise(F.lit(0)))
        if not some.where("spare > 0").take(1):
            return now
        before = F.coalesce(F.sum(F.col("spare") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        room = F.greatest(F.abs("gap") - F.col("before"), F.lit(0))
        change = F.when(F.col("spare") > 0, F.least("spare", F.expr("room div size"))).otherwise(F.lit(0))
        now = cut(some.withColumn("before", before).withColumn("room", room).withColumn("change", change).select(
            "key", "size", "n", "words", "target",
            (F.col("copies") + F.signum("gap").cast("long") * F.col("change")).alias("copies")))


def _named(key: Column, size: Column) -> Column:
    """A source and size as one key."""
    return F.concat(size.cast("string"), F.lit(":"), key)


def plan_copies(rows: DataFrame) -> DataFrame:
    """(key, size, ident) rows, one per document, to a written table: of each distinct
    row its class, ident, how many documents it stands for (``same``), the place of
    the first in the class (``first``), and n, copies, words, target of the class."""
    known = cut(rows.groupBy("key", "size", "ident").agg(F.count("*").alias("same")))
    classes = cut(known.groupBy("key", "size").agg(F.sum("same").alias("n"), F.count("*").alias("ids")))
    stats = cut(classes.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("words")))
    by_name = stats.withColumn("source", F.when(F.col("key") != "0", F.substring("key", 2, 1 << 30)))
    planned = cut(targets(by_name))
    taken = whole_copies(classes.drop("ids"), planned.drop("rows"), balance(classes, planned))
    groups = cut(taken.join(classes.select("key", "size", "ids"), ["key", "size"]).select(
        _named(F.col("key"), F.col("size")).alias("class"), "n", "ids", "copies", "words", "target"))
    dealt = attach(known.select(_named(F.col("key"), F.col("size")).alias("class"), "size", "ident", "same"),
                   groups, "class", "ids", salt_by="ident")
    number = F.conv(F.substring(F.md5(F.col("ident").cast("binary")), 1, 8), 16, 10).cast("long")
    dealt = cut(dealt.withColumn("block", F.pmod(number, F.expr(f"(ids + {IDS_PER_BLOCK - 1}) div {IDS_PER_BLOCK}"))))
    # Places in a class: those of the blocks before, then those in the block.
    sizes = dealt.groupBy("class", "block").agg(F.sum("same").alias("held"))
    earlier = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("class", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("class", "block").orderBy("ident").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("same").over(inside), F.lit(0))).join(starts, ["class", "block"])
    return cut(placed.select("class", "size", "ident", "same", (F.col("start") + F.col("inside")).alias("first"),
                             "n", "copies", "words", "target"))


def _ident(docs: DataFrame, id_col: str) -> Column:
    return F.coalesce(c(id_col).cast("string"), F.lit(""))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies per document."""
    planned = plan_copies(docs.select(source_key(c(source_col)).alias("key"), count_words(c(text_col)).alias("size"),
                                      _ident(docs, id_col).alias("ident")))
    each = planned.withColumn("place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("same") - 1)))
    return each.withColumn("copies", F.expr(PLACED)).select(
        F.when(F.col("ident") != "", F.col("ident")).cast("long").alias("doc_id"), "size",
        F.col("words").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


# Of n documents that share copies, those of the one at ``place`` (from 0).
PLACED = "copies * (place + 1) div n - copies * place div n"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with _copies added: how often the mix takes each document, 0 to MOST."""
    names = [c(n) for n in docs.columns]
    key, size = source_key(c(source_col)), count_words(c(text_col))
    planned = plan_copies(docs.select(key.alias("key"), size.alias("size"), _ident(docs, id_col).alias("ident")))
    marked = docs.withColumns({"_class": _named(key, size), "_ident": _ident(docs, id_col)})
    joined = marked.join(planned.select(F.col("class").alias("_class"), F.col("ident").alias("_ident"), *[
        F.col(x).alias(f"_{x}") for x in ("same", "first", "n", "copies")]), ["_class", "_ident"])
    # Rows that share class and id take the places of their group one after another.
    several = Window.partitionBy("_class", "_ident").orderBy(F.lit(1))
    placed = joined.where("_same = 1").withColumn("_place", F.col("_first")).unionByName(
        joined.where("_same > 1").withColumn("_place", F.col("_first") + F.row_number().over(several) - 1))
    return placed.withColumn("_copies", F.expr("_copies * (_place + 1) div _n - _copies * _place div _n")).select(
        *names, "_copies")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to MOST times)."""
    return mix(docs).where("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[c(n) for n in docs.columns])
