"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

DataFrame functions only. Every 1-gram and 2-gram of words is hashed into
BUCKETS; one pass over all documents counts the buckets in the raw corpus and
in the trusted target. A bucket's weight is ln(p_target / p_raw) with add-one
smoothing, kept as an integer of a millionth, so sums are exact in any order. A
document's score is the mean weight of its n-grams; it is kept if no base rule
fails it and the score is at least ``least`` (a fixed threshold: the verdict
of a document depends on the weights and its own text alone).

The target is named by ids, and every document with one of them counts: ids and
documents meet in a join, documents as their bucket numbers (two bytes each).
Raw counts cover all documents.

Defined results: a null text has no words (n_words 0, base_failed true);
repeated rows and ids are judged each; an empty table gives no rows; extra
columns are ignored whatever their names; with no target every score is that
of an empty target, below the threshold only where it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.common import SPACES, c, cut, let, words

SYMBOLS = "#*$%&|<>"
BUCKETS = 16_384
UNIT = 1_000_000
LEAST = -0.08


def base_counts(text: Column, word: Column, word_hash: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    spoken = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    return [
        F.size(word).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeated_words(word_hash, 5).cast("long").alias("n_repeat_words"),
    ]


def repeated_words(word_hash: Column, width: int) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more.

    Windows are compared by a 64-bit hash. A text whose windows are all
    different is done after one distinct; otherwise windows are sorted with
    their places, the places of repeated ones are put in order, and each adds
    the words up to the next place, at most ``width``.
    """
    def places(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)

        def place(x, i):
            before = F.when(i > 0, F.get(sorted_windows, i - 1)["h"] == x["h"]).otherwise(F.lit(False))
            after = F.when(i < n - 1, F.get(sorted_windows, i + 1)["h"] == x["h"]).otherwise(F.lit(False))
            return F.when(before | after, x["at"]).otherwise(F.lit(-1))

        return F.sort_array(F.filter(F.transform(sorted_windows, place), lambda at: at >= 0))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(width)), F.lit(width))),
            F.lit(0), lambda total, x: total + x)

    def count(h: Column) -> Column:
        at = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), places)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(at, covered))

    def window(i):
        return F.xxhash64(*[F.get(word_hash, i + k) for k in range(width)])

    return F.when(F.size(word_hash) >= width, let(
        F.transform(F.sequence(F.lit(0), F.size(word_hash) - width), window), count)).otherwise(F.lit(0))


def buckets(word_hash: Column) -> Column:
    """Bucket numbers of all 1-grams and 2-grams."""
    one = F.transform(word_hash, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(word_hash, lambda h, i: F.pmod(F.xxhash64(h, F.get(word_hash, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(word_hash) - 1, F.lit(0))))


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text"))
    rows = rows.withColumn("word", words(F.col("text")))
    return rows.withColumn("word_hash", F.transform("word", lambda w: F.xxhash64(w)))


def weights(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, weight) for all BUCKETS: the log-likelihood ratio, in 1/UNIT."""
    target = trusted_ids.select(c(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    # Bucket numbers, below 2^15, cross the exchange instead of texts; one plan at
    # all sizes, so few ids are not broadcast either.
    rows = hashed(docs, id_col, text_col).select("doc_id", buckets(F.col("word_hash")).cast("array<smallint>").alias("buckets"))
    marked = rows.join(target.withColumn("_target", F.lit(1)).hint("merge"), "doc_id", "left")
    # Outer: a plain explode has the optimizer test size(buckets) below, with every word hashed anew for
    # each gram. The null bucket of a text without words joins nothing.
    grams = marked.select(F.coalesce("_target", F.lit(0)).alias("target"), F.explode_outer("buckets").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = cut(every.join(counts, "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), (F.coalesce("target", F.lit(0)) + 1).alias("target")))
    sums = full.agg(F.sum("raw"), F.sum("target")).first()
    ratio = F.log((F.col("target") / F.lit(sums[1])) / (F.col("raw") / F.lit(sums[0])))
    return full.select("bucket", F.round(ratio * UNIT).cast("long").alias("weight"))


def judge(docs: DataFrame, trusted_ids: DataFrame, least: float = LEAST, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score per document."""
    table = {r.bucket: r.weight for r in weights(docs, trusted_ids, id_col, text_col).collect()}
    weight = F.split(F.lit(",".join(str(table[b]) for b in range(BUCKETS))), ",").cast("array<bigint>")
    rows = hashed(docs, id_col, text_col)
    total = F.aggregate(buckets(F.col("word_hash")), F.lit(0).cast("long"), lambda s, b: s + F.get(weight, b))
    n = F.col("n_words")
    counted = rows.select("doc_id", *base_counts(F.col("text"), F.col("word"), F.col("word_hash")), total.alias("total"))
    failed = (n < 10) | (F.col("n_repeat_words") * 100 > n * 20)
    score = F.when(n > 0, F.col("total") / F.lit(float(UNIT)) / (2 * n - 1))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(score >= least, F.lit(False))).alias("kept"), score.alias("score"))
