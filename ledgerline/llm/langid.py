"""Language ID by prediction by partial matching.

Each language has a variable-order byte context tree (orders 3 to 0, then all
bytes alike). A byte seen after its context costs -log2 of its share of
count / (total + distinct); an unseen byte costs the escape, distinct /
(total + distinct), and is coded one order lower (escape method C, without
exclusion). Statistics are frozen after training, so the code length of every
(context, byte) is a constant: training lays them down in tables, in 1/4096
bits, and scoring adds table entries, which makes sums exact and independent
of batches. The language with the shortest code wins; ties go to the smaller
name.

Training reads whole texts of each language, at most ``per_lang`` distinct ones
(those with the smallest text hash): the bound of what is fitted. Copies of a
text count once.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text when nothing was learned. ``score`` is the winner's share
of the probabilities 2^-bits over the learned languages. Extra columns,
whatever their names, do not matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.arrowtext import text_batches
from ledgerline.llm.common import c

ORDER = 3
UNIT = 4096  # code lengths are kept in 1/UNIT bits
START = 10  # the byte that stands before a text, ORDER times
UNIFORM = 8  # bits a byte of the code that knows no language
SLICE = 2_000_000  # bytes scored at once


class Lookup:
    """Distinct uint32 keys to row numbers: open addressing, tried in bulk."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            first = first[self.rows[at[first]] < 0]
            self.keys[at[first]], self.rows[at[first]] = keys[todo[first]], todo[first]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent."""
        at = self._home(keys)
        rows = self.rows[at]
        odd = np.flatnonzero((rows >= 0) & (self.keys[at] != keys))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            rows[odd] = self.rows[at[odd]]
            odd = odd[(rows[odd] >= 0) & (self.keys[at[odd]] != keys[odd])]
        return rows


class ContextTrees:
    """Frozen code lengths of all languages for orders 0 to ORDER."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        """gram: ORDER context bytes and the byte after them; count per (lang, gram)."""
        n = len(langs)
        self.langs = langs
        self.seen, self.cost, self.contexts, self.escape = [], [], [], []
        below, below_keys = np.full((1, n), 8 * UNIT, np.int64), None
        for order in range(ORDER + 1):
            keys, row = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(row * n + lang, count, len(keys) * n).reshape(-1, n)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total = np.stack([np.bincount(of, counts[:, j], len(contexts)) for j in range(n)], 1)
            kinds = np.stack([np.bincount(of, counts[:, j] > 0, len(contexts)) for j in range(n)], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = -np.log2(counts / (total + kinds)[of])
            escape = np.rint(escape * UNIT).astype(np.int64)
            if below_keys is None:
                lower = np.repeat(below, len(keys), 0)
            else:
                lower = below[np.searchsorted(below_keys, keys & ((1 << 8 * order) - 1))]
            with np.errstate(invalid="ignore"):
                cost = np.where(counts > 0, np.rint(np.where(counts > 0, own, 0) * UNIT), escape[of] + lower)
            below, below_keys = cost.astype(np.int64), keys
            self.seen.append(Lookup(keys))
            self.cost.append(cost.astype(np.int32))
            self.contexts.append(Lookup(contexts))
            self.escape.append(escape.astype(np.int32))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in 1/UNIT bits."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= SLICE:
                size += len(texts[stop])
                stop += 1
            out[at:stop] = self._sum(texts[at:stop])
            at = stop
        return out

    def _sum(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not sizes.sum():
            return out
        pad = bytes([START]) * ORDER
        codes = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8).astype(np.uint32)
        gram = codes[ORDER:].copy()
        for k in range(1, ORDER + 1):
            gram |= codes[ORDER - k:len(codes) - k] << np.uint32(8 * k)
        # Drop the positions of the padding bytes of all texts but the first.
        inside = np.ones(len(gram), bool)
        starts = np.cumsum(sizes + ORDER)[:-1] - ORDER
        for k in range(ORDER):
            inside[starts + k] = False
        gram = gram[inside]
        ends = np.cumsum(sizes)
        filled = np.flatnonzero(sizes)
        segment = (ends - sizes)[filled]
        found = self.seen[ORDER].find(gram)
        hit = found >= 0
        missed = np.flatnonzero(~hit)
        extra = self._lower(gram[missed], ORDER)
        for j in range(len(self.langs)):
            cost = self.cost[ORDER][:, j][found].astype(np.int64)
            cost[missed] = extra[:, j]
            out[filled, j] = np.add.reduceat(cost, segment)
        return out

    def _lower(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of bytes not seen after their ``order`` context by any language."""
        cost = np.zeros((len(gram), len(self.langs)), np.int64)
        if not len(gram):
            return cost
        context = self.contexts[order].find((gram & np.uint32((1 << 8 * (order + 1)) - 1)) >> np.uint32(8))
        known = context >= 0
        cost[known] += self.escape[order][context[known]]
        if order == 0:
            return cost + 8 * UNIT
        shorter = gram & np.uint32((1 << 8 * order) - 1)
        found = self.seen[order - 1].find(shorter)
        hit = found >= 0
        cost[hit] += self.cost[order - 1][found[hit]]
        cost[~hit] += self._lower(shorter[~hit], order - 1)
        return cost


def bounded_sample(labelled: DataFrame, per_lang: int) -> DataFrame:
    """At most ``per_lang`` distinct texts of each language, those of smallest text hash."""
    rank = F.xxhash64("text")
    counts = labelled.select("lang", rank.alias("rank")).distinct().groupBy("lang").agg(
        F.count("*").alias("n")).collect()  # one row per language
    if not counts:
        return labelled
    # A first cut by hash, so that the exact one below ranks few rows in a task.
    near = reduce(lambda a, b: a | b, [
        (F.col("lang") == r.lang) & (F.pmod(rank, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.25 * per_lang / r.n)))
        for r in counts])
    order = Window.partitionBy("lang").orderBy(F.pmod(rank, F.lit(1 << 30)), "text")
    return labelled.where(near).select("lang", "text").distinct().withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= per_lang).drop("_rank")


GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count_grams(batches):
    """(lang, text) to counts of ORDER + 1 bytes, added up within the task."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(text.encode())
        for lang, texts in by_lang.items():
            total: dict[int, int] = {}
            for text in texts:
                codes = np.frombuffer(bytes([START]) * ORDER + text, np.uint8).astype(np.int64)
                gram = codes[ORDER:].copy()
                for k in range(1, ORDER + 1):
                    gram |= codes[ORDER - k:len(codes) - k] << (8 * k)
                for g, n in zip(*(x.tolist() for x in np.unique(gram, return_counts=True))):
                    total[g] = total.get(g, 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()),
                 pa.array(list(total.values()), pa.int64())], schema=GRAMS)


def learn(labelled: DataFrame, per_lang: int = 2000, text_col: str = "text",
          lang_col: str = "lang") -> ContextTrees | None:
    """Context trees from labelled rows; None if there are none. Only the counts
    of the bounded sample reach the driver."""
    rows = labelled.select(c(lang_col).alias("lang"), c(text_col).alias("text")).where(
        "lang is not null and text is not null")
    sample = bounded_sample(rows, per_lang).select("lang", "text")
    parts = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    counts = (sample.repartition(parts, F.xxhash64("text")).mapInArrow(_count_grams, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    if not counts.num_rows:
        return None
    langs = sorted(counts.column("lang").unique().to_pylist())
    number = {x: i for i, x in enumerate(langs)}
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    names = np.array([number[x] for x in lang.dictionary.to_pylist()])
    return ContextTrees(langs, names[lang.indices.to_numpy()], counts.column("gram").to_numpy(),
                        counts.column("n").to_numpy())


def predictor(spark, trees: ContextTrees | None):
    """Column function: text -> struct(lang_pred, score)."""
    if trees is None:
        return lambda text: F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(trees)
    text_batches(spark)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        bits = model.code_lengths(raw) / UNIT
        best = bits.argmin(1)
        lead = bits.min(1, keepdims=True) - bits
        score = 1 / np.exp2(np.maximum(lead, -1000)).sum(1)
        return pa.StructArray.from_arrays(
            [pa.array([model.langs[i] for i in best], pa.string()), pa.array(score, pa.float64())],
            names=["lang_pred", "score"])

    def column(text: Column) -> Column:
        # A text without a letter never reaches the model's verdict.
        letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        found = predict(text)
        return F.struct(F.when(letters, found["lang_pred"]).otherwise(F.lit("und")).alias("lang_pred"),
                        F.when(letters, found["score"]).otherwise(F.lit(0.0)).alias("score"))

    return column


def unlike_any(spark, trees: ContextTrees | None):
    """Column function: text -> whether its code under every learned language is no
    shorter than its bytes (UNIFORM bits each). False where nothing was learned."""
    if trees is None:
        return lambda text: F.lit(False)
    shared = spark.sparkContext.broadcast(trees)
    text_batches(spark)

    @F.arrow_udf("boolean")
    def unlike(texts: pa.Array) -> pa.Array:
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        size = np.array([len(t) for t in raw], np.int64)
        return pa.array(shared.value.code_lengths(raw).min(1) >= UNIFORM * UNIT * size)

    return unlike


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, remainder 2 of 4."""
    return F.coalesce(F.crc32(c(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = 2000) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that are not held out and predict
    every row: doc_id, held_out, lang_pred, score."""
    trees = learn(docs.where(~held_out()), per_lang)
    guess = predictor(docs.sparkSession, trees)
    found = docs.select(c("doc_id"), held_out().alias("held_out"), guess(c("text")).alias("_found"))
    return found.select("doc_id", "held_out", "_found.lang_pred", "_found.score")
