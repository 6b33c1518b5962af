"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word is hashed to one of WORDS rows. A row's index vector is sparse and
ternary (a few +1 and -1 at hashed places); its word vector is the sum of the
index vectors of its neighbours within WINDOW words, over all documents. Tasks
add up their own documents, partial matrices are summed in a tree of fan-in
FAN, and only the finished matrix, whose size is fixed, reaches the driver. A
document is the mean of its words' unit vectors and of their index vectors,
the lengths of these two means and the logarithm of its number of words.

A two-layer numpy network is trained on at most ``most`` labelled documents
(those of smallest id hash: the bound of what is fitted); a fifth of them is
held back to calibrate the temperature of the probabilities.

Defined results: a null or empty text is the zero vector and gets the score
the network gives that; with labels of one kind only, or none, every score is
the share of label 1 (0.5 without labels); repeated rows are scored each; an
empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.arrowtext import coded_words, text_batches, text_slices, tidy
from ledgerline.llm.common import c, cut
from ledgerline.llm.langid import held_out

WORDS, DIMS, NONZERO, WINDOW = 32_768, 32, 2, 2
CHUNKS, FAN = 64, 64
HIDDEN = 32
SLICE = 2_000_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every row's index vector."""
    draw = np.random.Generator(np.random.PCG64(7))
    place = np.argsort(draw.random((WORDS, DIMS)), axis=1)[:, :NONZERO]
    return place, np.where(draw.random((WORDS, NONZERO)) < 0.5, -1.0, 1.0)


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every word, and where each text's words end (from 0)."""
    import xxhash

    distinct, code, ends = coded_words(texts)
    rows = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))
    return (rows % np.uint64(WORDS)).astype(np.int64)[code], ends


def add_neighbours(matrix: np.ndarray, rows: np.ndarray, ends: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Add the index vectors of all neighbours to the flat matrix."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for gap in range(1, WINDOW + 1):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        left, right = rows[:len(rows) - gap][same], rows[gap:][same]
        for word, near in ((left, right), (right, left)):
            for k in range(NONZERO):
                matrix += np.bincount(word * DIMS + place[near, k], sign[near, k], WORDS * DIMS).astype(np.int64)


PART = pa.schema([("slot", pa.int64()), ("chunk", pa.int32()), ("part", pa.binary())])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The matrix of word vectors over all documents, rows of unit length."""
    def count(batches):
        from pyspark import TaskContext

        place, sign = index_vectors()
        matrix = np.zeros(WORDS * DIMS, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0), SLICE):
                add_neighbours(matrix, *word_rows(texts), place, sign)
        slot = TaskContext.get().partitionId()
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(matrix, CHUNKS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([slot] * CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())],
            schema=PART)

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("part").to_pylist()]
        total = parts[0].copy()
        for x in parts[1:]:
            total += x
        return pa.table({"slot": [table.column("slot")[0].as_py() // FAN], "chunk": [table.column("chunk")[0].as_py()],
                         "part": [zlib.compress(total.tobytes(), 1)]}, schema=PART)

    level = cut(docs.select(c(text_col).alias("text")).mapInArrow(tidy(count), "slot long, chunk int, part binary"))
    while (level.agg(F.max("slot")).first()[0] or 0) > 0:
        level = cut(level.groupBy("chunk", F.floor(F.col("slot") / FAN)).applyInArrow(
            lambda _, table: add(table), "slot long, chunk int, part binary"))
    rows = level.orderBy("chunk").collect()  # CHUNKS rows, whatever the corpus
    if not rows:
        return np.zeros((WORDS, DIMS), np.float32)
    whole = np.concatenate([np.frombuffer(zlib.decompress(r.part), np.int64) for r in rows]).reshape(WORDS, DIMS)
    norm = np.sqrt((whole.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (whole / np.maximum(norm, 1e-12)).astype(np.float32)


def own_vectors() -> np.ndarray:
    place, sign = index_vectors()
    out = np.zeros((WORDS, DIMS), np.float32)
    for k in range(NONZERO):
        out[np.arange(WORDS), place[:, k]] = sign[:, k]
    return out


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text's words, the lengths of its two halves (near
    1 when one word repeats) and ln(1 + words); zero without words."""
    out = np.zeros((len(texts), vectors.shape[1] + 3))
    for first, part in text_slices(texts, SLICE // 2):
        rows, ends = word_rows(part)
        n = np.diff(ends)
        some = np.flatnonzero(n)
        if len(some):
            mean = np.add.reduceat(vectors[rows], ends[:-1][some], axis=0) / n[some, None]
            halves = [np.sqrt((x ** 2).sum(1)) for x in (mean[:, :DIMS], mean[:, DIMS:])]
            out[first + some] = np.column_stack([mean, *halves, np.log1p(n[some])])
    return out


class Network:
    """features -> tanh -> probability, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.01, decay: float = 1e-4):
        draw = np.random.Generator(np.random.PCG64(11))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.temperature = 1.0
        x = self._standard(x)
        held = np.arange(len(x)) % 5 == 4
        fit, truth = x[~held], y[~held]
        share = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
        self.w = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  draw.normal(0, HIDDEN ** -0.5, HIDDEN), np.log(share / (1 - share)) * np.ones(1)]
        first, second = [0 * w for w in self.w], [0 * w for w in self.w]
        for t in range(1, steps + 1):
            hidden = np.tanh(fit @ self.w[0] + self.w[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -50, 50))) - truth) / len(fit)
            back = error[:, None] * self.w[2] * (1 - hidden ** 2)
            grads = [fit.T @ back + decay * self.w[0], back.sum(0), hidden.T @ error + decay * self.w[2], error.sum(keepdims=True)]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
        if held.any():
            logits, truth = self._logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
            loss = [np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x):
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def _logits(self, x):
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._standard(x)) / self.temperature, -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, vectors, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of at most ``most`` labelled documents that are not held out."""
    few = (labels.where("quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def run(batches):
        for batch in batches:
            x = pool(batch.column(1), vectors.value)
            flat = pa.array(x.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"])

    rows = docs.select(c("doc_id"), c("text")).join(F.broadcast(few), "doc_id").select(
        "doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, quality int, x array<double>")
    found = rows.toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(found.num_rows, 2 * DIMS + 3)
    # Ids in order would put neighbours into one fold; a fixed shuffle does not.
    order = np.random.Generator(np.random.PCG64(5)).permutation(found.num_rows)
    return x[order], found.column("quality").to_numpy().astype(np.float64)[order]


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000, cut_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(np.hstack([word_vectors(docs), own_vectors()]))
    x, y = training_rows(docs, labels, vectors, most)
    if len(y) == 0 or y.min() == y.max():
        score = F.lit(float(y.mean()) if len(y) else 0.5)
    else:
        network = spark.sparkContext.broadcast(Network(x, y))
        text_batches(spark)

        @F.arrow_udf("double")
        def predict(texts: pa.Array) -> pa.Array:
            return pa.array(network.value.probability(pool(texts, vectors.value)), pa.float64())

        score = predict(F.coalesce(c("text"), F.lit("")))
    return docs.select(c("doc_id"), held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut_at).cast("int"))
