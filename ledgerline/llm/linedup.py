"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line, n): the 128-bit hash of a line's key and the number
of documents that hold it. Runs are bucketed and sorted by hash, so joins of
runs are merges that move no rows. Documents come in batches. A batch's lines
are counted once (partial counts leave each task, whatever the line), merged
against the runs to leave out the lines that are settled there (held by
``least`` documents), and written as a new run of level 0. Two runs of a level
are compacted into one of the next, so there are never more runs than the
logarithm of the batches. Merged totals name the lines that go.

Texts meet only the hashes of their own lines that go: (document, line) pairs
are joined with those lines, a hot line's pairs dealt over salts, and collected
per document, bounded by its lines.

Defined results: a null or empty text is one empty line, which is never
dropped, as no line whose key is shorter than ``min_chars`` is; a row counts as
one document however often it holds a line, and repeated rows count each; an
empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.arrowtext import text_slices, tidy
from ledgerline.llm.common import SPACES, attach, c, cut
from ledgerline.session import scratch_path

BATCHES = 6  # a whole table is dealt into so many; the result is the same for any number


def line_keys(texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """(lines of all texts, distinct keys, number of each line's key, where each
    text's lines end: one entry more than texts, from 0)."""
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    coded = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACES)).dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    return lines, coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


def key_hashes(keys: list[str], min_chars: int) -> list[bytes | None]:
    """128 bits per key; None for a key that is too short to be dropped."""
    return [hashlib.md5(k.encode(), usedforsecurity=False).digest() if len(k) >= min_chars else None for k in keys]


PAIRS = "_r1 long, _r2 long, batch int, line binary"
PAIRS_ARROW = pa.schema([("_r1", pa.int64()), ("_r2", pa.int64()), ("batch", pa.int32()), ("line", pa.binary())])


def _pairs(min_chars: int):
    """Documents to one row for each line key they hold."""
    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(3)):
                _, keys, code, ends = line_keys(texts)
                hashes = key_hashes(keys, min_chars)
                doc = np.repeat(np.arange(len(texts)), np.diff(ends))
                pair = np.unique(doc * len(keys) + code)
                real = np.fromiter((h is not None for h in hashes), bool, len(hashes))
                pair = pair[real[pair % len(keys)]]
                owner = pa.array(first + pair // len(keys))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(owner) for i in range(3)]
                    + [pa.array(hashes, pa.binary()).take(pa.array(pair % len(keys)))], schema=PAIRS_ARROW)

    return run


class LineRuns:
    """Levelled runs of line hashes under the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, least: int):
        self.spark, self.least = spark, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by line, as a run. The name in the catalog goes at once; the
        files stay, as those of all intermediate tables."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, "line").sortBy("line").format("parquet")
         .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs in one: a merge join of buckets, without an exchange."""
        both = a.alias("a").join(b.alias("b"), F.col("a.line") == F.col("b.line"), "full_outer")
        return both.select(F.coalesce("a.line", "b.line").alias("line"),
                           (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).cast("long").alias("n"))

    @property
    def runs(self) -> list[DataFrame]:
        return [r for r in self.levels if r is not None]

    def add(self, lines: DataFrame) -> None:
        """Take in a batch: a row per (document, line) pair with column ``line``."""
        fresh = lines.groupBy("line").agg(F.count("*").alias("n"))
        for run in self.runs:
            fresh = fresh.join(run.where(F.col("n") >= self.least), "line", "left_anti")
        new = self._write(fresh)
        for level, run in enumerate(self.levels):
            if run is None:
                self.levels[level] = new
                return
            new = self._write(self._merge(run, new))
            self.levels[level] = None
        self.levels.append(new)

    def settled(self) -> DataFrame:
        """(line, n) of the lines that ``least`` documents hold, of a merge of all
        runs. n counts up to the batch in which the line was settled."""
        runs = self.runs
        if not runs:
            return self.spark.createDataFrame([], "line binary, n long")
        whole = runs[0]
        for run in runs[1:]:
            whole = self._write(self._merge(whole, run))
        return whole.where(F.col("n") >= self.least)


KEPT = "doc_id long, n_lines long, n_dropped long, kept_text string"
KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                        ("kept_text", pa.string())])


def _keep(min_chars: int):
    """(doc_id, text, hashes of its lines that go) to what stays."""
    def run(batches):
        for batch in batches:
            gone = batch.column(2)
            for first, texts in text_slices(batch.column(1)):
                lines, keys, code, ends = line_keys(texts)
                kept, dropped = texts.to_pylist(), np.zeros(len(texts), np.int64)
                hashes = None
                for i in range(len(texts)):
                    go = gone[first + i].as_py()
                    if not go:
                        continue
                    hashes = hashes or key_hashes(keys, min_chars)
                    go, own = set(go), code[ends[i]:ends[i + 1]]
                    stays = np.fromiter((hashes[k] not in go for k in own), bool, len(own))
                    dropped[i] = len(own) - stays.sum()
                    kept[i] = "\n".join(lines.slice(ends[i], len(own)).filter(pa.array(stays)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(np.diff(ends).astype(np.int64)),
                     pa.array(dropped), pa.array(kept, pa.string())], schema=KEPT_ARROW)

    return run


def drop_common_lines(docs: DataFrame, least: int = 10, min_chars: int = 1, batches: int = BATCHES,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every document: lines whose key is
    held by ``least`` documents or more go from all of them."""
    spark = docs.sparkSession
    text = F.coalesce(c(text_col), F.lit(""))
    # A document is named by its id and 128 bits of its text: rows equal in both lose the same lines.
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        F.xxhash64("doc_id", "text").alias("_r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_r2"), "doc_id", "text")
    deal = F.pmod("_r1", F.lit(batches)).cast("int").alias("batch")
    pairs = cut(rows.select("_r1", "_r2", deal, "text").mapInArrow(tidy(_pairs(min_chars)), PAIRS), "batch")
    runs = LineRuns(spark, least)
    for batch in range(batches):
        runs.add(pairs.where(F.col("batch") == batch).select("line"))
    common = cut(runs.settled())
    met = attach(pairs.select("_r1", "_r2", "line"), common, "line", "n", salt_by="_r1").where("n is not null")
    gone = met.groupBy("_r1", "_r2").agg(F.collect_set("line").alias("gone"))
    whole = rows.join(gone, ["_r1", "_r2"], "left")
    return whole.select("doc_id", "text", "gone").mapInArrow(tidy(_keep(min_chars)), KEPT)


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT row, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d
), k AS (
  SELECT row, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
), kept AS (
  SELECT row, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM k WHERE key NOT IN (SELECT key FROM common) GROUP BY row
)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, len(parts) - coalesce(n, 0) AS n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
