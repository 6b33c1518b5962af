"""Exact dedup with a cuckoo-filter index.

A task's index is a cuckoo filter of 16-bit fingerprints, four to a bucket,
with the full digest stored beside each fingerprint: a filter hit counts only
when the stored digest in that bucket is the same. Live digests can be
deleted; when an insertion finds no room after a run of evictions, the table
doubles and is refilled from the stored keys.

Across Spark, each map task first folds its own rows through an index, so a
group of copies leaves a task as one partial row however large it is; the
partial rows are dealt by digest and folded through one index per partition.

Texts are equal when identical after deleting every character of
[\\x20\\x09-\\x0D]. Defined results: a null text counts as empty; of equal
texts the row with the most code points, then the smallest id (null last)
stays; of rows that tie in all of this exactly one is kept; an empty table
gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.llm.arrowtext import tidy
from ledgerline.llm.common import SPACES, attach, c, cut, digest

# Live digests an index may hold before a map task hands its partial rows on,
# and the number a reduce partition is sized for. Neither changes a result.
INDEX_ROWS = 250_000


class CuckooIndex:
    """Digest -> value, found through a cuckoo filter and verified by content."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 256):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.keys: list = [None] * len(self.prints)
        self.values: list = [None] * len(self.prints)
        self.live = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and first slot of both buckets; keys are uniform digests."""
        h = int.from_bytes(key[:8], "little")
        mark = (h >> 48) or 1
        first = h & self.mask
        return mark, first * self.SLOTS, self._other(first, mark) * self.SLOTS

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, key: bytes) -> int:
        """Slot of a live digest, or -1: fingerprint hit first, then content."""
        mark, a, b = self._places(key)
        for start in (a, b):
            for slot in range(start, start + self.SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value) -> None:
        """Add a digest that is not live yet."""
        homeless = (key, value)
        while homeless is not None:
            homeless = self._place(*homeless)
            if homeless is not None:
                self._grow()

    def _place(self, key: bytes, value):
        """Store, evicting others if need be; what is left without a place."""
        mark, a, b = self._places(key)
        for start in (a, b):
            for slot in range(start, start + self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    self.live += 1
                    return None
        bucket = b // self.SLOTS
        for kick in range(self.KICKS):
            slot = bucket * self.SLOTS + (mark + kick) % self.SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            bucket = self._other(bucket, mark)
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    self.live += 1
                    return None
        return key, value

    def _grow(self) -> None:
        """Double the table and refill it from the stored keys."""
        stored = list(self.items())
        buckets = 2 * (self.mask + 1)
        while True:
            self._reset(buckets)
            if all(self._place(k, v) is None for k, v in stored):
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        """Remove a live digest; content is compared first, so nothing else goes."""
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1
        return True

    def items(self):
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


PARTIAL = "digest binary, keep_len long, keep_id long, ties long, group_size long"
PARTIAL_ARROW = pa.schema([("digest", pa.binary()), ("keep_len", pa.int64()), ("keep_id", pa.int64()),
                           ("ties", pa.int64()), ("group_size", pa.int64())])


def _better(a, b) -> int:
    """1 if group a's best row goes before b's, 0 for a tie, -1 otherwise."""
    left = (-a[0], a[1] is None, a[1] or 0)
    right = (-b[0], b[1] is None, b[1] or 0)
    return (left < right) - (left > right)


def _fold(flush: bool):
    """Arrow batches of partial rows to one partial row per digest."""

    def emit(index):
        rows = list(index.items())
        for at in range(0, len(rows), 20_000):
            part = rows[at:at + 20_000]
            cols = [[k for k, _ in part]] + [[v[i] for _, v in part] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(cols, PARTIAL_ARROW)], schema=PARTIAL_ARROW)

    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                slot = index.find(key)
                if slot < 0:
                    index.insert(key, row)
                    continue
                best = index.values[slot]
                order = _better(row, best)
                if order > 0:
                    best[:3] = row[:3]
                elif order == 0:
                    best[2] += row[2]
                best[3] += row[3]
            if flush and index.live > INDEX_ROWS:
                yield from emit(index)
                index = CuckooIndex()
        yield from emit(index)

    return run


def normal_digest(text) -> F.Column:
    """SHA-256 of the text without its white space."""
    return digest(F.translate(F.coalesce(text, F.lit("")), SPACES, ""))


def keepers(rows: DataFrame) -> DataFrame:
    """(doc_id, n_code_points, digest) rows to one row per digest: keep_len,
    keep_id, ties (rows equal to the best in both), group_size. A written table."""
    single = rows.select("digest", F.col("n_code_points").alias("keep_len"), F.col("doc_id").alias("keep_id"),
                         F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("group_size"))
    partial = cut(single.mapInArrow(tidy(_fold(flush=True)), PARTIAL))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-partial.count() // INDEX_ROWS))
    return cut(partial.repartition(parts, "digest").mapInArrow(tidy(_fold(flush=False)), PARTIAL))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(
        c(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(c(text_col), F.lit(""))).cast("long").alias("n_code_points"),
        normal_digest(c(text_col)).alias("digest")))
    groups = keepers(rows)
    joined = cut(attach(rows, groups, "digest", "group_size", salt_by="doc_id"))
    best = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("n_code_points") == F.col("keep_len"))
    several = best & (F.col("ties") > 1)
    one = Window.partitionBy("digest").orderBy("doc_id")
    marked = joined.where(~several).withColumn("kept", best).unionByName(
        joined.where(several).withColumn("kept", F.row_number().over(one) == 1))
    return marked.select("doc_id", "keep_id", "group_size", "kept",
                         F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    key, size = normal_digest(c(text_col)), F.length(F.coalesce(c(text_col), F.lit(""))).cast("long")
    groups = keepers(docs.select(c(id_col).cast("long").alias("doc_id"), size.alias("n_code_points"),
                                 key.alias("digest")))
    stay = groups.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_id"),
                         F.col("keep_len").alias("_len"), F.col("ties").alias("_ties"))
    marked = docs.withColumns({"_digest": key, "_id": c(id_col).cast("long"), "_len": size})
    # Joined on the best row itself, not the group: a key holds its ties only.
    match = [F.col("d._digest") == F.col("s._digest"), F.col("d._id").eqNullSafe(F.col("s._id")),
             F.col("d._len") == F.col("s._len")]
    best = marked.alias("d").join(stay.alias("s"), match).select("d.*", "s._ties")
    # Rows that tie in digest, length and id: one of them stays.
    kept = best.where("_ties = 1").unionByName(best.where("_ties > 1").dropDuplicates(["_digest"]))
    return kept.select(*[c(n) for n in docs.columns])


CHANGE = "digest binary, seq long, action string, outcome string"
CHANGE_ARROW = pa.schema([("digest", pa.binary()), ("seq", pa.int64()), ("action", pa.string()),
                          ("outcome", pa.string())])


def apply_changes(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Run insertions and deletions against an index of live digests.

    ``live`` has digest; ``changes`` has digest, seq (order) and action
    (``insert`` or ``delete``). Returns every change with its outcome (``new``
    or ``duplicate``, ``removed`` or ``absent``) and, with action ``live`` and
    null outcome, each digest that is live afterwards.
    """
    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            out = []
            for key, seq, action in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if action == "delete":
                    out.append((key, seq, action, "removed" if index.delete(key) else "absent"))
                    continue
                known = index.find(key) >= 0
                if not known:
                    index.insert(key, None)
                if action == "insert":
                    out.append((key, seq, action, "duplicate" if known else "new"))
            yield _changes(out)
        rows = [(k, None, "live", None) for k, _ in index.items()]
        for at in range(0, len(rows), 20_000):
            yield _changes(rows[at:at + 20_000])

    both = live.select("digest", F.lit(None).cast("long").alias("seq"), F.lit("live").alias("action")).unionByName(
        changes.select("digest", F.col("seq").cast("long").alias("seq"), "action"))
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "digest").sortWithinPartitions(F.col("seq").asc_nulls_first()).mapInArrow(run, CHANGE)


def _changes(rows):
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, CHANGE_ARROW)], schema=CHANGE_ARROW)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
