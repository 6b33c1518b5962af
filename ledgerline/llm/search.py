"""Ranked lexical search: accumulators from short lists, skipping over long ones.

The index is a table of segments. A segment holds the documents of a bounded
amount of text and, for each of their terms, the ordinals of the documents that
hold it and how often. A search joins the index with the terms of a block of
queries (a bounded broadcast) and scores each segment in one group.

Inside a segment a query is answered by a hybrid of two orders. Its short lists
are taken term at a time: their contributions are summed into accumulators.
The accumulators then act as one more list, bounded by their largest sum, beside
the long lists, each bounded by its largest contribution. These lists are taken
document at a time: those that cannot reach the k-th best score together name
no document of their own, candidates come from the rest, stretch by stretch in
document order, and are dropped as soon as the bounds of what is unread cannot
lift them there; long lists are entered by binary search only where a
candidate is left. The k-th largest accumulator starts the score to be reached.
Nothing is approximate: a document is skipped only when its score is surely lower.

Scores are the integers of the contract in ``search``: weights from documents
and terms counted over the whole table.

Defined results: a null text, or one without a term, is a document that is not
counted and never found; repeated rows, ids and query items are ranked each;
ties go by ascending id, null last; an empty table of documents or queries
gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.llm.arrowtext import coded_words, tidy
from ledgerline.llm.common import c, cut

SEGMENT = 8_000_000  # characters of text in a segment, or one longer text
QUERY_BYTES = 4_000_000  # terms of a block of queries, about: the size of the broadcast
SHORT = 16  # a list is short if it holds less than 1/SHORT of a segment's documents
STRETCH = 2_048  # documents taken at once
# ASCII other than letters and digits separates terms; all other characters belong to them.
LETTERS = string.digits + string.ascii_letters
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = "segment long, term string, n_docs long, n_terms long, docs binary, counts binary"
INDEX_ARROW = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()),
                         ("n_terms", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
NO_ID = np.iinfo(np.int64).min  # a null id in the bytes of an index row


def _folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a blank for each separating character."""
    table = bytearray(range(256))
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b) in LETTERS else 32
    flat = pa.concat_arrays([pc.fill_null(texts, "")])
    _, offsets, data = flat.buffers()
    if data is None:
        return flat
    folded = pa.py_buffer(data.to_pybytes().translate(bytes(table)))
    return pa.Array.from_buffers(flat.type, len(flat), [None, offsets, folded], offset=flat.offset)


def _segment(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row for the documents (term null: ids and lengths) and one per term."""
    terms, code, ends = coded_words(_folded(texts))
    lengths = np.diff(ends).astype(np.int64)
    n = len(lengths)
    pair, count = np.unique(code.astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    held, first = np.unique(pair // n, return_index=True)  # terms without a posting are left out
    at = np.concatenate([first, [len(pair)]])

    def lists(values):
        return pa.Array.from_buffers(pa.binary(), len(held), [
            None, pa.py_buffer((at * 4).astype("<i4").tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])

    per_term = pa.RecordBatch.from_arrays([
        pa.array(np.full(len(held), number)), pa.array(terms, pa.string()).take(pa.array(held)),
        pa.array(np.diff(at)), pa.array(np.add.reduceat(count, first) if len(held) else first),
        lists(pair % n), lists(count)], schema=INDEX_ARROW)
    known = pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
        ([number], [None], [int((lengths > 0).sum())], [int(lengths.sum())], [known], [lengths.astype("<i8").tobytes()]),
        INDEX_ARROW)], schema=INDEX_ARROW)
    return whole, per_term


def _segments(batches):
    from pyspark import TaskContext

    number, chars = TaskContext.get().partitionId() << 32, 0
    ids, texts = [], []
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, size in enumerate(sizes):
            if chars and chars + size > SEGMENT:
                ids.append(batch.column(0).slice(start, row - start))
                texts.append(batch.column(1).slice(start, row - start))
                yield from _segment(number, pa.concat_arrays(ids), pa.concat_arrays(texts))
                number, chars, ids, texts, start = number + 1, 0, [], [], row
            chars += size
        ids.append(batch.column(0).slice(start))
        texts.append(batch.column(1).slice(start))
    if sum(map(len, ids)):
        yield from _segment(number, pa.concat_arrays(ids), pa.concat_arrays(texts))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents and all their terms, a written table: per segment
    a row without a term (docs: ids, counts: lengths, 8 bytes each) and a row per
    term (docs: ordinals in the segment, counts: occurrences, 4 bytes each);
    n_docs and n_terms are the documents with a term, and the terms, of the row."""
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).alias("text"))
    return cut(rows.mapInArrow(tidy(_segments), INDEX))


def top_k(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinals, scores) of the k best documents, best first, of one query in one
    segment. ``lists``: per term the ordinals, ascending, and contributions (> 0);
    ``ids`` decides ties, the least first."""
    n = len(ids)
    short = [x for x in lists if len(x[0]) * SHORT < n]
    summed = np.zeros(n, np.int64)
    for docs, part in short:  # term at a time
        summed[docs] += part
    held = np.flatnonzero(summed)
    queue = [x for x in lists if len(x[0]) * SHORT >= n] + ([(held, summed[held])] if len(held) else [])
    queue.sort(key=lambda x: x[1].max())
    bound = np.cumsum([x[1].max() for x in queue])  # the most that the lists up to each can add
    reach = 1
    if len(held) >= k:
        reach = max(reach, int(np.partition(summed[held], -k)[-k]))
    best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, place = 0, [0] * len(queue)
    while True:
        first = int(np.searchsorted(bound, reach, "left"))  # lists before it cannot reach alone
        ahead = [int(queue[i][0][place[i]]) for i in range(first, len(queue)) if place[i] < len(queue[i][0])]
        if not ahead:
            break
        at = max(at, min(ahead))
        stop = min(n, at + STRETCH)
        total = np.zeros(stop - at, np.int64)
        for i in range(first, len(queue)):
            docs, part = queue[i]
            low, high = place[i] + np.searchsorted(docs[place[i]:], (at, stop))
            total[docs[low:high] - at] += part[low:high]
            place[i] = high
        found = np.flatnonzero(total)
        value, found = total[found], found + at
        for i in range(first - 1, -1, -1):  # the other lists, the largest bound first
            stay = value + bound[i] >= reach
            found, value = found[stay], value[stay]
            if not len(found):
                break
            docs, part = queue[i]
            spot = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            value = value + np.where(docs[spot] == found, part[spot], 0)
        stay = value >= reach
        best, score = np.concatenate([best, found[stay]]), np.concatenate([score, value[stay]])
        order = np.lexsort((ids[best], -score))[:k]
        best, score = best[order], score[order]
        if len(best) == k:
            reach = max(reach, int(score[-1]))
        at = stop
    return best, score


FOUND = "_q long, doc_id long, score long"
FOUND_ARROW = pa.schema([("_q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _score(n_docs: int, n_terms: int, k: int):
    """A segment's index rows, each term with its weight and queries, to its best k of each query."""
    def run(table: pa.Table) -> pa.Table:
        terms = table.column("term")
        whole = table.filter(pc.is_null(terms))
        table = table.filter(pc.is_valid(terms))
        ids = np.frombuffer(whole.column("docs")[0].as_py(), "<i8")
        norm = 100 - 90 + 90 * np.frombuffer(whole.column("counts")[0].as_py(), "<i8") * n_docs // n_terms
        rank = np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)
        of: dict[int, list] = {}
        for row in range(table.num_rows):
            weight = table.column("weight")[row].as_py()
            if not weight:
                continue
            docs = np.frombuffer(table.column("docs")[row].as_py(), "<u4").astype(np.int64)
            tf = np.frombuffer(table.column("counts")[row].as_py(), "<u4").astype(np.int64)
            part = weight * (10**9 * tf // (1000 * tf + 8 * norm[docs]))
            real = part > 0
            if not real.all():
                docs, part = docs[real], part[real]
            if len(docs):
                for q in table.column("queries")[row].as_py():
                    of.setdefault(q, []).append((docs, part))
        out = [[], [], []]
        for q, lists in of.items():
            best, score = top_k(lists, rank, k)
            out[0] += [q] * len(best)
            out[1] += [None if i == NO_ID else int(i) for i in ids[best]]
            out[2] += score.tolist()
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], schema=FOUND_ARROW)

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text",
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every query row.

    N: documents with a term; L: all their terms; n: one document's. A term in
    df documents weighs w = floor(1000 ln((2N+2)/(2df+1))); m = 10 + 90 n N div L;
    the score sums w * ((1000000000 tf) div (1000 tf + 8 m)) over the query's
    distinct terms. Queries go in blocks of about ``query_bytes`` of terms.
    """
    spark = index.sparkSession
    size = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(x or 0) for x in size)
    folded = F.translate(c(text_col), string.ascii_uppercase, string.ascii_lowercase)
    asked = cut(queries.select(c(id_col).alias("item_id"), F.monotonically_increasing_id().alias("_q"),
                               F.array_distinct(F.split(F.coalesce(folded, F.lit("")), SEPARATORS)).alias("terms")))
    wanted = asked.select("item_id", "_q", F.explode("terms").alias("term")).where("term <> ''")
    volume = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, -(-int(volume) // query_bytes))
    found = None
    for block in range(blocks):
        words = wanted.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block).groupBy("term").agg(
            F.collect_list("_q").alias("queries"))
        # A block is about query_bytes, or one query: that bounds both broadcasts.
        words = cut(words)
        df = index.join(F.broadcast(words.select("term")), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
        weighed = cut(words.join(df, "term").select("term", "queries", weight.alias("weight")))
        rows = index.select("segment", "term", "docs", "counts").join(F.broadcast(weighed), "term", "left").where(
            F.col("term").isNull() | F.col("queries").isNotNull())
        part = cut(rows.groupBy("segment").applyInArrow(_score(n_docs, max(n_terms, 1), k), FOUND))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("_q", "item_id"), "_q").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), size AS (
  SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0
), q AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark
), qt AS (
  SELECT q, item_id, unnest(terms) AS term FROM q
), tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(size.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, size GROUP BY term
), scored AS (
  SELECT q, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * tf.n * size.n) // size.l)))) AS BIGINT) AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY rank <= 10
"""
