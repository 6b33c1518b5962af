"""Fill-in-middle transformation of whole texts, cut by word-wide UTF-8 scans.

The UTF-8 bytes of a batch of texts are viewed as 64-bit words. Arithmetic on
whole words marks each byte that ends a code point (the byte after it is no
continuation byte); the marks of a word are counted at once and summed over the
words. A cut after the g-th code point is then found in two steps: a search in
the running counts names the word, and a select inside that word the byte. No
text is decoded, and a text of any length costs one pass.

A document's cuts, form and order come from a hash of its id alone, so reruns
agree. ``plain`` leaves the text as it is; ``psm`` writes prefix, suffix,
middle and ``spm`` suffix, prefix, middle behind their marks. A text that
holds a mark stays plain, so a marked output splits at its marks in one way
and the exact text comes back.

Defined results: a null text counts as empty, which is plain; a null id hashes
like an empty one; repeated rows are transformed each; an empty table gives no
rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.arrowtext import text_slices, tidy
from ledgerline.llm.common import c

MARKS = ("<P>", "<S>", "<M>")
HIGH = np.uint64(0x8080808080808080)  # bit 7 of every byte
ONES = np.uint64(0x0101010101010101)


class Units:
    """Code points of a run of UTF-8 bytes, found through 64-bit words."""

    def __init__(self, data: bytes | memoryview):
        raw = np.frombuffer(data, np.uint8)
        words = np.zeros(len(raw) // 8 + 2, "<u8")  # zero bytes behind the text end its last unit
        words.view(np.uint8)[:len(raw)] = raw
        # A continuation byte has bit 7 set and bit 6 clear.
        starts = (words & ~(words << np.uint64(1)) & HIGH) ^ HIGH
        self.ends = starts >> np.uint64(8)  # a byte ends a unit if the next one starts one
        self.ends[:-1] |= starts[1:] << np.uint64(56)
        self.upto = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def rank(self, offset: np.ndarray) -> np.ndarray:
        """Units that end before each byte offset."""
        word = offset >> 3
        below = (np.uint64(1) << (8 * (offset & 7)).astype(np.uint64)) - np.uint64(1)
        inside = np.bitwise_count(self.ends[word] & below).astype(np.int64)
        return np.where(word > 0, self.upto[word - 1], 0) + inside

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Byte offset behind the nth unit, counted from 1."""
        word = np.searchsorted(self.upto, nth, "left")
        inside = nth - np.where(word > 0, self.upto[word - 1], 0)
        # Byte j of the product counts the marks of bytes 0 to j (8 at most), so
        # one subtraction leaves bit 7 where that count reaches the one sought.
        counts = (self.ends[word] >> np.uint64(7)) * ONES
        reached = ((counts | HIGH) - inside.astype(np.uint64) * ONES) & HIGH
        return word * 8 + 9 - np.bitwise_count(reached).astype(np.int64)


def cut_points(texts: pa.Array, first: np.ndarray, second: np.ndarray):
    """(bytes of all texts, their offsets, code points of each, byte offsets of both cuts).

    ``first`` and ``second`` are hashes: reduced to 0..n they are the two cuts,
    in code points, the smaller one first.
    """
    flat = pa.concat_arrays([texts]).cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64, len(flat) + 1, flat.offset * 8)
    data = memoryview(b"" if data is None else data)[at[0]:at[-1]]
    at = at - at[0]
    units = Units(data)
    before = units.rank(at)
    n = np.diff(before)
    one, two = first % (n + 1), second % (n + 1)
    cuts = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        cuts.append((k, np.where(k > 0, units.select(np.maximum(before[:-1] + k, 1)), at[:-1])))
    return data, at, n, cuts


OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
OUTPUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                          ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(plain_from: int, spm_below: int):
    prefix, suffix, middle = (m.encode() for m in MARKS)

    def run(batches):
        for batch in batches:
            hashes = [h.to_numpy() for h in batch.columns[2:]]
            for first, texts in text_slices(batch.column(1)):
                rows = slice(first, first + len(texts))
                h1, h2, h3, h4 = (h[rows] for h in hashes)
                data, at, n, ((low, a), (high, b)) = cut_points(texts, h1, h2)
                marked = np.zeros(len(texts), bool)
                for m in MARKS:
                    marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
                plain = (n == 0) | marked | (h3 % 100 >= plain_from)
                spm = h4 % 100 < spm_below
                out = []
                for i in range(len(texts)):
                    start, x, y, end = at[i], a[i], b[i], at[i + 1]
                    if plain[i]:
                        out.append(data[start:end])
                    elif spm[i]:
                        out.append(b"".join((suffix, data[y:end], prefix, data[start:x], middle, data[x:y])))
                    else:
                        out.append(b"".join((prefix, data[start:x], suffix, data[y:end], middle, data[x:y])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array(n),
                    pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))),
                    pa.array(low, mask=plain), pa.array(high - low, mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string())], schema=OUTPUT_ARROW)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every document.

    ``seed`` and the id are hashed; of a hundred documents those from
    ``plain_from`` on stay plain, and of the others those below ``spm_below``
    are spm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(text_col), F.lit("")).alias("text"),
                       digest.alias("_h")).select("doc_id", "text", *hashes)
    return rows.mapInArrow(tidy(_transform(plain_from, spm_below)), OUTPUT)


def restored(form: Column, output: Column) -> Column:
    """The exact text from an output and its form: marked outputs split at the marks."""
    prefix, suffix, middle = (F.get(F.split(output, "<[PSM]>", -1), i) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(suffix, middle, prefix)).otherwise(output))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, t, n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4
  FROM d
), f AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), o AS (
  SELECT *, CASE form
    WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p) END AS output
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
