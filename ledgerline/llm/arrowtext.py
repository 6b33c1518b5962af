"""Arrow texts in pieces of bounded size, and their words as numbers."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000  # characters handled at once, except for longer single texts
ROWS = 1_000  # rows of a batch between Spark and a worker while texts go through it


def text_slices(texts: pa.Array, limit: int = SLICE):
    """(first row, some rows) with at most ``limit`` characters or one row; nulls
    become empty texts."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + limit, "right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words are runs outside [\\x20\\x09-\\x0D]. (distinct words, number of each
    word in the order of the texts, where each text's words end: one entry more
    than texts, from 0)."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    # White space at either end of a text leaves an empty string, which is no word.
    real = np.fromiter((w != "" for w in distinct), bool, len(distinct))[code]
    return distinct, code[real], np.concatenate([[0], np.cumsum(real)])[ends]


@contextlib.contextmanager
def small_batches(spark):
    """Arrow batches of ROWS rows for what is run inside: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def text_batches(spark) -> None:
    """Let the session pass whole texts to Python in batches of ROWS rows, unless its
    batch size has been set: for results whose Python stage runs in the caller's write."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(ROWS))


def tidy(run):
    """``run`` over a task's batches; then give freed memory back to the system, since
    the worker process stays for later tasks."""
    def whole(batches):
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole
