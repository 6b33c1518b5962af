"""Packing documents into token sequences by swap-based local search.

Documents are tokenised, closed with an end id and cut into pieces of at most
one sequence. Pieces are dealt into blocks of bounded size; in a block they
are placed largest first where they fit best, then improved: the emptiest
sequences give up pieces by moves, one-for-one and two-for-one exchanges, each
of which increases the sum of squared fills, until a pass over all of them
empties none. What still lies in loosely filled sequences is dealt into new
blocks and packed again, until one block holds the rest.

Defined results: a null text counts as empty (the end id alone); repeated rows
and ids are packed each; an empty table gives no rows; extra columns are
ignored whatever their names. Ties in length keep the order of the block.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerline.llm.arrowtext import SLICE, coded_words, text_slices, tidy
from ledgerline.llm.common import c, cut

PIECES_PER_BLOCK = 16_384
LOOSE = 0.9  # sequences filled below this share are opened again in the next round


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Texts to token ids, word by word, through a bounded store of letter runs.

    The tokenizer's own pre-tokenizer drops white space and never joins across
    it, so the ids of a text are those of its words in order. A batch is split
    and its distinct words numbered by Arrow; ids are looked up per distinct
    word and spread with numpy. New words of plain Latin letters go straight to
    the tokenizer's model; anything else goes through the whole tokenizer.
    """

    FULL = 200_000  # runs in the store, none longer than LONG characters: some 35 MB
    LONG = 64
    # The pre-tokenizer's split pattern, a fixed value of the tokenizer, for
    # characters below U+0250 (there the numbers are the digits and these six).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+"

    def __init__(self, path: str, full: int = FULL):
        import os
        import re

        self.full = full

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = re.compile(self.SPLIT).findall
        self.runs: dict[str, bytes] = {}
        # Byte-level alphabet: printable Latin-1 stands for itself, the other
        # bytes for the code points from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.alphabet = [chr(b) if b in plain else chr(next(other)) for b in range(256)]

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            symbols = run if run.isascii() else "".join(self.alphabet[b] for b in run.encode())
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(symbols)])
            if len(run) <= self.LONG:
                self.runs[run] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ascii_only = word.isascii()
        if word.isprintable() and "<|" not in word and (
                ascii_only or max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)):
            low = word.lower()
            return self._run(low) if low.isalpha() else b"".join(map(self._run, self.split(low)))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _ids(self, distinct: list[str]) -> list[bytes]:
        if len(self.runs) > self.full:
            self.runs.clear()
        return [self._word(word) if word else b"" for word in distinct]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end (from 0)."""
        distinct, code, word_ends = coded_words(texts)
        ids = self._ids(distinct)
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        size = sizes[code]
        end = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first[code] - end[:-1], size)
        at += np.arange(len(at))
        return flat[at], end[word_ends]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                          ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int,
               id_col: str, text_col: str, stored_runs: int = WordIds.FULL, chars: int = SLICE) -> DataFrame:
    """Documents to pieces of at most ``capacity`` ids, ``chars`` characters at once."""
    end = np.array([end_id], "<u4")

    def run(batches):
        ids_of = WordIds(tokenizer, stored_runs)  # of this task: its store goes with it
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, texts in text_slices(batch.column(1), chars):
                flat, ends = ids_of.encode(texts)
                out = []
                for k in range(len(ends) - 1):
                    ids = np.concatenate([flat[ends[k]:ends[k + 1]], end])
                    out += [(docs[first + k], p, at, min(capacity, len(ids) - at), zlib.crc32(ids[at:at + capacity]))
                            for p, at in enumerate(range(0, len(ids), capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*out), PIECES_ARROW)], schema=PIECES_ARROW)

    return docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).alias("text")).mapInArrow(tidy(run), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest bin with room: bins of item numbers."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if room > size:
            if not by_room[room - size]:
                rooms |= 1 << (room - size)
            by_room[room - size].append(b)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges, each of which raises the sum of squared fills.

    Bins give up their items from the least filled one on, as long as any exchange
    helps; what room there is gathers in few bins, which fall empty. Ends at the
    lower bound of bins, or with a pass over all bins that empties none.
    """
    search = _Search(bins, lengths, capacity)
    fewest = -(-sum(lengths) // capacity)
    left, before = len(bins), None
    while left > fewest and left != before:
        before = left
        for low in sorted(np.flatnonzero(search.fill < capacity).tolist(), key=lambda b: search.fill[b]):
            held = len(search.bins[low])
            while search.bins[low] and search.exchange(low):
                pass
            left -= held > 0 and not search.bins[low]
            if left <= fewest:
                break
    return [b for b in search.bins if b]


class _Search:
    """The bins of a block, and for any of them the best exchange with a fuller one."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity = capacity
        self.bins = [list(b) for b in bins]
        self.size = np.array(lengths, np.int64)
        self.home = np.empty(len(lengths), np.int64)
        for b, items in enumerate(self.bins):
            self.home[items] = b
        self.fill = np.array([self.size[b].sum() for b in self.bins], np.int64)

    def _upto(self, sums: np.ndarray) -> np.ndarray:
        """For 0 to capacity, the largest of ``sums`` that is not larger (0: none)."""
        best = np.zeros(self.capacity + 1, np.int64)
        best[sums] = sums
        return np.maximum.accumulate(best)

    def exchange(self, low: int) -> bool:
        """The exchange of ``low`` with a fuller bin that raises the sum of squares most:
        a piece moves, replaces a smaller one, or two pieces replace a smaller one."""
        own = np.unique(self.size[self.bins[low]])
        one = self._upto(own)
        open_bins = np.flatnonzero((self.fill >= self.fill[low]) & (self.fill < self.capacity))
        open_bins = open_bins[open_bins != low]
        if not len(open_bins):
            return False
        usable = np.zeros(len(self.fill), bool)
        usable[open_bins] = True
        items = np.flatnonzero(usable[self.home])
        # The most that may come in place of an item: its own size and its bin's room.
        most = self.size[items] + self.capacity - self.fill[self.home[items]]
        moves = one[self.capacity - self.fill[open_bins]]
        choices = [(self._gain(low, open_bins, moves), open_bins, moves, False),
                   (self._gain(low, self.home[items], one[most] - self.size[items]), items, one[most], True)]
        sums = self._pair_sums(low, own)
        if len(sums):
            two = self._upto(sums)[most]
            choices.append((self._gain(low, self.home[items], two - self.size[items]), items, two, True))
        (value, at), where, give, swap = max(choices, key=lambda x: x[0][0])
        if value <= 0:
            return False
        total = int(give[at])
        pieces = self._pieces(low, total, 2 if len(choices) == 3 and where is items and give is choices[2][2] else 1)
        back = [int(where[at])] if swap else []
        high = int(self.home[back[0]]) if swap else int(where[at])
        for source, goal, moved in ((low, high, pieces), (high, low, back)):
            for i in moved:
                self.bins[source].remove(i)
                self.bins[goal].append(i)
                self.home[i] = goal
        gain = total - int(self.size[back].sum())
        self.fill[high] += gain
        self.fill[low] -= gain
        return True

    def _gain(self, low: int, bins: np.ndarray, gain: np.ndarray) -> tuple[int, int]:
        """(half the growth of the sum of squares, which) of the best of some exchanges."""
        grows = np.where(gain > 0, gain * (self.fill[bins] - self.fill[low] + gain), 0)
        at = int(np.argmax(grows))
        return int(grows[at]), at

    def _pair_sums(self, low: int, own: np.ndarray) -> np.ndarray:
        """Sums of two pieces of a bin, up to capacity."""
        if len(self.bins[low]) < 2:
            return own[:0]
        count = np.bincount(self.size[self.bins[low]])
        apart = (own[:, None] + own[None, :])[~np.eye(len(own), dtype=bool)]
        sums = np.unique(np.concatenate([apart, 2 * own[count[own] > 1]]))
        return sums[sums <= self.capacity]

    def _pieces(self, low: int, total: int, number: int) -> list[int]:
        """Pieces of a bin, one or two, of ``total`` together."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[low]:
            by_size.setdefault(int(self.size[i]), []).append(i)
        if number == 1:
            return by_size[total][:1]
        for size, first in by_size.items():
            other = by_size.get(total - size, [])
            if other and (total != 2 * size or len(first) > 1):
                return [first[0], other[1] if total == 2 * size else other[0]]
        raise AssertionError("a sum of two pieces that the bin does not hold")


def _pack_block(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        place, offset, fills = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                place[i], offset[i] = b, at
                at += lengths[i]
            for i in items:
                fills[i] = at
        for name, values in (("place", place), ("offset", offset), ("fill", fills)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Rows with ``length`` (1 to ``capacity``) to the same rows with
    ``sequence_id`` and ``offset``, gapless from 0 in each sequence."""
    names = pieces.columns
    rest = cut(pieces.withColumn("_row", F.monotonically_increasing_id()))
    done, turn = None, 0
    n = rest.count()
    while True:
        blocks = max(1, -(-n // PIECES_PER_BLOCK))
        dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
        schema = T.StructType([*dealt.schema, *(T.StructField(x, T.LongType()) for x in ("place", "offset", "fill"))])
        packed = cut(dealt.groupBy("_block").applyInArrow(_pack_block(capacity), schema))
        sequence = (F.lit(turn << 56) + F.col("_block") * F.lit(1 << 20) + F.col("place")).alias("sequence_id")
        again = (F.col("fill") < F.lit(LOOSE * capacity)) if blocks > 1 else F.lit(False)
        kept = packed.where(~again).select(*[c(x) for x in names], sequence, "offset")
        done = kept if done is None else done.unionByName(kept)
        loose = packed.where(again).select(*[c(x) for x in names], "_row")
        left = loose.count() if blocks > 1 else 0
        if not left:
            return done
        if left == n:  # nothing fills a sequence: larger blocks would not help either
            return done.unionByName(packed.where(again).select(*[c(x) for x in names], sequence, "offset"))
        rest, n, turn = loose, left, turn + 1


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", stored_runs: int = WordIds.FULL,
                   chars: int = SLICE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    ``stored_runs`` and ``chars`` trade a worker's memory for time, not results.
    """
    pieces = cut_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col, stored_runs, chars)
    return pack(pieces, capacity)
