"""Packing token sequences into fixed windows by best-fit decreasing.

A document is tokenized whole and cut into full windows plus a remainder. The
pieces are dealt evenly, without a key, into groups of bounded size; each group
is one task, where a segment tree indexed by remaining capacity finds the
tightest open window for every piece, longest first. Each window of a group is
one sequence, padded to the window size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.arrays import raw_bytes
from pagesift.llm.common import prepare, table, written
from pagesift.llm.token_ids import tokenizer_for, with_end_id

WINDOW = 2048
# pieces packed together by one task; bounds its memory at any input size
GROUP_PIECES = 16_384

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW,
                     keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of each document (``doc_id``, ``text``).

    A null or empty text has just the end id. ``ids_crc32`` is taken over the
    piece's ids as little-endian unsigned 32-bit integers; ``keep_ids`` adds
    the ids themselves as ``ids array<int>``. Other columns are ignored."""

    def run(batches):
        tok = tokenizer_for(tokenizer_path, "spaces")
        for batch in batches:
            ids, off = with_end_id(*tok.encode(batch.column(1)), end_id)
            n_tokens = np.diff(off)
            n_pieces = -(-n_tokens // window)
            doc = np.repeat(np.arange(len(n_tokens)), n_pieces)
            start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
            length = np.minimum(window, n_tokens[doc] - start)
            begin = off[:-1][doc] + start
            view = raw_bytes(ids.astype("<u4"))
            crc = [zlib.crc32(view[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist())]
            out = {"doc_id": batch.column(0).take(pa.array(doc)), "start": pa.array(start, pa.int64()),
                   "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                   "doc_tokens": pa.array(n_tokens[doc], pa.int64())}
            if keep_ids:  # pieces lie in document order, so their ends are the list offsets
                out["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.append(begin, off[-1]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = _PIECE + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class BestFit:
    """Open windows by remaining capacity; leaf ``c`` of the segment tree counts
    the windows with ``c`` free places, inner nodes say whether any is below."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.window = window
        self.any = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.n_windows = 0

    def _set(self, free: int, has: int):
        i = free + self.size
        self.any[i] = has
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, length: int) -> int:
        """Smallest free capacity that still holds ``length``; 0 if none."""
        i = length + self.size
        while not self.any[i]:
            while i & 1:  # a right child: go up until there is a sibling to the right
                i >>= 1
            if i == 0:
                return 0
            i += 1
            if i & (i - 1) == 0:  # wrapped around to the left edge
                return 0
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece."""
        free = self.tightest(length)
        if free:
            w = self.open[free].pop()
            if not self.open[free]:
                self._set(free, 0)
        else:
            w, free = self.n_windows, self.window
            self.n_windows += 1
        left = free - length
        if left:
            if not self.open[left]:
                self._set(left, 1)
            self.open[left].append(w)
        return w, self.window - free


def pack_pieces(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (any other columns ride along).

    ``pieces`` are dealt round robin into ``groups`` tasks: no key decides where
    a piece goes, so no document or length can make one task large."""

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        fit, base = BestFit(window), TaskContext.get().partitionId() << 32
        placed = [fit.place(n) for n in t.column("length").to_pylist()]
        t = t.append_column("sequence_id", pa.array([base + w for w, _ in placed], pa.int64()))
        t = t.append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from t.to_batches(max_chunksize=4096)

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(groups).mapInArrow(run, cols + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW,
                   group_pieces: int = GROUP_PIECES, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``window`` ids.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens (with the end id), sequence_id, offset, and ``ids``
    if asked for. Every id lies in exactly one piece; offsets are gapless from
    0. Null and empty texts pack just the end id; repeated rows are packed as
    often as they come; null doc_ids stay null; an empty table gives no rows;
    other columns of ``docs`` are ignored. Sequence ids are unique, not dense."""
    pieces = written(tokenized_pieces(docs, tokenizer_path, end_id, window, keep_ids), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    return pack_pieces(pieces, groups, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Padded training rows (sequence_id, ids, n_ids) from pieces that kept their
    ids; a sequence is at most ``window`` ids, so each group is small."""
    runs = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return (packed.groupBy("sequence_id").agg(F.flatten(runs).alias("ids"))
            .withColumn("n_ids", F.size("ids"))
            .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids")))))


def op1_packing(spark, sf_dir):
    """All documents packed into 2048-token sequences."""
    import public_tokenizers
    prepare(spark)
    return pack_documents(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), end_id=1)
