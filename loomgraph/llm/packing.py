"""Packing of documents into token windows by the online sum-of-squares rule.

Each task packs the documents of its partition as they come. A level array
counts the open windows by fill; a remainder goes to the level whose choice
leaves the smallest sum of squared counts. Whole windows of a long document
close at once. At the end of a partition the windows still open are cut up to
fill one another, and the last tokens make windows of powers of two, so no
window of the result holds padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from loomgraph.llm.common import table
from loomgraph.llm.tokens import codec, default_path

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)

#: A piece: document, first token's place in it, its ids, all tokens of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Open windows by fill level. place() returns a window's pieces once it is full."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # the level array; level 0 and full windows count nothing
        self.open: dict[int, list[list[Piece]]] = {}

    def level(self, length: int) -> int:
        """The level h with an open window (0: a new one) and h + length <= size that adds least to the sum of squares."""
        n = self.count
        last = self.size - length
        # taking a window off level h changes its square by 1 - 2 n[h], putting it on h + length by 2 n + 1, on size by 0
        change = 2 * n[length : length + last + 1] + 1
        change[last] = 0
        change[1:] += 1 - 2 * n[1 : last + 1]
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        best = np.flatnonzero(change == change.min())
        return int(best[-1])  # of equal choices the fullest window

    def place(self, piece: Piece) -> list[Piece] | None:
        length = len(piece[2])
        h = self.level(length)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append(piece)
        if h + length == self.size:
            return window
        self.count[h + length] += 1
        self.open.setdefault(h + length, []).append(window)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The open windows, fullest first, each filled from the emptiest; then windows of powers of two."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.count[:] = {}, 0
        flow = [p for w in left for p in w]  # in this order windows mostly keep their pieces together
        total = sum(len(p[2]) for p in flow)
        sizes = [self.size] * (total // self.size)
        tail = total % self.size
        sizes += [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        at, used = 0, 0
        for size in sizes:
            window, room = [], size
            while room:
                doc, start, ids, n = flow[at]
                part = ids[used : used + room]
                window.append((doc, start + used, part, n))
                room -= len(part)
                used += len(part)
                if used == len(ids):
                    at, used = at + 1, 0
            yield window


def _packer(path: str, size: int, end: int, batch_rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        levels = SumOfSquares(size)
        serial = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def close(window: list[Piece]) -> None:
            nonlocal serial
            offset = 0
            for doc, start, ids, n in window:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, serial, offset))
                offset += len(ids)
            serial += 1

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)
            rows.clear()
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end))
                n = len(ids)
                whole = n - n % size
                for start in range(0, whole, size):
                    close([(doc, start, ids[start : start + size], n)])
                if whole < n:
                    full = levels.place((doc, whole, ids[whole:].copy(), n))
                    if full:
                        close(full)
                if len(rows) >= batch_rows:
                    yield out()
        for window in levels.rest():
            close(window)
            if len(rows) >= batch_rows:
                yield out()
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, end: int = 0) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit), by window.

    Every document's ids are followed by `end`; a null or empty text is that
    one id. A null doc_id stays null; repeated rows are packed row by row; an
    empty table gives no rows. Other columns of docs are ignored. sequence_id
    depends on the partitions docs is read in, and is unique among them.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packer(tokenizer or default_path(), size, end), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their windows; edge rows as in pack()."""
    return digest(pack(table(spark, sf_dir, "documents")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; edge rows as in pack(): a null or empty text is its end, columns beside doc_id and text do not matter."""
    return digest(pack(docs))
