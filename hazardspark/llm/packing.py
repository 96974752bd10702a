"""Packing documents into fixed windows by the online sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import by_bytes, text_batches
from hazardspark.llm.pieces import encoder

Piece = tuple[int | None, int, np.ndarray, int]  # document id, ids before it in its document, ids, ids of the whole document


class Packer:
    """Windows of `size` ids. counts[h] is the number of open windows filled to level h.

    A piece goes to the level (0: a new window) that leaves the least sum of squared counts over levels 1 to size - 1; of equal
    levels the fullest. Windows that become full are closed. When more than `most_open` windows are open, and at the end, open
    windows are filled up from the emptiest ones, whose pieces are cut to fit, so at most one window is left with a gap. The bound is
    one of memory: open windows hold their ids (4 bytes each), which is at most 16 MB a task for 4,096 windows of 1,024.
    """

    def __init__(self, size: int, first_id: int, most_open: int = 4096):
        self.size, self.next_id, self.most_open = size, first_id, most_open
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level(self, n: int) -> int:
        top = self.size - n
        new = 2 * self.counts[n : n + top + 1] + 1
        new[-1] = 0  # a window that becomes full leaves the levels
        change = new - np.where(np.arange(top + 1) > 0, 2 * self.counts[: top + 1] - 1, 0)
        change = np.where((self.counts[: top + 1] > 0) | (np.arange(top + 1) == 0), change, np.iinfo(np.int64).max)
        return top - int(np.argmin(change[::-1]))

    def _closed(self, pieces: list[Piece]) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1
        return rows

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            yield from self._closed([(doc, start, ids[start : start + self.size], len(ids))])
        rest = ids[whole:]
        if not len(rest):
            return
        h = self.level(len(rest))
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        pieces.append((doc, whole, rest.copy(), len(ids)))  # a view would keep its whole batch
        if h + len(rest) == self.size:
            yield from self._closed(pieces)
            return
        self.open.setdefault(h + len(rest), []).append(pieces)
        self.counts[h + len(rest)] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        while windows:
            pieces = windows.pop(0)
            gap = self.size - sum(len(p[2]) for p in pieces)
            while gap and windows:
                doc, start, ids, total = windows[-1].pop()
                if len(ids) > gap:
                    windows[-1].append((doc, start, ids[: len(ids) - gap], total))
                    start, ids = start + len(ids) - gap, ids[len(ids) - gap :]
                pieces.append((doc, start, ids, total))
                gap -= len(ids)
                if not windows[-1]:
                    windows.pop()
            yield from self._closed(pieces)


def pack(docs: DataFrame, tokenizer: str, kind: str = "space", size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset) of every piece; ids are little-endian unsigned 32 bit.

    A document is the ids of its whole text (null: empty) by the plain library call without added special tokens (a control string
    in the text gets its own id), and end_id. Every input partition is packed on its own as it is read, so
    nothing is shuffled, memory holds the open windows only, and a lost task packs the same rows again. sequence_id is unique and
    ascends within a partition (partition number times 2^33 and a count); a partition leaves one window with a gap at most. Ids are
    cast to long; an id that is no whole number raises. Rows that repeat an id are documents of their own, a null id stays null, an empty
    table gives no rows; columns that are not named are not read.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer, kind, 350_000), Packer(size, TaskContext.get().partitionId() << 33)

        def batch(found: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*found, strict=True) if found else ((),) * 6
            raw = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), raw, pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in by_bytes(it, limit=4 << 20):
            out: list[tuple] = []
            ids, ends = enc.encode_flat(b["text"], end_id)
            for doc, first, end in zip(b["doc_id"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out.extend(packer.add(doc, ids[first:end]))
            yield batch(out)
        yield batch(list(packer.finish()))

    return rows.mapInArrow(batches, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
