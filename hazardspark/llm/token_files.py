"""Token-ID files: frequency-ranked ids in byte-aligned variable length with separate control bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import by_bytes, new_path, partitions, text_batches, written
from hazardspark.llm.pieces import encoder

#: For each control byte: the byte lengths (1 to 4) of its four values, and which of 4 bytes each value has in the data.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
PRESENT = np.arange(4)[None, None, :] < LENGTHS[:, :, None]
BLOCK_IDS = 1 << 18


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its bytes less one, four values a byte) and data bytes (little-endian)."""
    v = np.ascontiguousarray(values, dtype="<u4")
    extra = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    quads = np.concatenate([extra, np.zeros(-len(extra) % 4, np.uint8)]).reshape(-1, 4)
    control = (quads << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    present = PRESENT[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[present] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _tokens(docs: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, at, doc_id, n, ids, seen): rows in ascending id; at counts the ids before the row in its part, a range of doc ids. The
    last row of each part is none of a document (at is null): its `seen` holds how often each id occurs in the part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    names = ["part", "at", "doc_id", "n", "ids", "seen"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        seen = np.zeros(0, dtype=np.int64)
        for b in by_bytes(it):
            ids, ends = enc.encode_flat(b["text"], end_id)
            got = np.bincount(ids, minlength=len(seen))
            got[: len(seen)] += seen
            seen, n = got, np.diff(ends)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            columns = [np.full(len(n), part, np.int32), at + ends[:-1], b["doc_id"], n, raw, pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds, strict=True)], names)
            at += int(ends[-1])
        last = [part, None, None, None, None, seen.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(last, kinds, strict=True)], names)

    return rows.mapInArrow(batches, "part int, at long, doc_id long, n long, ids binary, seen binary")


def _frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) of the ids in all documents; at most as many rows as the vocabulary."""

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for raw in (x for b in it for x in b["seen"].to_pylist()):
            got = np.frombuffer(raw, np.int64)
            if len(got) > len(total):
                total, got = got.copy(), total
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    return tokens.filter("at IS NULL").select("seen").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "drop", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, and end_id after each, below path in ascending id (rows that repeat an id by text; null
    ids first).

    Ids are those of the plain library call without added special tokens: a control string in a text gets its own id.
    path/blocks holds, in Parquet (so Spark commits and reads them in any store), blocks of about 2^18 ids: the documents' ids and
    token counts, the control bytes and the data bytes of the ids' ranks. path/ranks lists the ids by falling frequency over the
    whole corpus (ties by id), so the most frequent 256 take one byte. Null texts count as empty; an empty table has no blocks. Ids are cast to
    long; an id that is no whole number raises.
    """
    spark = docs.sparkSession
    text_batches(spark)
    width = 2 if end_id < 1 << 16 and encoder(tokenizer, kind).width == 2 else 4
    tokens = written(_tokens(docs, tokenizer, kind, end_id, id_col, text_col), "tokens")
    ranked = _frequencies(tokens).orderBy(F.desc("n"), "id").collect()  # the vocabulary at most
    order = np.array([r["id"] for r in ranked], dtype=np.int64)
    spark.createDataFrame(list(enumerate(order.tolist())), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
    rank[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            values = shared.value[np.frombuffer(b"".join(r[4] for r in held), f"<u{width}")]
            control, data = encode_values(values)
            columns = [[held[0][0]], [held[0][1]], [len(values)], [[r[2] for r in held]], [[r[3] for r in held]], [control], [data]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "at", "n_ids", "doc_ids", "counts", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in it:
            for row in zip(*(b[c].to_pylist() for c in ("part", "at", "doc_id", "n", "ids")), strict=True):
                follows = held and held[-1][0] == row[0] and held[-1][1] + held[-1][3] == row[1]
                if held and (not follows or size + row[3] > BLOCK_IDS):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    rows = tokens.filter("at IS NOT NULL").select("part", "at", "doc_id", "n", "ids")
    rows.mapInArrow(blocks, "part int, at long, n_ids long, doc_ids array<bigint>, counts array<bigint>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document: start counts the ids of all documents before it; ids are little-endian unsigned 32 bit."""
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    shared = spark.sparkContext.broadcast(order)
    sizes = blocks.groupBy("part").agg(F.max(F.col("at") + F.col("n_ids")).alias("n"))  # a row for each part written
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for start, n_ids, docs, counts, control, data in zip(*(b[c].to_pylist() for c in ("start", "n_ids", "doc_ids", "counts", "control", "data")), strict=True):
                ids = shared.value[decode_values(control, data, n_ids)]
                ends = np.cumsum(counts)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts, strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    located = blocks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at"))
    return located.select("start", "n_ids", "doc_ids", "counts", "control", "data").mapInArrow(documents, "doc_id long, start long, ids binary")


def token_file_path(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
