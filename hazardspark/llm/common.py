"""What the operators share: written tables in the cluster's shared folder, text columns and batches by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.tables import new_path, written

__all__ = ["by_bytes", "free_names", "held", "lower_ascii", "new_path", "partitions", "remove", "text_batches", "written"]

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 8 << 20

_held: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]) -> object:
    """The one large object (a tokenizer's pieces, automata) that a worker process keeps for its next tasks; another key replaces it."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow carry at most so many rows at a time: documents are long, and the default of 10,000 would put tens of MB of text, in
    several copies, into every running task. It stays set for the session, as plans run later than they are made."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column of df (whatever its case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and no other letter changed; pure ASCII takes the built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about `limit` bytes of `column` (one row at least); small batches are put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                held.append(batch.slice(start, i - start))
                yield pa.concat_batches(held)
                held, size, start = [], 0, i
            size += n
        if start < len(sizes):
            held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)
