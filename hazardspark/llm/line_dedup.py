"""Line deduplication by levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.common import SPACES, free_names, lower_ascii, new_path, partitions, remove, written

_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Runs of the 128-bit hashes of all keys met so far, each a table bucketed and sorted by hash; a level that holds
    `fanout` runs is compacted into one run of the next level. Buckets let a batch, shuffled once by hash, be merged with
    every run without shuffling the runs."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: dict[int, list[tuple[str, str]]] = {}

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def _compact(self, level: int) -> None:
        runs = self.levels.get(level, [])
        if len(runs) < self.fanout:
            return
        merged = self.spark.table(runs[0][0]).filter("NOT seen")
        for name, _ in runs[1:]:
            merged = merged.unionByName(self.spark.table(name).filter("NOT seen"))
        self.levels.setdefault(level + 1, []).append(self._write(merged))
        self.levels[level] = []
        for run in runs:
            self._drop(run)
        self._compact(level + 1)

    def absorb(self, lines: DataFrame) -> DataFrame:
        """lines (h, doc_id, rid, pos) of documents whose ids follow all earlier ones: (rid, doc_id, pos) of the lines to drop. A line goes
        if an earlier batch or a smaller id of this batch holds its key. The batch's new keys become a run."""
        firsts = lines.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        seen = F.lit(False)
        for i, (name, _) in enumerate(run for runs in self.levels.values() for run in runs):
            firsts = firsts.join(self.spark.table(name).filter("NOT seen").select("h", F.lit(True).alias(f"in_{i}")), "h", "left")
            seen = seen | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        run = self._write(firsts.select("h", "first_id", "last_id", seen.alias("seen")))
        twice = self.spark.read.schema(self.spark.table(run[0]).schema).parquet(run[1]).filter("seen OR last_id > first_id")  # by path: no buckets, so a hot key's lines can be split
        dropped = lines.join(twice, "h").filter("seen OR doc_id > first_id").select("rid", "doc_id", "pos")
        dropped = written(dropped, "line-drops")
        self.levels.setdefault(0, []).append(run)
        self._compact(0)
        return dropped

    def close(self) -> None:
        for runs in self.levels.values():
            for run in runs:
                self._drop(run)
        self.levels = {}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with repeated lines taken out of text_col, and n_lines and n_dropped (long) per row.

    A text is split at \\n (null or empty: one empty line). A line's key is the line without ASCII white space at its ends, A-Z in
    lower case. Keys of at least least_chars code points that two or more ids hold lose all their lines but those of the smallest
    id. Rows that share an id count as one document; a null id counts as the largest. Documents come in `batches` by ascending id.
    A column of docs named n_lines or n_dropped is replaced.
    """
    spark = docs.sparkSession
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    ids = docs.select(number.alias("doc_id"), rid.alias("rid"), F.col(text_col).alias("text"))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    lines = ids.select("doc_id", "rid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least_chars)
    batch = sum((F.when(F.col("doc_id") > F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    lines = written(lines.select("doc_id", "rid", "pos", F.unhex(F.md5("key")).alias("h"), batch.alias("batch")), "lines", "batch")

    runs = LineRuns(spark, fanout)
    try:
        drops = [runs.absorb(lines.filter(F.col("batch") == b).select("h", "doc_id", "rid", "pos")) for b in range(len(cuts) + 1)]
    finally:
        runs.close()
    own_rid, own_id, gone_at, all_lines = free_names(docs, "__rid", "__id", "__gone", "__lines")
    gone = drops[0]
    for d in drops[1:]:
        gone = gone.unionByName(d)
    gone = gone.groupBy(F.col("rid").alias(own_rid), F.col("doc_id").alias(own_id)).agg(F.array_sort(F.collect_set("pos")).alias(gone_at))

    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # kept lines are the stretches between dropped positions: as many slices as drops, each line copied once
    stretch = lambda k: F.slice(
        F.col(all_lines),
        F.when(k == 0, 1).otherwise(F.get(gone_at, k - 1) + 2),
        F.coalesce(F.get(gone_at, k), F.size(all_lines)) - F.when(k == 0, 0).otherwise(F.get(gone_at, k - 1) + 1),
    )
    text = F.when(F.col(gone_at).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone_at)), stretch)), "\n"))
    keyed = docs.withColumns({own_rid: rid, own_id: number})
    kept = keyed.join(gone, [own_rid, own_id], "left").withColumn(all_lines, parts)
    counts = {"n_lines": F.size(all_lines).cast("long"), "n_dropped": F.coalesce(F.size(gone_at), F.lit(0)).cast("long")}
    out = kept.withColumns({text_col: text} | counts)
    return out.select(*[c for c in docs.columns if c not in counts], *counts)
