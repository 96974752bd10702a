"""Shards whose mixture of sources matches the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import partitions, written


def assign_shards(docs: DataFrame, shards: int = 16, seed: str = "interleave-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, source, shard, slot. Law `rows`: counts at most one apart.

    Rows of each source are shuffled by MD5 of seed and id, row r of n gets the fraction (2r-1)/2n, and the order by fraction
    (then source, hash, id, size, checksum) is cut into equal shards, so each shard takes every source in proportion. A null
    source is a source of its own, a null id hashes as an empty one, a null text has size 1; rows alike in all of these are
    interchangeable. Ranks are exact: rows are ranked inside buckets of hash (of each source), then inside ranges of the whole
    order, and a small table of counts gives each one's start. So no source, however large, meets in one task, nor do the rows of
    many sources of one row, whose fractions are all one half. Texts are not moved. Rows of equal texts are not kept together: law
    `rows` cannot always do so, and their shard follows from source and id alone. An empty table gives no rows; columns other than
    the three named are not read.
    """
    spark = docs.sparkSession
    text, doc_id = F.col(text_col), F.col(id_col)
    buckets = max(64, 4 * partitions(spark))  # of hash, in each source
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))).alias("k"),
    )
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("k", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28)).cast("int"))
    order = ["k", "doc_id", "size", "text_crc32"]

    by_stratum = Window.partitionBy("stratum")
    starts = rows.groupBy("stratum", "b").agg(F.count("*").alias("n")).select(
        "stratum", "b", F.sum("n").over(by_stratum).alias("total"), (F.sum("n").over(by_stratum.orderBy("b")) - F.col("n")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("stratum", "b").orderBy(*order)) + F.col("before")
    ranked = rows.join(starts, ["stratum", "b"]).withColumn("fraction", (2 * rank - 1) / (2 * F.col("total")))
    ranked = ranked.select("doc_id", "size", "text_crc32", "stratum", "k", "fraction")
    dealt = ranked.repartitionByRange(partitions(spark), "fraction", "stratum", *order)
    ranked = written(dealt.withColumn("f", F.spark_partition_id()), "shard-ranks")

    counts = ranked.groupBy("f").agg(F.count("*").alias("n"))  # a row for each range
    starts = counts.select("f", (F.sum("n").over(Window.orderBy("f")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("f").orderBy("fraction", "stratum", *order)) + F.col("before") - 1
    placed = ranked.join(F.broadcast(starts), "f").withColumn("place", place).withColumn("shard", F.expr(f"place * {shards} div total"))
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.when(F.col("stratum") != "n", F.substring("stratum", 2, 1 << 30)).alias("source"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"place - (shard * total + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: str = "interleave-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """Writes docs (whose ids are unique) as Parquet below path, one folder per shard, rows in slot order within each file."""
    placed = assign_shards(docs, shards, seed, id_col, text_col, source_col).select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.drop("shard", "slot").join(placed, docs[id_col].eqNullSafe(placed["__id"])).drop("__id")
    rows.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
