"""Exact deduplication: local combining, salted digest groups, then salt winners; full content is compared at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import free_names, partitions, written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_hot: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (binary SHA-256 of the normalised text).

    Texts are equal when they are identical after each run of ASCII white space becomes one space; a null text counts as
    empty. Of equal texts the row with the smallest id stays; null ids come last, and of rows that repeat an id and a text
    one stays. An empty table gives no rows.

    1. Rows with one (digest, salt, text) are combined before the shuffle and merged after it: the text crosses it once for
       each task that holds it. Only digests with more than 1/(4P) of all rows (P shuffle partitions; at most 4P such digests,
       so they may be broadcast) get more than one salt.
    2. Winners of the salts of one (digest, text) are combined. There are at most 8P of them, whatever the input.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    share = max(least_hot, docs.count() // (4 * partitions(spark)))
    hot = rows.groupBy("digest").count().filter(F.col("count") > share).select("digest", F.ceil(F.col("count") / share).alias("salts"))

    salted = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "salts")))
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    merged = salted.groupBy("digest", "salt", "text").agg(F.array_sort(F.collect_list(member)).alias("members"))
    merged = merged.select("digest", "salt", F.when(F.col("salt").isNotNull(), F.col("text")).alias("text"), "members")
    merged = written(merged, "exact-groups").withColumns({"first": F.col("members")[0], "n": F.size("members").cast("long")})

    alone = merged.filter(F.col("salt").isNull()).select("digest", "members", F.col("first").alias("winner"), F.col("n").alias("group_size"), F.lit(True).alias("leads"))
    parts = merged.filter(F.col("salt").isNotNull())
    best = parts.groupBy("digest", "text").agg(F.min(F.struct("first", "salt")).alias("best"), F.sum("n").alias("group_size"))
    again = parts.join(best, ["digest", "text"]).select("digest", "members", F.col("best.first").alias("winner"), "group_size", (F.col("salt") == F.col("best.salt")).alias("leads"))
    each = alone.unionByName(again).select("digest", "winner", "group_size", "leads", F.posexplode("members").alias("at", "member"))
    return each.select(
        F.col("member.doc_id").alias("doc_id"),
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("leads") & (F.col("at") == 0)).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat an id and a text leave one of them, whichever.

    Ids are compared inside a struct, where null equals null: the join then deals rows by the very columns of the last step, so each
    text crosses the network once here.
    """
    keep, digest = free_names(docs, "__keep_id", "__keep_digest")
    keys = exact_groups(docs, id_col, text_col).filter("kept").select(F.struct("doc_id").alias(keep), F.col("digest").alias(digest))
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.withColumns({keep: F.struct(F.col(id_col).alias("doc_id")), digest: F.unhex(F.sha2(norm, 256))})
    return rows.join(keys, [keep, digest], "left_semi").dropDuplicates([keep, digest]).select(docs.columns)
