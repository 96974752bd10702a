"""As-of join without a range join: queries and rows in one ordered stream by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(asked: DataFrame, rows: DataFrame, key: str, at: str, t: str) -> DataFrame:
    """asked with `last` (newest time at or before `at`) and `visible` (number of such rows). Rows are counted by key and time before
    the shuffle, so repeated reports do not travel."""
    seen = rows.groupBy(key, F.col(t).alias("__t")).agg(F.count("*").alias("__n")).withColumn("__asked", F.lit(0))
    ask = asked.select(key, F.col(at).alias("__t"), F.lit(0).cast("long").alias("__n"), F.lit(1).alias("__asked"))
    w = Window.partitionBy(key).orderBy("__t", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    both = seen.unionByName(ask).withColumns({"last": F.last(F.when(F.col("__asked") == 0, F.col("__t")), ignorenulls=True).over(w), "visible": F.sum("__n").over(w)})
    return both.filter("__asked = 1").select(key, F.col("__t").alias(at), "last", "visible")
