"""Field logs: checks, the merge of server and phone rows, and the board of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (8.0, 76.0, 14.5, 81.0)
CONTENT = ["site_id", "state", "depth_band", "volunteer", "observed_at"]


def validate_field_log(df: DataFrame, now: str) -> DataFrame:
    """df with positions rounded to four places and `reason`, null where the row is valid."""
    at, south_west_north_east = F.lit(now).cast("timestamp"), BOUNDS
    south, west, north, east = south_west_north_east
    adhoc = F.col("site_id") == "adhoc"
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    reason = (
        F.when(~F.col("state").isin("passable", "not_passable", "unknown"), "unknown state")
        .when(~F.col("site_id").rlike(r"^[a-z0-9][a-z0-9_-]{1,31}$"), "bad site id")
        .when(F.col("depth_band").isNotNull() & (F.col("state") != "not_passable"), "depth needs not_passable")
        .when(adhoc & (F.col("lat").isNull() | F.col("lon").isNull()), "adhoc needs a position")
        .when(adhoc & ~inside, "outside the region")
        .when(~adhoc & (F.col("lat").isNotNull() | F.col("lon").isNotNull()), "position of a known site")
        .when(F.col("observed_at") > at + F.expr("INTERVAL 5 MINUTES"), "in the future")
        .when(F.col("observed_at") < at - F.expr("INTERVAL 14 DAYS"), "too old")
    )
    return df.withColumns({"reason": reason, "lat": F.bround("lat", 4), "lon": F.bround("lon", 4)})


def merge_field_logs(server: DataFrame, phone: DataFrame) -> DataFrame:
    """(entry_id, content columns, outcome): in_both, conflict (the server's row stays), restored (phone only), server, rejected,
    invalid. Rows that repeat an id keep the first by observed_at and volunteer."""
    once = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy("entry_id").orderBy("observed_at", "volunteer", "state"))).filter("__n = 1").drop("__n")
    s = once(server).select("entry_id", F.struct(*CONTENT).alias("s"))
    p = once(phone).select("entry_id", F.struct(*CONTENT).alias("p"), "sync_status")
    both = s.join(p, "entry_id", "full")
    invalid = F.col("p.depth_band").isNotNull() & (F.col("p.state") != "not_passable")
    outcome = (
        F.when(F.col("p").isNull(), "server")
        .when(F.col("sync_status") == "rejected", "rejected")
        .when(invalid, "invalid")
        .when(F.col("s").isNull(), "restored")
        .when(F.col("s").eqNullSafe(F.col("p")), "in_both")
        .otherwise("conflict")
    )
    return both.withColumns({"outcome": outcome, "kept": F.coalesce("s", "p")}).select("entry_id", "kept.*", "outcome")


def site_board(log: DataFrame, sites: DataFrame, now: str, stale_hours: float = 6.0, window_s: int = 1800) -> DataFrame:
    """One row for each site: latest state and age, observers, whether the last two resolved entries disagree."""
    by_site = Window.partitionBy("site_id").orderBy("observed_at", "entry_id")
    resolved = log.filter(F.col("state").isin("passable", "not_passable"))
    last = lambda k: F.lag(k).over(by_site)
    apart = F.unix_timestamp("observed_at") - F.unix_timestamp(last("observed_at"))
    pairs = resolved.withColumn("disagree", F.coalesce((last("volunteer") != F.col("volunteer")) & (last("state") != F.col("state")) & (apart <= window_s), F.lit(False)))
    newest = pairs.groupBy("site_id").agg(F.max_by("disagree", F.struct("observed_at", "entry_id")).alias("disagree"))
    latest = log.groupBy("site_id").agg(
        F.max_by(F.struct("state", "observed_at"), F.struct("observed_at", "entry_id")).alias("latest"), F.count("*").alias("entries"), F.count_distinct("volunteer").alias("observers")
    )
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest.observed_at")) / 3600
    board = sites.join(latest, "site_id", "left").join(newest, "site_id", "left")
    return board.select(
        "site_id", F.col("latest.state").alias("state"), F.round(age, 2).alias("age_hours"), (age > stale_hours).alias("stale"),
        F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("observers", F.lit(0)).alias("observers"), F.coalesce("disagree", F.lit(False)).alias("disagree"),
    )


def lag_summary(log: DataFrame) -> DataFrame:
    lag = (F.unix_timestamp("received_at") - F.unix_timestamp("observed_at")).alias("lag")
    return log.select(lag).agg(F.percentile("lag", 0.5).alias("median"), F.percentile("lag", 0.95).alias("p95"), F.max("lag").alias("most"), F.count("*").alias("n"))


def hourly_counts(log: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows beyond `limit` in the hour before them, by key."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp("received_at")).rangeBetween(-3600, 0)
    return log.withColumn("in_hour", F.count("*").over(w)).withColumn("limited", F.col("in_hour") > limit)
