"""Observations: filters, checks, privacy, merging and snapping support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.functions.geo import DEGREE_M, haversine_m


def _time(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def filter_bbox(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def filter_time(df: DataFrame, since: str | None = None, until: str | None = None, received_since: str | None = None) -> DataFrame:
    """Open where a bound is None; received_since is exclusive, for paging."""
    for test in (
        since and F.col("observed_at") >= _time(since),
        until and F.col("observed_at") <= _time(until),
        received_since and F.col("received_at") > _time(received_since),
    ):
        if test is not None:
            df = df.filter(test)
    return df


def within_radius(df: DataFrame, lat: float, lon: float, radius_m: float, since: str | None = None) -> DataFrame:
    """Adds distance_m. A box that holds the circle reaches the scan; the exact distance follows."""
    d_lat = radius_m / DEGREE_M * 1.01
    d_lon = d_lat / max(0.01, __import__("math").cos(__import__("math").radians(abs(lat) + d_lat)))
    near = filter_bbox(filter_time(df, since=since), lat - d_lat, lon - d_lon, lat + d_lat, lon + d_lon)
    return near.withColumn("distance_m", haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("distance_m") <= radius_m)


def window_by_clock(df: DataFrame, at: str | Column) -> DataFrame:
    """What a replay at this time may see."""
    return df.filter(F.col("observed_at") <= _time(at))


def age_s(at: str | Column) -> Column:
    return F.unix_timestamp(_time(at)) - F.unix_timestamp("observed_at")


def ttl_counts(df: DataFrame, at: str, ttl_s: int, by: str = "hazard_class") -> DataFrame:
    kept = F.coalesce(age_s(at).between(0, ttl_s), F.lit(False))
    return df.groupBy(by).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def validate_observations(df: DataFrame) -> DataFrame:
    """df with `reason`, null where the row is valid."""
    reason = (
        F.when(F.col("observed_at").isNull() | F.col("received_at").isNull(), "no time")
        .when(F.col("lat").isNull() | F.col("lon").isNull() | (F.abs("lat") > 90) | (F.abs("lon") > 180), "bad position")
        .when(F.col("received_at") < F.col("observed_at"), "received before observed")
        .when(~F.col("polarity").isin(1, -1), "bad polarity")
        .when(~F.col("hazard_class").isin(*config.HAZARDS), "unknown class")
        .when(F.col("depth_mm") < 0, "bad depth")
    )
    return df.withColumn("reason", reason)


def normalise_heat(df: DataFrame, column: str, at_least: float = 40.0) -> DataFrame:
    """+1 where the apparent temperature is a heat hazard, -1 where it is not; rows without one are dropped."""
    return df.filter(F.col(column).isNotNull()).withColumn("polarity", F.when(F.col(column) >= at_least, 1).otherwise(-1))


def coarsen_privacy(df: DataFrame, cutoff: str, grid: float = 0.00135) -> DataFrame:
    """Rows observed before the cutoff snap to a grid of about 150 m; sources that are people are hashed."""
    old = F.col("observed_at") < _time(cutoff)
    person = F.col("source_class").isin("crowd", "app_traversal")
    snap = lambda x: F.when(old, F.round(F.col(x) / grid) * grid).otherwise(F.col(x))
    return df.withColumns({"lat": snap("lat"), "lon": snap("lon"), "source_id": F.when(old & person, F.sha2("source_id", 256)).otherwise(F.col("source_id")), "coarsened": old})


def live_reports(attached: DataFrame, hazards: DataFrame, at: str, window: float = config.REPORT_WINDOW) -> DataFrame:
    """Positive reports on an edge that are inside their class's window and newer than its newest report of clearing. The newest
    clearing is a combined maximum by edge and class, joined back, so a hot edge can be split."""
    age = age_s(at)
    seen = attached.join(F.broadcast(hazards), "hazard_class").filter((age >= 0) & (age <= window * F.col("tau")))
    cleared = seen.filter("polarity = -1").groupBy("edge_id", "hazard_class").agg(F.max("observed_at").alias("cleared"))
    return seen.filter("polarity = 1").join(cleared, ["edge_id", "hazard_class"], "left").filter("cleared IS NULL OR observed_at > cleared")


def gset_merge(a: DataFrame, b: DataFrame, key: str = "id", first: str = "received_at") -> DataFrame:
    """Union by id where the row of `a` wins, then the earliest (of one time, the lowest in the other columns); repeats change nothing."""
    rest = [c for c, kind in a.dtypes if c not in (key, first) and not kind.startswith("map")]
    both = a.withColumn("__from", F.lit(0)).unionByName(b.withColumn("__from", F.lit(1)))
    order = Window.partitionBy(key).orderBy("__from", first, *rest)
    return both.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__from")


def received_cursor(page: DataFrame) -> DataFrame:
    return page.agg(F.max("received_at").alias("next_cursor"), F.count("*").alias("n"))


def insert_absent(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows to append to a store: unknown keys, one row each (the first received; of one time, the lowest in the other columns)."""
    rest = [c for c, kind in new.dtypes if c not in (key, "received_at") and not kind.startswith("map")]
    once = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("received_at", *rest))).filter("__n = 1").drop("__n")
    return once.join(stored.select(key), key, "left_anti")
