"""Microwave links and passes at signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rain_rate(loss: Column, base: Column, wet: Column, length_km: Column, a: Column, b: Column) -> Column:
    """Rain in mm/h from the loss above baseline and wet antenna; 0 without any, null without a loss."""
    excess = loss - base - wet
    return F.when(excess > 0, F.pow(excess / length_km / a, 1 / b)).when(loss.isNotNull(), 0.0)


def link_excess(loss: DataFrame, n: int) -> DataFrame:
    """Loss over the median of the last n samples; null with fewer than max(2, n // 2) of them. Nulls are ignored."""
    w = Window.partitionBy("link").orderBy("step").rowsBetween(-n + 1, 0)
    enough = F.count("loss").over(w) >= max(2, n // 2)
    return loss.withColumns({"median": F.when(enough, F.percentile("loss", 0.5).over(w)), "spread": F.when(enough, F.stddev_pop("loss").over(w))}).withColumn("excess", F.col("loss") - F.col("median"))


def dry_baseline(rows: DataFrame, n: int) -> DataFrame:
    """Median of the last n dry samples up to each step, carried through wet ones. rows: link, step, loss, wet."""
    dry = rows.filter(~F.col("wet") & F.col("loss").isNotNull())
    w = Window.partitionBy("link").orderBy("step")
    known = dry.withColumn("base", F.percentile("loss", 0.5).over(w.rowsBetween(-n + 1, 0))).select("link", "step", "base")
    return rows.join(known, ["link", "step"], "left").withColumn("base", F.last("base", ignorenulls=True).over(w))


def slow_runs(rows: DataFrame, slow: Column, by: str, order: str) -> DataFrame:
    """Maximal runs of slow rows: by, run, first, last, n."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("__s", F.coalesce(slow, F.lit(False)))
    islands = marked.withColumn("run", F.sum(F.when(~F.col("__s"), 1).otherwise(0)).over(w)).filter("__s")
    return islands.groupBy(by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def stops_in_pass(rows: DataFrame, by: str = "pass", stop_speed: float = 1.0, min_stop_s: float = 3.0, zone_m: float = 120.0, half: int = 3, least: int = 5) -> DataFrame:
    """(by, start, end, where): the last stop of each pass in the queue before the stop line. rows: by, t (seconds, increasing), s (metres
    along the approach, 0 at the line, negative before it).

    Positions are smoothed by a rolling median of 2 half + 1 samples, speed is the central difference of the smoothed positions over the
    same span. A stop is a maximal run below stop_speed that lasts min_stop_s or longer, with its median smoothed position from zone_m
    before the line to 5 m behind it. Passes of fewer than `least` samples have none.
    """
    line = Window.partitionBy(by).orderBy("t")
    span = line.rowsBetween(-half, half)
    smooth = rows.select(by, "t", F.percentile("s", 0.5).over(span).alias("sm"), F.count("*").over(Window.partitionBy(by)).alias("n")).filter(F.col("n") >= least)
    ends = lambda c: (F.first(c).over(span), F.last(c).over(span))
    (s0, s1), (t0, t1) = ends("sm"), ends("t")
    moved = smooth.withColumn("slow", F.when(t1 > t0, (s1 - s0) / (t1 - t0)).otherwise(0.0) < stop_speed)
    runs = moved.withColumn("run", F.sum(F.when(F.col("slow"), 0).otherwise(1)).over(line)).filter("slow")
    found = runs.groupBy(by, "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.percentile("sm", 0.5).alias("where"))
    kept = found.filter((F.col("end") - F.col("start") >= min_stop_s) & F.col("where").between(-zone_m, 5.0))
    return kept.groupBy(by).agg(F.max(F.struct("start", "end", "where")).alias("b")).select(by, "b.*")


def cycle_candidates(departures: DataFrame, by: str, t: str, lo: float = 40.0, hi: float = 180.0, step: float = 0.25) -> DataFrame:
    """Mean resultant length of departure times wrapped on each candidate cycle. Each row is met with every candidate, then sums are
    combined before the shuffle."""
    cycles = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int((hi - lo) / step))), lambda i: F.lit(lo) + i * step)).alias("cycle")
    each = departures.select(by, t, cycles).withColumn("phase", 2 * F.pi() * F.col(t) / F.col("cycle"))
    sums = each.groupBy(by, "cycle").agg(F.sum(F.cos("phase")).alias("x"), F.sum(F.sin("phase")).alias("y"), F.count("*").alias("n"))
    offset = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)) / (2 * math.pi) * F.col("cycle")
    return sums.select(by, "cycle", (F.hypot("x", "y") / F.col("n")).alias("resultant"), "n", offset.alias("offset_s"))


def choose_cycle(candidates: DataFrame, by: str, least: float = 0.5, alias: float = 0.9, least_n: int = 8) -> DataFrame:
    """(by, n, cycle, resultant, offset_s): the cycle of each site, null where it has too few departures or none is periodic enough.

    Multiples of a shorter period explain the departures as well, so the longest candidate within `alias` of the best resultant is taken,
    and moved up and then down to the local peak it lies on. candidates: a bounded number for each site."""
    r, every = F.col("resultant"), Window.partitionBy(by)
    line = every.orderBy("cycle")
    rows = candidates.withColumns({
        "best": F.max(r).over(every), "tops": F.lead(r).over(line).isNull() | (F.lead(r).over(line) < r), "bottoms": F.lag(r).over(line).isNull() | (F.lag(r).over(line) <= r),
    })
    rows = rows.withColumn("k", F.max(F.when(r >= alias * F.col("best"), F.col("cycle"))).over(every))
    rows = rows.withColumn("k", F.min(F.when(F.col("tops") & (F.col("cycle") >= F.col("k")), F.col("cycle"))).over(every))
    rows = rows.withColumn("k", F.max(F.when(F.col("bottoms") & (F.col("cycle") <= F.col("k")), F.col("cycle"))).over(every))
    good = (F.col("best") >= least) & (F.col("n") >= least_n)
    return rows.filter(F.col("cycle") == F.col("k")).select(by, "n", *[F.when(good, F.col(c)).alias(c) for c in ("cycle", "resultant", "offset_s")])


def red_and_delay(passes: DataFrame, by: str, quantile: float = 0.9, least_stops: int = 8, least_passes: int = 10) -> DataFrame:
    """passes (by, wait_s: null without a stop, delay_s: null where the pass is not usable): red seconds, as waits of random arrivals lie
    evenly between none and the red, and the median and 85th percentile of delays; null with too few."""
    out = passes.groupBy(by).agg(F.count("wait_s").alias("stops"), F.count("delay_s").alias("usable"), F.percentile("wait_s", quantile).alias("w"), F.percentile("delay_s", 0.5).alias("m"), F.percentile("delay_s", 0.85).alias("p"))
    delay = lambda c: F.when(F.col("usable") >= least_passes, F.col(c))
    return out.select(by, "stops", F.when(F.col("stops") >= least_stops, F.col("w") / quantile).alias("red_s"), "usable", delay("m").alias("delay_median_s"), delay("p").alias("delay_p85_s"))
