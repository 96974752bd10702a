"""Rain: gauges, slices, forecasts, levels and their holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.rules import level_number, rain_level


def daily_max(readings: DataFrame) -> DataFrame:
    return readings.filter("mm >= 0").groupBy("gauge", "day").agg(F.max("mm").alias("mm"))


def city_median(daily: DataFrame, least: int = 5) -> DataFrame:
    return daily.groupBy("day").agg(F.percentile("mm", 0.5).alias("median_mm"), F.count("*").alias("gauges")).filter(F.col("gauges") >= least)


def rain_events(medians: DataFrame, wet_mm: float, by: list[str] | None = None) -> DataFrame:
    """Runs of days with a median of at least wet_mm, in each place (by); a gap of more than a day splits. One row a day and place goes in."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("day")
    wet = medians.filter(F.col("median_mm") >= wet_mm)
    runs = wet.withColumn("new", F.when(F.datediff("day", F.lag("day").over(w)) <= 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    found = runs.groupBy(*by, "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.max("median_mm").alias("max_mm"), F.sum("median_mm").alias("sum_mm"))
    return found.withColumn("event_id", F.concat(F.lit("rain-"), F.col("first_day").cast("string"))).drop("run")


def day_number(day: str = "day") -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def previous_days_sum(medians: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of the two calendar days before, in each place (by); null unless both are there."""
    w = Window.partitionBy(*(by or [])).orderBy(day_number()).rangeBetween(-2, -1)
    return medians.withColumn("prev2_mm", F.when(F.count("median_mm").over(w) == 2, F.sum("median_mm").over(w)))


def rolling(panel: DataFrame, value: str, key: str, days: list[int]) -> DataFrame:
    """Sums over the last k rows of each key, and the largest of the last 7; shorter at the start."""
    back = lambda k: Window.partitionBy(key).orderBy("day").rowsBetween(-k + 1, 0)
    return panel.withColumns({f"r{k}": F.sum(value).over(back(k)) for k in days} | {"mx7": F.max(value).over(back(7))})


def normalised_features(panel: DataFrame, train_until: str) -> DataFrame:
    """Rolling rain over each place's own scale: the training span's 95th percentile of wet days and of 3-day sums; day of year."""
    rows = rolling(panel, "mm", "district", [3, 7])
    train = rows.filter(F.col("day") < F.lit(train_until).cast("date"))
    scale = train.groupBy("district").agg(
        F.greatest(F.lit(1.0), F.coalesce(F.percentile(F.when(F.col("mm") >= 1, F.col("mm")), 0.95), F.lit(1.0))).alias("wet_p95"), F.greatest(F.lit(1.0), F.percentile("r3", 0.95)).alias("p95_3d")
    )
    angle = 2 * F.pi() * F.dayofyear("day") / 366
    out = rows.join(scale, "district", "left").withColumns({"wet_p95": F.coalesce("wet_p95", F.lit(1.0)), "p95_3d": F.coalesce("p95_3d", F.lit(1.0))})
    return out.select("district", "day", (F.col("mm") / F.col("wet_p95")).alias("n_r0"), (F.col("r3") / F.col("p95_3d")).alias("n_r3"), F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos"))


def accumulation(slices: DataFrame, n: int = 6, slot_s: int = 1800, by: list[str] | None = None) -> DataFrame:
    """Over the last n slices of each place (by): rain (mean rate times half an hour), peak and missing slices. One row a slice goes in."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("slot").rangeBetween(-(n - 1) * slot_s, 0)
    return slices.select(*by, "slot", (F.sum("mean_mm_h").over(w) * slot_s / 3600).alias("acc_mm"), F.max("peak_mm_h").over(w).alias("peak_mm_h"), (n - F.count("*").over(w)).alias("missing"))


def forecast_ahead(hourly: DataFrame, ahead_s: int = 43200, least: int = 9, by: list[str] | None = None) -> DataFrame:
    """hourly (t, mm; of each place in by): three-hour sums where all three stamps are there, and the largest of them in the next 12 h if at least 9 are."""
    place = Window.partitionBy(*(by or [])).orderBy("t")
    three = place.rangeBetween(-7200, 0)
    ahead = place.rangeBetween(1, ahead_s)
    sums = hourly.withColumn("mm3", F.when(F.count("mm").over(three) == 3, F.sum("mm").over(three)))
    return sums.withColumn("max3_ahead", F.when(F.count("mm3").over(ahead) >= least, F.max("mm3").over(ahead)))


def area_mean(points: DataFrame, n: int) -> DataFrame:
    """Mean over all n points of a time; null unless every one is valid."""
    return points.groupBy("t").agg(F.when(F.count("mm") == n, F.avg("mm")).alias("mm"))


def state_holds(levels: DataFrame, active_s: int = 6 * 3600, watch_s: int = 12 * 3600, by: list[str] | None = None) -> DataFrame:
    """levels (t, level 0 to 2; of each place in by): active is held 6 h after it was last read, watch 12 h after watch or more was."""
    w = Window.partitionBy(*(by or [])).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda at: F.last(F.when(F.col("level") >= at, F.col("t")), ignorenulls=True).over(w)
    state = F.when(F.col("t") - last(2) <= active_s, 2).when(F.col("t") - last(1) <= watch_s, 1).otherwise(0)
    return levels.withColumn("state", state)


def with_levels(signals: DataFrame, **limits: tuple[float, float]) -> DataFrame:
    level = rain_level(F.col("acc_mm"), F.col("peak_mm_h"), **limits)
    return signals.withColumns({"name": level, "level": level_number(level)})


def wet_episodes(levels: DataFrame, by: str, gap_s: int) -> DataFrame:
    """Maximal runs of steps at watch or more in each period; a missing step ends a run."""
    w = Window.partitionBy(by).orderBy("t")
    wet = levels.filter("level >= 1")
    runs = wet.withColumn("run", F.sum(F.when(F.col("t") - F.lag("t").over(w) <= gap_s, 0).otherwise(1)).over(w))
    return runs.groupBy(by, "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("steps"), F.max("level").alias("top"))


def shifted(levels: DataFrame, seconds: list[int]) -> DataFrame:
    """Levels at set times before (negative) or after each step; null where there is none."""
    out = levels
    for s in seconds:
        name = f"at_{'m' if s < 0 else 'p'}{abs(s) // 3600}h"
        out = out.join(levels.select((F.col("t") - s).alias("t"), F.col("level").alias(name)), "t", "left")
    return out


def window_levels(levels: DataFrame, windows: DataFrame, cell_s: int = 86400) -> DataFrame:
    """windows (window_id, lo, hi, expected): highest level inside, steps at watch or more, and whether it is as expected. Windows are dealt
    to the days they touch, so a step meets those of its day only."""
    day = lambda x: F.floor(F.col(x) / cell_s)
    dealt = windows.withColumn("__d", F.explode(F.sequence(day("lo"), day("hi"))))
    rows = levels.withColumn("__d", day("t")).join(dealt, "__d").filter((F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi")))
    return rows.groupBy("window_id").agg(F.max("level").alias("top"), F.count_if(F.col("level") >= 1).alias("wet_steps"), (F.max("level") == F.first("expected")).alias("as_expected"))


def contingency(rows: DataFrame, warned: Column, happened: Column) -> DataFrame:
    """Hits, misses, false alarms, correct negatives, rows left out (either unknown), POD and FAR."""
    n = rows.agg(
        F.count_if(warned & happened).alias("hits"), F.count_if(~warned & happened).alias("misses"), F.count_if(warned & ~happened).alias("false_alarms"), F.count_if(~warned & ~happened).alias("correct"),
        F.count_if(warned.isNull() | happened.isNull()).alias("excluded"),
    )
    return n.withColumns({"pod": F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), "far": F.try_divide(F.col("false_alarms"), F.col("hits") + F.col("false_alarms"))})


def slice_stats(pixels: DataFrame, legend: DataFrame, tolerance: int = 6) -> DataFrame:
    """pixels (slot, r, g, b, n): legend rate (r, g, b, mm_h) of the same colour, else of the nearest within `tolerance` in each channel
    (ties to the lower rate), else unmatched; mean over all pixels. The legend is a fixed small table."""
    colours = pixels.select("r", "g", "b").distinct()
    far = F.greatest(F.abs(F.col("p.r") - F.col("l.r")), F.abs(F.col("p.g") - F.col("l.g")), F.abs(F.col("p.b") - F.col("l.b")))
    near = colours.alias("p").join(F.broadcast(legend).alias("l"), far <= tolerance).groupBy("p.r", "p.g", "p.b").agg(F.min(F.struct(far.alias("d"), "l.mm_h")).alias("m"))
    rows = pixels.join(near.select("r", "g", "b", "m.mm_h"), ["r", "g", "b"], "left")
    return rows.groupBy("slot").agg(F.sum("n").alias("pixels"), F.sum(F.when(F.col("mm_h").isNull(), F.col("n")).otherwise(0)).alias("unmatched"), (F.sum(F.coalesce("mm_h", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("mean_mm_h"), F.max("mm_h").alias("peak_mm_h"))


def profile_event_windows(daily: DataFrame, events: DataFrame, before: int, after: int, wet_mm: float) -> DataFrame:
    """(event_id, n, gauges, p50, p90, wet_share) of the readings in an event's district from `before` days ahead of it to `after` days behind
    it; events without a reading have n = 0. daily: gauge, district, day, mm; events: event_id, district, first_day, last_day. Both meet by
    district and month, so a district's readings are not all held against all its events."""
    month = lambda d: F.year(d) * 12 + F.month(d)
    span = events.select("event_id", "district", F.date_sub("first_day", before).alias("__a"), F.date_add("last_day", after).alias("__b")).withColumn("__m", F.explode(F.sequence(month("__a"), month("__b"))))
    met = span.join(daily.withColumn("__m", month("day")), ["district", "__m"]).filter(F.col("day").between(F.col("__a"), F.col("__b")))
    share = F.avg(F.when(F.col("mm") >= wet_mm, 1.0).otherwise(0.0))
    found = met.groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("gauge").alias("gauges"), F.percentile("mm", 0.5).alias("p50"), F.percentile("mm", 0.9).alias("p90"), share.alias("wet_share"))
    return events.select("event_id").join(found, "event_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "gauges": F.coalesce("gauges", F.lit(0))})
