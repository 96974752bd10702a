"""Structured Streaming forms of ingest, rain windows, event state, beliefs and privacy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazardspark import config
from hazardspark.functions.belief import kernel, reliability_weight
from hazardspark.functions.rules import level_number, rain_level
from hazardspark.operators.observations import coarsen_privacy, validate_observations

ACTIVE_HOLD_S, WATCH_HOLD_S, STALE_S, FORECAST_WATCH_MM = 6 * 3600, 12 * 3600, 12 * 3600, 8.0
ERA = 300  # e^300 is far below what a double holds


def ingest(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """Valid observations, each id once, however often it is sent. The watermark runs on arrival, so reports that were made long ago still
    count; ids are remembered for `late`, in RocksDB, which is set for the session (`rocksdb`)."""
    rocksdb(stream.sparkSession)
    valid = validate_observations(stream).filter("reason IS NULL").drop("reason")
    return valid.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["id"])


def rain_windows(slices: DataFrame, late: str = "2 hours", length: str = "3 hours", slide: str = "30 minutes", n: int = 6) -> DataFrame:
    """slices (ts, mean_mm_h, peak_mm_h): accumulation, peak and missing slices of each window."""
    w = F.window("ts", length, slide)
    sums = slices.withWatermark("ts", late).groupBy(w).agg((F.sum("mean_mm_h") / 2).alias("acc_mm"), F.max("peak_mm_h").alias("peak_mm_h"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "acc_mm", "peak_mm_h", (n - F.col("n")).alias("missing"))


def wet_sessions(slices: DataFrame, wet_mm_h: float, by: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of wet slices of each place, ended by a gap."""
    wet = slices.filter(F.col("mean_mm_h") >= wet_mm_h).withWatermark("ts", late)
    out = wet.groupBy(by, F.session_window("ts", gap)).agg(F.count("*").alias("slices"), F.max("peak_mm_h").alias("peak_mm_h"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "slices", "peak_mm_h")


def enrich(stream: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Observations with the edge they are snapped to and their source's reliability; the static sides are joined as they are read."""
    return stream.join(edges, "edge_id").join(F.broadcast(sources), "source_class")


class _EventState(StatefulProcessor):
    """One region: the newest fresh signal and the last ones at the active and the watch level, each a state of its own, and an event-time
    timer 12 h behind the newest."""

    def __init__(self, configured: int, timed: bool):
        self.configured, self.timed = configured, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = [handle.getValueState(name, "at long") for name in ("active", "watch", "newest")]

    def _load(self) -> list[int | None]:
        return [s.get()[0] if s.exists() else None for s in self.states]

    def _save(self, values: list[int | None]) -> None:
        for state, value in zip(self.states, values, strict=True):
            if value is not None:
                state.update((value,))
            elif state.exists():
                state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        region, out = key[0], []
        active_at, watch_at, newest = before = self._load()
        table = pd.concat(list(rows))
        names = ("t", "level", "manual", "stale", "forecast_mm")
        for t, level, manual, stale, forecast in sorted(zip(*(table[n].tolist() for n in names), strict=True), key=lambda r: (r[0], r[1])):
            if self.timed and newest is not None and t > newest + STALE_S:  # the timer's row, where this batch runs past it
                out.append((region, newest + STALE_S, self.configured))
                active_at = watch_at = newest = None
            if not stale and (newest is None or t > newest):  # only newer satellite times extend a hold
                active_at = t if level >= 2 else active_at
                watch_at = t if level >= 1 else watch_at
                newest = t
            held = 2 if active_at is not None and t - active_at <= ACTIVE_HOLD_S else 1 if watch_at is not None and t - watch_at <= WATCH_HOLD_S else 0
            trusted = not stale and newest is not None and t - newest <= STALE_S
            auto = (max(held, 1) if held == 0 and pd.notna(forecast) and forecast >= FORECAST_WATCH_MM else held) if trusted else self.configured
            out.append((region, t, int(manual) if pd.notna(manual) else auto))
        self._save([active_at, watch_at, newest])
        if self.timed and newest != before[2]:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if newest is not None:
                self.handle.registerTimer((newest + STALE_S) * 1000)
        yield pd.DataFrame(out, columns=["region", "t", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self._load()[2]
        self._save([None, None, None])
        yield pd.DataFrame([(key[0], newest + STALE_S, self.configured)] if newest is not None else [], columns=["region", "t", "state"])

    def close(self) -> None:
        pass


def event_states(signals: DataFrame, configured: int = 0, late: str | None = None) -> DataFrame:
    """signals (region, t, acc_mm, peak_mm_h, manual, and optionally stale and forecast_mm): the state of each region after each signal,
    with holds of 6 h (active) and 12 h (watch).

    `manual` overrides; a stale signal extends no hold and gives the configured state; a forecast of 8 mm or more in three hours raises
    dry to watch and no more. With `late` (a watermark's delay) a region that has sent nothing fresh for 12 h falls to the configured
    state, by a timer or, where one batch holds later signals of the region too, in their order, so that batches can be cut anywhere.
    The state of a region is three numbers and a timer. It lies in RocksDB, which is set for the session (`rocksdb`)."""
    rocksdb(signals.sparkSession)
    has = lambda k, kind: (F.col(k) if k in signals.columns else F.lit(None)).cast(kind).alias(k)
    level = level_number(rain_level(F.col("acc_mm"), F.col("peak_mm_h"))).alias("level")
    rows = signals.select("region", F.col("t").cast("long").alias("t"), level, has("manual", "double"), F.coalesce(has("stale", "boolean"), F.lit(False)).alias("stale"), has("forecast_mm", "double"))
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    mode = "EventTime" if late is not None else "None"
    return rows.groupBy("region").transformWithStateInPandas(statefulProcessor=_EventState(configured, late is not None), outputStructType="region string, t long, state int", outputMode="append", timeMode=mode)


def rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, which holds only a part of it in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def edge_beliefs(attached: DataFrame, hazards: DataFrame, sources: DataFrame, hazard_class: str) -> DataFrame:
    """(edge_id, era, tau, at, s): net evidence of each edge for one class as decayed sums, in any order of arrival, to be read by
    `current_beliefs`. An era is ERA (300) decay times tau long; inside it a report weighs w e^((t - start of the era) / tau), which
    a double holds, so the state is a plain sum that tasks combine before the shuffle: a hot edge costs a row a task and batch."""
    rows = attached.filter(F.col("hazard_class") == hazard_class).join(F.broadcast(hazards.select("hazard_class", "tau")), "hazard_class").join(F.broadcast(sources), "source_class")
    w = F.col("polarity") * kernel(F.col("distance_m")) * reliability_weight(F.col("alpha"))
    rows = rows.select("edge_id", F.unix_timestamp("observed_at").alias("t"), w.alias("w"), "tau").withColumn("era", F.floor(F.col("t") / (ERA * F.col("tau"))))
    since = (F.col("t") - F.col("era") * ERA * F.col("tau")) / F.col("tau")
    return rows.groupBy("edge_id", "era", "tau").agg(F.max("t").alias("at"), F.sum(F.col("w") * F.exp(since)).alias("s"))


def current_beliefs(sums: DataFrame) -> DataFrame:
    """(edge_id, at, evidence) from the latest sums of each edge and era: all evidence, decayed to the edge's newest report."""
    newest = sums.groupBy("edge_id").agg(F.max("at").alias("newest"))
    back = (F.col("newest") - F.col("era") * ERA * F.col("tau")) / F.col("tau")
    return sums.join(newest, "edge_id").groupBy("edge_id", F.col("newest").alias("at")).agg(F.sum(F.col("s") * F.exp(-back)).alias("evidence"))


def beta_of(evidence: Column, prior: Column) -> tuple[Column, Column]:
    """Alpha and beta of an edge from its evidence and prior."""
    n, s = config.PRIOR_STRENGTH, config.EVIDENCE_SCALE
    return n * prior + s * F.greatest(evidence, F.lit(0.0)), n * (1 - prior) + s * F.greatest(-evidence, F.lit(0.0))


def rate_counts(stream: DataFrame, key: str, late: str = "1 hour", length: str = "1 hour", slide: str = "10 minutes", limit: int = 300) -> DataFrame:
    w = F.window("received_at", length, slide)
    counts = stream.withWatermark("received_at", late).groupBy(w, key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.end").alias("end"), "n", (F.col("n") > limit).alias("limited"))


def split_late(stream: DataFrame, path: str, checkpoint: str, most_days: int = 14):
    """Appends each batch, with lag_s (seconds from observation to receipt) of each entry, to path/on_time or path/late (observed more
    than most_days before it was received)."""

    def put(batch: DataFrame, number: int) -> None:
        lag = F.unix_timestamp("received_at") - F.unix_timestamp("observed_at")
        rows = batch.withColumn("lag_s", lag).withColumn("late", F.col("observed_at") < F.col("received_at") - F.expr(f"INTERVAL {most_days} DAYS"))
        for name, test in (("late", F.col("late")), ("on_time", ~F.col("late"))):
            rows.filter(test).drop("late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")  # the same batch again replaces itself

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def privacy_sweep(rows: DataFrame, path: str, cutoff: str) -> None:
    """Rewrites rows into a new folder with those before the cutoff coarsened."""
    coarsen_privacy(rows, cutoff).write.parquet(path)
