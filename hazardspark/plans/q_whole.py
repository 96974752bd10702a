"""Queries over whole tables whose namesakes take a part, and the same SQL over whole tables; tests hold them against plain versions too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.operators import events, signals, spatial
from hazardspark.operators.components import connected_components
from hazardspark.plans import q_belief, q_rain, q_scoring, q_streams  # noqa: F401  their SQL is used
from hazardspark.plans.registry import WRITTEN_SQL, Tables, query
from hazardspark.tables import new_path, written

c, r6 = F.col, lambda x: F.round(x, 6)


def _sql(name: str, *changes: tuple[str, str]) -> str:
    """The SQL of a query, over the whole catalogues and with further changes."""
    sql = WRITTEN_SQL[name]
    for a, b in (("{events_a}", "{catalogue_a}"), ("{events_b}", "{catalogue_b}"), *changes):
        sql = sql.replace(a, b)
    return sql


def catalogue(t: Tables, odd: int) -> DataFrame:
    """All orders as events of two catalogues, of even and of odd keys, in the shape of events_a and events_b."""
    day = c("o_orderdate").cast("date")
    last = F.date_add(day, (c("o_orderkey") % 9).cast("int"))
    return t.orders.filter(c("o_orderkey") % 2 == odd).select(c("o_orderkey").alias("event_id"), (c("o_custkey") % 25).alias("district"), (c("o_custkey") % 7).alias("state"), day.alias("first_day"), last.alias("last_day"))


@query("j8_link_catalogues_all", _sql("j8_link_catalogues"))
def _(t: Tables):
    return events.link_catalogues(catalogue(t, 0), catalogue(t, 1))


@query("u5_calendar_clusters_all")
def _(t: Tables):
    return events.calendar_clusters_by_days(catalogue(t, 0), catalogue(t, 1), lambda e: connected_components(e, written), written)


@query("a10_event_counts_all", _sql("a10_event_counts"))
def _(t: Tables):
    return events.event_counts(catalogue(t, 0), "2000-01-01")


@query("a11_district_registry_all", _sql("a11_district_registry"))
def _(t: Tables):
    return events.district_registry(catalogue(t, 0))


@query("a27_label_panel_all", _sql("a27_label_panel"))
def _(t: Tables):
    return events.label_panel(catalogue(t, 0), t.panel.select("district", "day"))


@query("j15_match_or_note_all", _sql("j15_match_or_note", (" WHERE event_id % 400 < 60", "")))
def _(t: Tables):
    right = catalogue(t, 1).select("district", c("event_id").alias("b_event"))
    return events.exact_match_or_note(catalogue(t, 0).select("event_id", "district"), right, "district", "b_event")


@query("j10_nearest_gauge_all", _sql("j10_nearest_gauge", (" WHERE o_orderkey % 3 = 0", "")))
def _(t: Tables):
    gauges = t.gauge_daily.withColumns({"lat": 12.75 + c("gauge") * 0.007, "lon": 79.95 + c("gauge") * 0.006})
    obs = t.orders.select(c("o_orderkey").alias("id"), c("o_orderdate").cast("date").alias("day"), (12.75 + (c("o_custkey") % 100) * 0.004).alias("lat"), (79.95 + (c("o_custkey") % 90) * 0.004).alias("lon"))
    return spatial.nearest_by_day(obs, gauges).select("id", "gauge", r6(c("mm")).alias("mm"), F.round("km", 4).alias("km"))


@query("s1_observations_ndjson_all", _sql("s1_observations_ndjson", ("round(value, 6) AS depth_mm FROM {events} WHERE event_id % 3 = 0", "CASE WHEN event_id % 3 = 0 THEN round(value, 6) END AS depth_mm FROM {events}")))
def _(t: Tables):
    from hazardspark.sources.files import read_observations_ndjson

    path = new_path(t.spark, "ndjson")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    t.obs.select(c("id").cast("string"), "hazard_class", "polarity", point.alias("geometry"), c("observed_at").cast("timestamp"), F.create_map(F.lit("depth_mm"), "depth_mm").alias("intensity")).write.json(path)
    return read_observations_ndjson(t.spark, path).select("id", r6(c("depth_mm")).alias("depth_mm"))


@query("m26_cycle_candidates_all", _sql("m26_cycle_candidates", ("i * 5e0", "i * 0.25e0"), ("range(29)", "range(561)")))
def _(t: Tables):
    rows = t.events.filter("event_type = 'click'").select((c("user_id") % 10).alias("site"), (F.unix_timestamp("ts") % 86400).alias("t"))
    return signals.cycle_candidates(rows, "site", "t").select("site", "cycle", r6(c("resultant")).alias("resultant"), "n")
