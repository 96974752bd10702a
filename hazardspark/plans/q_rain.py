"""Rain, event catalogues and field logs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import events, fieldlog, places, rain
from hazardspark.operators.components import connected_components
from hazardspark.plans.registry import Tables, query
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)
NOW = "2024-01-31 00:00:00"


@query("a12_daily_max", "SELECT gauge, day, round(max(mm), 6) AS mm FROM {readings} WHERE mm >= 0 GROUP BY gauge, day")
def _(t: Tables):
    return rain.daily_max(t.readings).select("gauge", "day", r6(c("mm")).alias("mm"))


_MEDIAN = "md AS (SELECT day, median(mm) AS median_mm, count(*) AS gauges FROM {gauge_daily} GROUP BY day HAVING count(*) >= 5)"


@query("a13_city_median", f"WITH {_MEDIAN} SELECT day, round(median_mm, 6) AS median_mm, gauges FROM md")
def _(t: Tables):
    return rain.city_median(t.gauge_daily).select("day", r6(c("median_mm")).alias("median_mm"), "gauges")


_RUNS = f"""WITH {_MEDIAN}, w AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) <= 1 THEN 0 ELSE 1 END AS new FROM md WHERE median_mm >= 60),
    g AS (SELECT *, sum(new) OVER (ORDER BY day) AS run FROM w), ev AS (SELECT 'rain-' || min(day) AS event_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days, max(median_mm) AS max_mm, sum(median_mm) AS sum_mm FROM g GROUP BY run)"""


@query("w6_rain_events", f"{_RUNS} SELECT event_id, first_day, last_day, days, round(max_mm, 6) AS max_mm, round(sum_mm, 6) AS sum_mm FROM ev")
def _(t: Tables):
    found = rain.rain_events(rain.city_median(t.gauge_daily), 60.0)
    return found.select("event_id", "first_day", "last_day", "days", r6(c("max_mm")).alias("max_mm"), r6(c("sum_mm")).alias("sum_mm"))


@query("w7_prev_2day_sum", f"WITH {_MEDIAN} SELECT a.day, round(b.median_mm + d.median_mm, 6) AS prev2_mm FROM md a LEFT JOIN md b ON b.day = a.day - 1 LEFT JOIN md d ON d.day = a.day - 2")
def _(t: Tables):
    return rain.previous_days_sum(rain.city_median(t.gauge_daily)).select("day", r6(c("prev2_mm")).alias("prev2_mm"))


@query("j11_interval_event", f"{_RUNS} SELECT o_orderkey AS id, coalesce((SELECT min(event_id) FROM ev WHERE CAST(o_orderdate AS DATE) BETWEEN first_day AND last_day), 'day-' || CAST(o_orderdate AS DATE)) AS event_id FROM {{orders}}")
def _(t: Tables):
    days = t.orders.select(c("o_orderkey").alias("id"), c("o_orderdate").cast("date").alias("day"))
    return events.interval_event(days, rain.rain_events(rain.city_median(t.gauge_daily), 60.0)).select("id", "event_id")


@query("w1_rolling", """SELECT district, day, round(sum(mm) OVER (PARTITION BY district ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS r3, round(sum(mm) OVER (PARTITION BY district ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS r30,
    round(max(mm) OVER (PARTITION BY district ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mx7 FROM {panel}""")
def _(t: Tables):
    return rain.rolling(t.panel, "mm", "district", [3, 30]).select("district", "day", *[r6(c(x)).alias(x) for x in ("r3", "r30", "mx7")])


@query("w2_normalised_features", """WITH r AS (SELECT *, sum(mm) OVER (PARTITION BY district ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3 FROM {panel}),
    s AS (SELECT district, greatest(1e0, coalesce(quantile_cont(CASE WHEN mm >= 1 THEN mm END, 0.95), 1e0)) AS a, greatest(1e0, quantile_cont(r3, 0.95)) AS b FROM r WHERE day < DATE '2000-01-01' GROUP BY district)
    SELECT r.district, r.day, round(mm / coalesce(a, 1e0), 6) AS n_r0, round(r3 / coalesce(b, 1e0), 6) AS n_r3, round(sin(2 * pi() * dayofyear(r.day) / 366), 6) + 0e0 AS doy_sin, round(cos(2 * pi() * dayofyear(r.day) / 366), 6) + 0e0 AS doy_cos FROM r LEFT JOIN s ON s.district = r.district""")
def _(t: Tables):
    return rain.normalised_features(t.panel, "2000-01-01").select("district", "day", *[(r6(c(x)) + 0.0).alias(x) for x in ("n_r0", "n_r3", "doy_sin", "doy_cos")])


_ACC = "ac AS (SELECT slot, sum(mean_mm_h) OVER w * 0.5e0 AS acc_mm, max(peak_mm_h) OVER w AS peak_mm_h, 6 - count(*) OVER w AS missing FROM {rain_slices} WINDOW w AS (ORDER BY slot RANGE BETWEEN 9000 PRECEDING AND CURRENT ROW))"
_LEVELS = f"{_ACC}, lv AS (SELECT slot AS t, CASE WHEN acc_mm >= 12 OR peak_mm_h >= 18 THEN 2 WHEN acc_mm >= 9.5e0 OR peak_mm_h >= 13 THEN 1 ELSE 0 END AS level FROM ac)"


def _levels(t: Tables):
    rows = rain.with_levels(rain.accumulation(t.rain_slices), active=(12.0, 18.0), watch=(9.5, 13.0))  # this rain is steadier than real rain
    return rows.select(c("slot").alias("t"), "level")


@query("a14_rain_accumulation", f"WITH {_ACC} SELECT slot, round(acc_mm, 6) AS acc_mm, round(peak_mm_h, 6) AS peak_mm_h, missing FROM ac")
def _(t: Tables):
    return rain.accumulation(t.rain_slices).select("slot", r6(c("acc_mm")).alias("acc_mm"), r6(c("peak_mm_h")).alias("peak_mm_h"), "missing")


@query("w13_event_state_hold", f"""WITH {_LEVELS}, h AS (SELECT t, level, max(CASE WHEN level >= 2 THEN t END) OVER (ORDER BY t) AS a, max(CASE WHEN level >= 1 THEN t END) OVER (ORDER BY t) AS w FROM lv)
    SELECT t, level, CASE WHEN t - a <= 21600 THEN 2 WHEN t - w <= 43200 THEN 1 ELSE 0 END AS state FROM h""")
def _(t: Tables):
    return rain.state_holds(_levels(t)).select("t", "level", "state")


@query("w5_wet_episodes", f"""WITH {_LEVELS}, p AS (SELECT *, t // 864000 AS period FROM lv WHERE level >= 1), g AS (SELECT *, sum(CASE WHEN t - prev <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY period ORDER BY t) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY period ORDER BY t) AS prev FROM p) q)
    SELECT period, min(t) AS first, max(t) AS last, count(*) AS steps, max(level) AS top FROM g GROUP BY period, run""")
def _(t: Tables):
    return rain.wet_episodes(_levels(t).withColumn("period", F.floor(c("t") / 864000)), "period", 1800).select("period", "first", "last", "steps", "top")


@query("w8_warned_ahead", f"WITH {_LEVELS} SELECT a.t, a.level, b.level AS at_m6h, d.level AS at_p6h, e.level AS at_p12h FROM lv a LEFT JOIN lv b ON b.t = a.t - 21600 LEFT JOIN lv d ON d.t = a.t + 21600 LEFT JOIN lv e ON e.t = a.t + 43200")
def _(t: Tables):
    return rain.shifted(_levels(t), [-21600, 21600, 43200])


_HOURLY = "hr AS (SELECT CAST(floor(slot / 3600e0) AS BIGINT) * 3600 AS t, sum(mean_mm_h) / 2 AS mm FROM {rain_slices} WHERE slot % 46800 <> 0 GROUP BY 1)"


def _hourly(t: Tables):
    return t.rain_slices.filter("slot % 46800 <> 0").groupBy((F.floor(c("slot") / 3600) * 3600).alias("t")).agg((F.sum("mean_mm_h") / 2).alias("mm"))


@query("w4_forecast_ahead", f"""WITH {_HOURLY}, s AS (SELECT t, CASE WHEN count(mm) OVER w = 3 THEN sum(mm) OVER w END AS mm3 FROM hr WINDOW w AS (ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))
    SELECT t, round(mm3, 6) AS mm3, round(CASE WHEN count(mm3) OVER a >= 9 THEN max(mm3) OVER a END, 6) AS max3_ahead FROM s WINDOW a AS (ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 43200 FOLLOWING)""")
def _(t: Tables):
    return rain.forecast_ahead(_hourly(t)).select("t", r6(c("mm3")).alias("mm3"), r6(c("max3_ahead")).alias("max3_ahead"))


@query("a16_area_mean", "SELECT slot AS t, round(CASE WHEN count(mm) = 5 THEN avg(mm) END, 6) AS mm FROM (SELECT CAST(floor(EPOCH(ts) / 1800e0) AS BIGINT) * 1800 AS slot, event_type, avg(value) AS mm FROM {events} GROUP BY 1, 2) x GROUP BY slot")
def _(t: Tables):
    points = t.events.groupBy((F.floor(F.unix_timestamp("ts") / 1800) * 1800).alias("t"), "event_type").agg(F.avg("value").alias("mm"))
    return rain.area_mean(points, 5).select("t", r6(c("mm")).alias("mm"))


@query("a15_slice_stats", """WITH lg AS (SELECT (i * 40) % 256 AS r, (i * 90) % 256 AS g, (i * 20) % 256 AS b, CAST(i AS DOUBLE) AS mm_h FROM (SELECT unnest(range(12)) AS i) q),
    px AS (SELECT event_id % 20 AS slot, ((event_id % 15) * 40) % 256 AS r, ((event_id % 15) * 90 + event_id % 9) % 256 AS g, ((event_id % 15) * 20) % 256 AS b, count(*) AS n FROM {events} GROUP BY 1, 2, 3, 4),
    m AS (SELECT p.slot, p.n, (SELECT min((greatest(abs(p.r - lg.r), abs(p.g - lg.g), abs(p.b - lg.b)), lg.mm_h)) FROM lg WHERE greatest(abs(p.r - lg.r), abs(p.g - lg.g), abs(p.b - lg.b)) <= 6) AS x FROM px p)
    SELECT slot, CAST(sum(n) AS BIGINT) AS pixels, CAST(sum(CASE WHEN x IS NULL THEN n ELSE 0 END) AS BIGINT) AS unmatched, round(sum(CASE WHEN x IS NULL THEN 0 ELSE x[2] END * n) / sum(n), 6) AS mean_mm_h, max(x[2]) AS peak_mm_h FROM m GROUP BY slot""")
def _(t: Tables):
    legend = t.spark.createDataFrame([((i * 40) % 256, (i * 90) % 256, (i * 20) % 256, float(i)) for i in range(12)], "r long, g long, b long, mm_h double")
    k = c("event_id") % 15
    pixels = t.events.groupBy((c("event_id") % 20).alias("slot"), (k * 40 % 256).alias("r"), ((k * 90 + c("event_id") % 9) % 256).alias("g"), (k * 20 % 256).alias("b")).agg(F.count("*").alias("n"))
    return rain.slice_stats(pixels, legend).select("slot", "pixels", "unmatched", r6(c("mean_mm_h")).alias("mean_mm_h"), "peak_mm_h")


@query("a24_contingency", f"""WITH {_LEVELS}, x AS (SELECT a.level >= 1 AS happened, b.level >= 1 AS warned FROM lv a LEFT JOIN lv b ON b.t = a.t - 21600),
    n AS (SELECT count(*) FILTER (WHERE warned AND happened) AS hits, count(*) FILTER (WHERE NOT warned AND happened) AS misses, count(*) FILTER (WHERE warned AND NOT happened) AS false_alarms, count(*) FILTER (WHERE NOT warned AND NOT happened) AS correct, count(*) FILTER (WHERE warned IS NULL OR happened IS NULL) AS excluded FROM x)
    SELECT *, round(hits / nullif(hits + misses, 0), 6) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 6) AS far FROM n""")
def _(t: Tables):
    rows = rain.shifted(_levels(t), [-21600])
    return rain.contingency(rows, c("at_m6h") >= 1, c("level") >= 1).withColumns({"pod": r6(c("pod")), "far": r6(c("far"))})


@query("a32_rule_replay_windows", f"""WITH {_LEVELS}, wd AS (SELECT n_nationkey AS window_id, 1704067200 + n_nationkey * 86400 AS lo, 1704067200 + n_nationkey * 86400 + 43200 AS hi, n_nationkey % 3 AS expected FROM {{nation}})
    SELECT window_id, max(level) AS top, count(*) FILTER (WHERE level >= 1) AS wet_steps, max(level) = any_value(expected) AS as_expected FROM lv JOIN wd ON t BETWEEN lo AND hi GROUP BY window_id""")
def _(t: Tables):
    k = c("n_nationkey")
    windows = t.nation.select(k.alias("window_id"), (1704067200 + k * 86400).alias("lo"), (1704067200 + k * 86400 + 43200).alias("hi"), (k % 3).alias("expected"))
    return rain.window_levels(_levels(t), windows)


@query("j8_link_catalogues", "SELECT a.event_id AS a_id, b.event_id AS b_id, a.district FROM {events_a} a JOIN {events_b} b ON a.district = b.district AND a.first_day - 3 <= b.last_day + 3 AND b.first_day - 3 <= a.last_day + 3")
def _(t: Tables):
    return events.link_catalogues(t.events_a, t.events_b)


@query("u5_calendar_clusters", """WITH RECURSIVE lk AS (SELECT a.event_id AS a, -b.event_id - 1 AS b FROM {events_a} a JOIN {events_b} b ON a.district = b.district AND a.first_day - 3 <= b.last_day + 3 AND b.first_day - 3 <= a.last_day + 3),
    sy AS (SELECT a AS u, b AS v FROM lk UNION SELECT b, a FROM lk), rc AS (SELECT u AS root, u AS n FROM sy UNION SELECT rc.root, sy.v FROM rc JOIN sy ON sy.u = rc.n), cm AS (SELECT n, min(root) AS k FROM rc GROUP BY n),
    nd AS (SELECT event_id AS n, first_day, last_day FROM {events_a} UNION ALL SELECT -event_id - 1, first_day, last_day FROM {events_b})
    SELECT coalesce(cm.k, nd.n) AS cluster, min(first_day) AS first_day, max(last_day) AS last_day, count(*) FILTER (WHERE nd.n >= 0) AS n_a, count(*) FILTER (WHERE nd.n < 0) AS n_b FROM nd LEFT JOIN cm ON cm.n = nd.n WHERE cm.k IS NOT NULL OR nd.n >= 0 GROUP BY 1""")
def _(t: Tables):
    links = events.link_catalogues(t.events_a, t.events_b)
    return events.calendar_clusters(t.events_a, t.events_b, links, lambda e: connected_components(e, written))


@query("a10_event_counts", "SELECT state, district, count(*) AS n, count(*) FILTER (WHERE first_day >= DATE '2000-01-01') AS recent FROM {events_a} GROUP BY state, district")
def _(t: Tables):
    return events.event_counts(t.events_a, "2000-01-01")


@query("a11_district_registry", "SELECT district, count(DISTINCT state) AS n_states, CASE WHEN count(DISTINCT state) = 1 THEN min(state) END AS state FROM {events_a} GROUP BY district")
def _(t: Tables):
    return events.district_registry(t.events_a)


@query("a27_label_panel", "SELECT p.district, p.day, EXISTS (SELECT 1 FROM {events_a} e WHERE e.district = p.district AND p.day BETWEEN e.first_day AND e.last_day) AS y FROM {panel} p")
def _(t: Tables):
    return events.label_panel(t.events_a, t.panel.select("district", "day"))


@query("a28_month_rate", "SELECT district, month(day) AS month, round(avg(y), 6) AS rate, count(*) AS days FROM {panel} WHERE day < DATE '2000-01-01' GROUP BY 1, 2")
def _(t: Tables):
    return events.month_rate(t.panel.filter(c("day") < F.lit("2000-01-01").cast("date"))).select("district", "month", r6(c("rate")).alias("rate"), "days")


@query("j15_match_or_note", """WITH k AS (SELECT district, count(*) AS n, min(event_id) AS e FROM {events_b} WHERE event_id % 400 < 60 GROUP BY district)
    SELECT a.event_id, a.district, CASE WHEN n = 1 THEN e END AS b_event, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'one' END AS note FROM {events_a} a LEFT JOIN k ON k.district = a.district""")
def _(t: Tables):
    right = t.events_b.filter("event_id % 400 < 60").select("district", c("event_id").alias("b_event"))
    return events.exact_match_or_note(t.events_a.select("event_id", "district"), right, "district", "b_event")


@query("j14_resolve_alias", "SELECT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS k, count(*) AS n, count(s) AS matched FROM {part} LEFT JOIN (SELECT DISTINCT regexp_replace(lower(s_name), '[^a-z]', '', 'g') AS s FROM {supplier} UNION SELECT 'smallring') q ON s = regexp_replace(lower(p_name), '[^a-z]', '', 'g') GROUP BY 1")
def _(t: Tables):
    from hazardspark.functions.rules import name_key

    alias = t.supplier.select(name_key(c("s_name")).alias("k")).union(t.spark.sql("SELECT 'smallring' AS k")).distinct().withColumn("hit", F.lit(1))
    return t.part.select(name_key(c("p_name")).alias("k")).join(alias, "k", "left").groupBy("k").agg(F.count("*").alias("n"), F.count("hit").alias("matched"))


@query("a17_profile_sources", "SELECT year(day) AS year, count(*) AS n, count(DISTINCT gauge) AS gauges, round(quantile_cont(mm, 0.9), 6) AS p90, round(avg(CASE WHEN mm >= 60 THEN 1e0 ELSE 0e0 END), 6) AS wet_share FROM {gauge_daily} GROUP BY 1")
def _(t: Tables):
    wet = F.avg(F.when(c("mm") >= 60, 1.0).otherwise(0.0))
    return t.gauge_daily.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("gauge").alias("gauges"), r6(F.percentile("mm", 0.9)).alias("p90"), r6(wet).alias("wet_share"))


@query("a17_event_windows", """SELECT e.event_id, count(g.gauge) AS n, count(DISTINCT g.gauge) AS gauges, round(quantile_cont(mm, 0.5), 6) AS p50, round(quantile_cont(mm, 0.9), 6) AS p90, round(avg(CASE WHEN mm >= 60 THEN 1e0 WHEN mm IS NOT NULL THEN 0e0 END), 6) AS wet_share
    FROM {catalogue_a} e LEFT JOIN {gauge_daily} g ON g.gauge % 25 = e.district AND g.day BETWEEN e.first_day - INTERVAL '3' DAY AND e.last_day + INTERVAL '3' DAY GROUP BY e.event_id""")
def _(t: Tables):
    daily = t.gauge_daily.withColumn("district", c("gauge") % 25)
    out = rain.profile_event_windows(daily, t.catalogue_a, 3, 3, 60.0)
    return out.select("event_id", "n", "gauges", *[r6(c(x)).alias(x) for x in ("p50", "p90", "wet_share")])


@query("a18_class_totals", "SELECT hazard_class, source_class, count(*) AS n FROM {obs} GROUP BY CUBE (hazard_class, source_class)")
def _(t: Tables):
    return t.obs.cube("hazard_class", "source_class").agg(F.count("*").alias("n"))


@query("a25_yearly_checks", """WITH y AS (SELECT year(o_orderdate) AS year, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM {orders} GROUP BY 1)
    SELECT year, total, o + f + p = total AS parts_ok, coalesce(year - lag(year) OVER (ORDER BY year) = 1, true) AS consecutive, round(100e0 * (total - lag(total) OVER (ORDER BY year)) / lag(total) OVER (ORDER BY year), 6) AS pct FROM y""")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.orderBy("year")  # a row a year
    part = lambda s: F.count_if(c("o_orderstatus") == s)
    y = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("total"), (part("O") + part("F") + part("P")).alias("parts"))
    before = F.lag("total").over(w)
    return y.select("year", "total", (c("parts") == c("total")).alias("parts_ok"), F.coalesce(c("year") - F.lag("year").over(w) == 1, F.lit(True)).alias("consecutive"), r6(100.0 * (c("total") - before) / before).alias("pct"))


@query("a26_place_duplicates", "SELECT min(id) AS id FROM (SELECT node AS id, round(lat, 1) AS a, round(lon, 1) AS b, c_mktsegment AS name FROM {lattice_nodes}) x GROUP BY a, b, name")
def _(t: Tables):
    return places.place_duplicates(t.lattice_nodes.select(c("node").alias("id"), "lat", "lon", c("c_mktsegment").alias("name")), 1).select("id")


@query("a29_density_grid", "SELECT CAST(floor(lat1 / 0.02e0) AS BIGINT) AS cy, CAST(floor(lon1 / 0.02e0) AS BIGINT) AS cx, round(sum(length_m), 3) AS m, count(*) AS n FROM {lattice_edges} GROUP BY 1, 2")
def _(t: Tables):
    from hazardspark.functions.geo import cell

    return t.lattice_edges.groupBy(cell(c("lat1"), 0.02).alias("cy"), cell(c("lon1"), 0.02).alias("cx")).agg(F.round(F.sum("length_m"), 3).alias("m"), F.count("*").alias("n"))


@query("a31_feed_freshness", f"SELECT source_class, max(received_at) AS newest, round((EPOCH(TIMESTAMP '{NOW}') - EPOCH(max(received_at))) / 3600e0, 4) AS age_h, CAST(max(received_at) AS DATE) = DATE '2024-01-31' AS today FROM {{obs}} GROUP BY source_class")
def _(t: Tables):
    newest = F.max("received_at")
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(newest)) / 3600
    return t.obs.groupBy("source_class").agg(newest.alias("newest"), F.round(age, 4).alias("age_h"), (newest.cast("date") == F.lit("2024-01-31").cast("date")).alias("today"))


@query("u1_merge_field_logs", """SELECT coalesce(s.entry_id, p.entry_id) AS entry_id, coalesce(s.state, p.state) AS state, CASE WHEN p.entry_id IS NULL THEN 'server' WHEN p.sync_status = 'rejected' THEN 'rejected' WHEN p.depth_band IS NOT NULL AND p.state <> 'not_passable' THEN 'invalid'
    WHEN s.entry_id IS NULL THEN 'restored' WHEN s.site_id = p.site_id AND s.state = p.state AND s.depth_band IS NOT DISTINCT FROM p.depth_band AND s.volunteer = p.volunteer AND s.observed_at = p.observed_at THEN 'in_both' ELSE 'conflict' END AS outcome
    FROM {server_log} s FULL JOIN {phone_log} p ON p.entry_id = s.entry_id""")
def _(t: Tables):
    return fieldlog.merge_field_logs(t.server_log, t.phone_log).select("entry_id", "state", "outcome")


@query("a23_site_board", f"""WITH st AS (SELECT DISTINCT site_id FROM {{field_log}} UNION SELECT 'site_none'), l AS (SELECT site_id, arg_max(state, (observed_at, entry_id)) AS state, max(observed_at) AS at, count(*) AS entries, count(DISTINCT volunteer) AS observers FROM {{field_log}} GROUP BY site_id),
    r AS (SELECT *, lag(state) OVER w AS ps, lag(volunteer) OVER w AS pv, lag(observed_at) OVER w AS pt, row_number() OVER (PARTITION BY site_id ORDER BY observed_at DESC, entry_id DESC) AS k FROM {{field_log}} WHERE state IN ('passable', 'not_passable') WINDOW w AS (PARTITION BY site_id ORDER BY observed_at, entry_id))
    SELECT st.site_id, l.state, round((EPOCH(TIMESTAMP '{NOW}') - EPOCH(l.at)) / 3600e0, 2) AS age_hours, (EPOCH(TIMESTAMP '{NOW}') - EPOCH(l.at)) / 3600e0 > 6 AS stale, coalesce(entries, 0) AS entries, coalesce(observers, 0) AS observers, coalesce(r.ps <> r.state AND r.pv <> r.volunteer AND EPOCH(r.observed_at) - EPOCH(r.pt) <= 1800, false) AS disagree
    FROM st LEFT JOIN l ON l.site_id = st.site_id LEFT JOIN r ON r.site_id = st.site_id AND r.k = 1""")
def _(t: Tables):
    sites = t.field_log.select("site_id").distinct().union(t.spark.sql("SELECT 'site_none' AS site_id"))
    return fieldlog.site_board(t.field_log, sites, NOW)


@query("w18_status_changes", "SELECT entry_id, site_id, state, prev FROM (SELECT *, lag(state) OVER (PARTITION BY site_id ORDER BY observed_at, entry_id) AS prev FROM {field_log}) x WHERE prev IS NULL OR prev <> state")
def _(t: Tables):
    from pyspark.sql import Window

    prev = F.lag("state").over(Window.partitionBy("site_id").orderBy("observed_at", "entry_id"))
    return t.field_log.withColumn("prev", prev).filter("prev IS NULL OR prev <> state").select("entry_id", "site_id", "state", "prev")


@query("w19_hlc_order", "SELECT id, row_number() OVER (PARTITION BY node ORDER BY EPOCH(observed_at), id % 4, source_id, id) AS place FROM {obs} WHERE received_at >= observed_at - INTERVAL '5' MINUTE")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy(F.unix_timestamp("observed_at"), c("id") % 4, "source_id", "id")
    return t.obs.filter(c("received_at") >= c("observed_at") - F.expr("INTERVAL 5 MINUTES")).select("id", F.row_number().over(w).alias("place"))


@query("st7_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY EPOCH(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM {events}")
def _(t: Tables):
    log = t.events.select("event_id", "user_id", c("ts").alias("received_at"))
    return fieldlog.hourly_counts(log, "user_id", 300).select("event_id", "in_hour")


@query("a23_lag_summary", "SELECT median(l) AS median, quantile_cont(l, 0.95) AS p95, max(l) AS most, count(*) AS n FROM (SELECT EPOCH(received_at) - EPOCH(observed_at) AS l FROM {field_log}) x")
def _(t: Tables):
    return fieldlog.lag_summary(t.field_log)


@query("s12_csv_safe", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '''=' || value WHEN event_id % 4 = 1 THEN '''-' || value ELSE 'x' || value END AS safe, CASE WHEN event_id % 4 = 0 THEN '=' || value WHEN event_id % 4 = 1 THEN '-' || value ELSE 'x' || value END AS plain FROM {events}")
def _(t: Tables):
    from hazardspark.functions.rules import csv_plain, csv_safe

    k = c("event_id") % 4
    text = F.concat(F.when(k == 0, "=").when(k == 1, "-").otherwise("x"), c("value").cast("string"))
    return t.events.select("event_id", csv_safe(text).alias("safe"), csv_plain(csv_safe(text)).alias("plain"))
