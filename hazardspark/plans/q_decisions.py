"""Advice, adoption, timing, places, records and file readers as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import decisions, graph, places, rain, scoring, signals, spatial, studies, textchecks
from hazardspark.plans.q_belief import _SPLIT
from hazardspark.plans.q_rain import _HOURLY, _LEVELS, _hourly, _levels
from hazardspark.plans.registry import Tables, query
from hazardspark.plans.views import haversine
from hazardspark.sources import files
from hazardspark.tables import new_path

c, r6 = F.col, lambda x: F.round(x, 6)

_FACTS = """f AS (SELECT o_orderkey AS route, o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 37 % 101) / 100e0 END AS worst_p, (o_orderkey * 13 % 60) / 100e0 AS ratio, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS accidents,
      o_orderkey % 23 = 0 AS limits, CASE o_custkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1.25e0 WHEN 2 THEN 1.5e0 ELSE 1.6e0 END AS s, CASE (o_orderkey // 3) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' ELSE 'stale' END AS confidence,
      CASE (o_orderkey // 3) % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.65e0 WHEN 2 THEN 0.3e0 ELSE 0.2e0 END - 0.1e0 * least(o_orderkey % 6, 3) AS base, o_orderkey % 3 = 0 AS dry, o_orderkey % 5 = 0 AS restricted, o_orderkey % 7 = 0 AS blocked FROM {orders})"""


@query("f21_advise", f"""WITH {_FACTS}, a AS (SELECT *, least(1e0, greatest(0.05e0, CASE WHEN dry THEN base * 0.7e0 ELSE base END)) AS ev, 0.7e0 * coalesce(worst_p, 1e0) * 1e0 - CASE WHEN worst_p > 1 THEN 0.7e0 * (worst_p - 1) ELSE 0 END + 0.3e0 * least(1e0, ratio / 0.5e0) AS r0 FROM f),
    b AS (SELECT *, CASE WHEN accidents > 0 OR limits THEN greatest(r0, 0.6e0) ELSE r0 END AS r FROM a),
    n AS (SELECT *, exp(-pow(r - 0.08e0, 2) / (2 * 0.17e0 * 0.17e0)) AS n0, exp(-pow(r - 0.4e0, 2) / (2 * 0.17e0 * 0.17e0)) AS n1, exp(-pow(r - 0.8e0, 2) / (2 * 0.17e0 * 0.17e0)) AS n2 FROM b),
    k AS (SELECT *, ev * n0 / (n0 + n1 + n2) + (1 - ev) * 0.15e0 AS k0, ev * n1 / (n0 + n1 + n2) + (1 - ev) * 0.55e0 AS k1, ev * n2 / (n0 + n1 + n2) + (1 - ev) * 0.3e0 AS k2 FROM n),
    p AS (SELECT *, k0 / (k0 + k1 * sqrt(s) + k2 * s) AS p0, k1 * sqrt(s) / (k0 + k1 * sqrt(s) + k2 * s) AS p1, k2 * s / (k0 + k1 * sqrt(s) + k2 * s) AS p2 FROM k),
    u AS (SELECT *, exp(4 * (p0 + 0.15e0 * p1 - p2)) AS u0, exp(4 * (0.35e0 * p0 + 0.75e0 * p1 + 0.3e0 * p2)) AS u1, exp(4 * (-0.5e0 * p0 + 0.3e0 * p1 + p2)) AS u2, list_transform(range(1 + k % 3), lambda i: exp((-(600 + i * 60 + k % 50) / 3600e0 - 2e0 * s * ((k + i * 31) % 100) / 100e0) / 0.25e0)) AS w FROM p)
    SELECT route, round(k0, 6) AS risk_lower, round(k1, 6) AS risk_moderate, round(k2, 6) AS risk_high, round(u0 / (u0 + u1 + u2), 6) AS action_proceed, round(u1 / (u0 + u1 + u2), 6) AS action_wait, round(u2 / (u0 + u1 + u2), 6) AS action_avoid,
    CASE WHEN ev >= 0.7 THEN 'strong' WHEN ev >= 0.4 THEN 'some' ELSE 'little' END AS evidence, round(CASE WHEN len(w) >= 2 THEN w[1] / list_sum(w) ELSE 1e0 END, 6) AS chosen_p, CAST(len(w) AS INT) AS compared,
    array_to_string(list_filter([CASE WHEN limits THEN 'limits_not_met' END, CASE WHEN accidents > 0 THEN 'accident_on_route' END, CASE WHEN restricted AND NOT limits THEN 'restricted_avoided' END,
      CASE WHEN worst_p >= 0.5 THEN 'high_risk_street' WHEN worst_p >= 0.2 THEN 'some_risk_streets' WHEN worst_p < 0.05 AND ratio < 0.01 AND accidents = 0 AND NOT limits AND NOT dry THEN 'no_hazard_found' END,
      CASE WHEN blocked THEN 'flooded_alternatives_avoided' END, CASE WHEN confidence = 'stale' THEN 'stale_data' WHEN confidence = 'low' THEN 'little_data' END, CASE WHEN dry THEN 'no_event' END], lambda x: x IS NOT NULL)[1:2], ',') AS reasons FROM u""")
def _(t: Tables):
    k = c("o_orderkey")
    pick = lambda x, *names: F.get(F.array(*map(F.lit, names)), x.cast("int"))
    facts = t.orders.select(
        k.alias("route"), F.when(k % 97 != 0, (k * 37 % 101) / 100.0).alias("worst_p"), ((k * 13 % 60) / 100.0).alias("penalty_ratio"), (k % 11 == 0).cast("int").alias("accidents"), (k % 23 == 0).alias("limits_not_met"),
        pick(c("o_custkey") % 4, "commuter", "cyclist", "pedestrian", "emergency").alias("user_class"), pick(F.floor(k / 3) % 4, "high", "moderate", "low", "stale").alias("confidence"), (k % 6).cast("int").alias("data_gaps"),
        pick(k % 3, "dry", "watch", "active").alias("event_state"), (k % 5 == 0).cast("int").alias("restricted"), (k % 7 == 0).cast("int").alias("blocked"),
        F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct((600 + i * 60 + k % 50).cast("double").alias("seconds"), ((k + i * 31) % 100 / 100.0).alias("risk"))).alias("candidates"),
    )
    shares = [r6(c(x)).alias(x) for x in ("risk_lower", "risk_moderate", "risk_high", "action_proceed", "action_wait", "action_avoid", "chosen_p")]
    return decisions.advise(facts).select("route", *shares, "evidence", "compared", F.array_join("reasons", ",").alias("reasons"))


@query("a34_adoption", f"""WITH {_LEVELS}, x AS (SELECT a.t, CASE WHEN a.t // 86400 % 5 = 0 THEN 'dry' ELSE 'wet' END AS period, b.level >= 1 AS rule, a.level >= 1 AS wet, CASE WHEN d.level IS NULL AND e.level IS NULL THEN NULL ELSE greatest(coalesce(d.level, 0), coalesce(e.level, 0)) >= 1 END AS later_wet
      FROM lv a LEFT JOIN lv b ON b.t = a.t - 21600 LEFT JOIN lv d ON d.t = a.t + 21600 LEFT JOIN lv e ON e.t = a.t + 43200),
    q AS (SELECT *, t // 864000 AS span FROM lv WHERE level >= 1), g AS (SELECT *, sum(CASE WHEN t - prev <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY span ORDER BY t) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY span ORDER BY t) AS prev FROM q) z),
    ep AS (SELECT min(t) AS first FROM g GROUP BY span, run), w AS (SELECT count(*) AS episodes, count(*) FILTER (WHERE lv.level >= 1) AS warned FROM ep LEFT JOIN lv ON lv.t = ep.first - 21600),
    n AS (SELECT count(*) FILTER (WHERE period = 'wet' AND rule AND wet) AS hits, count(*) FILTER (WHERE period = 'wet' AND NOT rule AND wet) AS misses, count(*) FILTER (WHERE period = 'wet' AND rule AND NOT wet) AS fa, count(*) FILTER (WHERE period = 'dry' AND rule IS NOT NULL) AS dk, count(*) FILTER (WHERE period = 'dry' AND rule) AS dn,
      count(*) FILTER (WHERE period = 'wet' AND rule AND later_wet IS NOT NULL) AS judged, count(*) FILTER (WHERE period = 'wet' AND rule AND NOT later_wet) AS un FROM x),
    s AS (SELECT hits / nullif(hits + misses, 0) AS pod, fa / nullif(hits + fa, 0) AS far, episodes, warned / nullif(episodes, 0) AS share_warned, dn / nullif(dk, 0) AS dry_share, un / nullif(judged, 0) AS unconfirmed_share FROM n CROSS JOIN w),
    v AS (SELECT *, coalesce(pod >= 0.5 AND far <= 0.5, false) AS detects, CASE WHEN episodes >= 10 THEN coalesce(share_warned >= 0.5, false) END AS warns_ahead, coalesce(dry_share <= 0.05, false) AS quiet_when_dry FROM s)
    SELECT round(pod, 6) AS pod, round(far, 6) AS far, episodes, round(share_warned, 6) AS share_warned, round(dry_share, 6) AS dry_share, round(unconfirmed_share, 6) AS unconfirmed_share, detects, warns_ahead, quiet_when_dry, detects AND coalesce(warns_ahead, false) AND quiet_when_dry AS all_met,
    CASE WHEN detects AND coalesce(warns_ahead, false) AND quiet_when_dry THEN 'on by default' ELSE 'off by default' END AS advice FROM v""")
def _(t: Tables):
    levels = _levels(t)
    later = F.when(c("at_p6h").isNotNull() | c("at_p12h").isNotNull(), F.greatest(F.coalesce("at_p6h", F.lit(0)), F.coalesce("at_p12h", F.lit(0))) >= 1)
    rows = rain.shifted(levels, [-21600, 21600, 43200]).select("t", F.when(F.floor(c("t") / 86400) % 5 == 0, "dry").otherwise("wet").alias("period"), (c("at_m6h") >= 1).alias("rule"), (c("level") >= 1).alias("wet"), later.alias("later_wet"))
    first = rain.wet_episodes(levels.withColumn("span", F.floor(c("t") / 864000)), "span", 1800).select((c("first") - 21600).alias("t"))
    episodes = first.join(levels, "t", "left").select(F.coalesce(c("level") >= 1, F.lit(False)).alias("warned"))
    out = decisions.adoption(decisions.warning_scores(rows, episodes))
    return out.withColumns({x: r6(c(x)) for x in ("pod", "far", "share_warned", "dry_share", "unconfirmed_share")})


@query("w3_three_hour_sums", f"WITH {_HOURLY} SELECT t, round(CASE WHEN count(mm) OVER w = 3 THEN sum(mm) OVER w END, 6) AS mm3 FROM hr WINDOW w AS (ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")
def _(t: Tables):
    return rain.forecast_ahead(_hourly(t)).select("t", r6(c("mm3")).alias("mm3"))


_STATIONS = "st AS (SELECT gauge AS station, 12.7e0 + (gauge % 8) * 0.05e0 AS lat, 79.9e0 + floor(gauge / 8) * 0.05e0 AS lon, avg(mm) * 365.25e0 AS annual_mm, quantile_cont(CASE WHEN mm >= 1 THEN mm END, 0.95) AS wet_p95 FROM {gauge_daily} GROUP BY gauge)"


@query("j22_station_climate", f"""WITH {_STATIONS}, d AS (SELECT z.zone_id AS id, st.*, {haversine('z.lat', 'z.lon', 'st.lat', 'st.lon')} AS m FROM {{zones}} z JOIN st ON {haversine('z.lat', 'z.lon', 'st.lat', 'st.lon')} <= 3000),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, station) AS r FROM d) q WHERE r = 1) SELECT z.zone_id AS id, b.station, round(b.annual_mm, 6) AS annual_mm, round(b.wet_p95, 6) AS wet_p95 FROM {{zones}} z LEFT JOIN b ON b.id = z.zone_id""")
def _(t: Tables):
    g = c("gauge")
    daily = t.gauge_daily.select(g.alias("station"), (12.7 + (g % 8) * 0.05).alias("lat"), (79.9 + F.floor(g / 8) * 0.05).alias("lon"), "mm")
    points = t.zones.select(c("zone_id").alias("id"), "lat", "lon")
    out = spatial.nearest_station_climate(points, spatial.station_climate(daily), 3.0)
    return out.select("id", "station", r6(c("annual_mm")).alias("annual_mm"), r6(c("wet_p95")).alias("wet_p95"))


@query("j12_area_tiers", f"""WITH d AS (SELECT n.node AS id, z.zone_id, z.category IN ('High', 'Very High') AS known, {haversine('n.lat', 'n.lon', 'z.lat', 'z.lon')} AS m FROM {{lattice_nodes}} n JOIN {{zones}} z ON {haversine('n.lat', 'n.lon', 'z.lat', 'z.lon')} <= 2000),
    b AS (SELECT id, zone_id, m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT (known AND m <= 1200), m, zone_id) AS r FROM d) q WHERE r = 1) SELECT n.node AS id, b.zone_id AS place_id, round(b.m, 3) AS distance_m FROM {{lattice_nodes}} n LEFT JOIN b ON b.id = n.node""")
def _(t: Tables):
    points = t.lattice_nodes.select(c("node").alias("id"), "lat", "lon")
    areas = t.zones.select(c("zone_id").alias("place_id"), c("category").alias("kind"), "lat", "lon")
    return spatial.nearest_area(points, areas, ["High", "Very High"]).select("id", "place_id", F.round("distance_m", 3).alias("distance_m"))


@query("g2_region_graph", f"""WITH RECURSIVE {_SPLIT.split("sp AS (")[0]} pt AS (SELECT w.way, w.seq, w.node, w.highway, w.oneway, lag(w.node) OVER (PARTITION BY w.way ORDER BY w.seq) AS prev, coalesce({haversine('lag(w.lat) OVER (PARTITION BY w.way ORDER BY w.seq)', 'lag(w.lon) OVER (PARTITION BY w.way ORDER BY w.seq)', 'w.lat', 'w.lon')}, 0e0) AS d,
      jn.node IS NOT NULL AS j FROM {{way_points}} w LEFT JOIN jn ON jn.node = w.node),
    rc AS (SELECT way, seq, CAST(0 AS BIGINT) AS segment, CASE WHEN j OR d >= 20000 THEN 1 ELSE 0 END AS nxt, CASE WHEN j OR d >= 20000 THEN 0e0 ELSE d END AS m FROM pt WHERE seq = 1
      UNION ALL SELECT p.way, p.seq, rc.nxt, CASE WHEN p.j OR rc.m + p.d >= 20000 THEN rc.nxt + 1 ELSE rc.nxt END, CASE WHEN p.j OR rc.m + p.d >= 20000 THEN 0e0 ELSE rc.m + p.d END FROM rc JOIN pt p ON p.way = rc.way AND p.seq = rc.seq + 1),
    sg AS (SELECT p.way, rc.segment, arg_min(prev, p.seq) AS a, arg_max(node, p.seq) AS b, sum(d) AS m, any_value(highway) AS highway, any_value(oneway) AS oneway FROM pt p JOIN rc ON rc.way = p.way AND rc.seq = p.seq WHERE prev IS NOT NULL GROUP BY p.way, rc.segment),
    dr AS (SELECT *, false AS backward FROM sg WHERE oneway <> '-1' AND a <> b UNION ALL SELECT *, true FROM sg WHERE oneway <> 'yes' AND a <> b)
    SELECT way, CAST(segment AS BIGINT) AS segment, CASE WHEN backward THEN b ELSE a END AS from_node, CASE WHEN backward THEN a ELSE b END AS to_node, round(m, 3) AS length_m, highway, backward FROM dr""")
def _(t: Tables):
    edges = graph.build_graph(t.way_points, 20_000.0)  # nodes of these ways lie kilometres apart
    return edges.select("way", c("segment").cast("long").alias("segment"), "from_node", "to_node", F.round("length_m", 3).alias("length_m"), "highway", "backward")


_TIMING = """ln AS (SELECT user_id % 10 AS site, event_id % 2 AS approach, event_id % 3 AS bin, count(*) AS passes, CASE WHEN count(*) % 4 = 0 THEN NULL ELSE 60 + CAST(sum(event_id) AS BIGINT) % 400 / 10e0 END AS cycle_s FROM {events} GROUP BY 1, 2, 3),
    sw AS (SELECT o_custkey % 12 AS site, CASE WHEN o_custkey % 12 < 3 THEN NULL ELSE o_orderkey % 2 END AS bin, CASE WHEN o_orderkey % 9 > 0 THEN 70e0 + o_orderkey % (2 + 3 * (o_custkey % 12)) END AS cycle_s FROM {orders}),
    wt AS (SELECT site, count(*) AS cycles, median(cycle_s) AS median_s, stddev_samp(cycle_s) AS sd_s FROM sw WHERE cycle_s IS NOT NULL GROUP BY site),
    cv AS (SELECT site, count(bin) AS n, list(DISTINCT bin) AS bins FROM sw GROUP BY site),
    bs AS (SELECT * FROM (SELECT ln.*, row_number() OVER (PARTITION BY ln.site ORDER BY passes DESC, approach, bin) AS r FROM ln JOIN cv ON cv.site = ln.site WHERE cv.n = 0 OR list_contains(cv.bins, ln.bin)) q WHERE r = 1),
    si AS (SELECT wt.site, cycles, median_s, sd_s, coalesce(sd_s <= 5, false) AS fixed, approach, bin, bs.cycle_s AS learned_s, passes, abs(bs.cycle_s - median_s) AS error_s FROM wt LEFT JOIN bs ON bs.site = wt.site)"""


def _timing(t: Tables):
    u, k, o = c("user_id"), c("event_id"), c("o_orderkey")
    learned = t.events.groupBy((u % 10).alias("site"), (k % 2).alias("approach"), (k % 3).alias("bin")).agg(F.count("*").alias("passes"), F.sum(k).alias("s"))
    learned = learned.withColumn("cycle_s", F.when(c("passes") % 4 != 0, 60 + c("s") % 400 / 10.0))
    site = c("o_custkey") % 12
    watch = t.orders.select(site.alias("site"), F.when(site >= 3, o % 2).alias("bin"), F.when(o % 9 > 0, 70.0 + o % (2 + 3 * site)).alias("cycle_s"))
    return decisions.evaluate_timing(learned, watch)


@query("m27_timing_sites", f"WITH {_TIMING} SELECT site, cycles, round(median_s, 6) AS median_s, round(sd_s, 6) AS sd_s, fixed, approach, bin, round(learned_s, 6) AS learned_s, passes, round(error_s, 6) AS error_s FROM si")
def _(t: Tables):
    return _timing(t).withColumns({x: r6(c(x)) for x in ("median_s", "sd_s", "learned_s", "error_s")})


@query("m27_timing_verdict", f"WITH {_TIMING}, e AS (SELECT *, CASE WHEN fixed THEN coalesce(error_s, 'inf'::DOUBLE) END AS e FROM si) SELECT count(e) AS fixed_sites, CASE WHEN median(e) < 'inf'::DOUBLE THEN round(median(e), 6) END AS median_error_s, coalesce(median(e) > 3, true) AS failed, count(*) FILTER (WHERE learned_s IS NULL AND NOT fixed) AS none_and_not_fixed, count(*) FILTER (WHERE learned_s IS NULL AND fixed) AS none_but_fixed FROM e")
def _(t: Tables):
    return decisions.timing_verdict(_timing(t), 3.0).withColumn("median_error_s", r6(c("median_error_s")))


@query("m26_chosen_cycle", """WITH e AS (SELECT user_id % 10 AS site, EPOCH(ts) % 86400 AS t FROM {events} WHERE event_type = 'click'), a AS (SELECT site, cycle, round(sqrt(pow(sum(cos(2 * pi() * t / cycle)), 2) + pow(sum(sin(2 * pi() * t / cycle)), 2)) / count(*), 9) AS r, count(*) AS n FROM e CROSS JOIN (SELECT 40 + i * 0.25e0 AS cycle FROM (SELECT unnest(range(561)) AS i) q) c GROUP BY 1, 2),
    f AS (SELECT *, max(r) OVER (PARTITION BY site) AS best, coalesce(lead(r) OVER w < r, true) AS tops, coalesce(lag(r) OVER w <= r, true) AS bottoms FROM a WINDOW w AS (PARTITION BY site ORDER BY cycle)), g AS (SELECT *, max(CASE WHEN r >= 0.9e0 * best THEN cycle END) OVER (PARTITION BY site) AS k FROM f),
    h AS (SELECT *, min(CASE WHEN tops AND cycle >= k THEN cycle END) OVER (PARTITION BY site) AS k2 FROM g), i AS (SELECT *, max(CASE WHEN bottoms AND cycle <= k2 THEN cycle END) OVER (PARTITION BY site) AS k3 FROM h)
    SELECT site, n, CASE WHEN best >= 0.05 AND n >= 8 THEN cycle END AS cycle, CASE WHEN best >= 0.05 AND n >= 8 THEN round(r, 6) END AS resultant FROM i WHERE cycle = k3""")
def _(t: Tables):
    rows = t.events.filter("event_type = 'click'").select((c("user_id") % 10).alias("site"), (F.unix_timestamp("ts") % 86400).alias("t"))
    found = signals.cycle_candidates(rows, "site", "t").withColumn("resultant", F.round("resultant", 9))
    return signals.choose_cycle(found, "site", least=0.05).select("site", "n", "cycle", r6(c("resultant")).alias("resultant"))


@query("m26_red_and_delay", """WITH p AS (SELECT user_id % 40 AS site, CASE WHEN event_id % 3 > 0 THEN value END AS wait_s, CASE WHEN event_id % 4 > 0 THEN value / 3 END AS delay_s FROM {events}), g AS (SELECT site, count(wait_s) AS stops, count(delay_s) AS usable, quantile_cont(wait_s, 0.9) AS w, quantile_cont(delay_s, 0.5) AS m, quantile_cont(delay_s, 0.85) AS q FROM p GROUP BY site)
    SELECT site, stops, round(CASE WHEN stops >= 8 THEN w / 0.9e0 END, 6) AS red_s, usable, round(CASE WHEN usable >= 20 THEN m END, 6) AS delay_median_s, round(CASE WHEN usable >= 20 THEN q END, 6) AS delay_p85_s FROM g""")
def _(t: Tables):
    k = c("event_id")
    passes = t.events.select((c("user_id") % 40).alias("site"), F.when(k % 3 > 0, c("value")).alias("wait_s"), F.when(k % 4 > 0, c("value") / 3).alias("delay_s"))
    out = signals.red_and_delay(passes, "site", least_passes=20)
    return out.withColumns({x: r6(c(x)) for x in ("red_s", "delay_median_s", "delay_p85_s")})


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p\x01L\x02\\p\x01N\x02]+'), lambda w: w <> '')"


@query("x2_snap_quotes", f"""WITH b AS (SELECT item_id, text, {_words('text')} AS ws FROM {{benchmark}}), e AS (SELECT item_id AS id, text, CASE item_id % 4 WHEN 0 THEN array_to_string(ws[1:3], ' ') WHEN 1 THEN 'never said in that source' ELSE array_to_string([ws[2], ws[4], ws[5], ws[3], ws[7]], ', ') END AS quote, CASE WHEN item_id % 6 = 3 THEN 'nowhere' ELSE ws[3] || '-' || ws[4] END AS place FROM b),
    s AS (SELECT id, {_words('quote')} AS asked, array_to_string({_words('place')}, ' ') AS place, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM e)
    SELECT id, CASE WHEN len(asked) >= 4 THEN trim(list_filter(ss, lambda x: contains(array_to_string({_words('x')}, ' '), place) AND list_has_all({_words('x')}, asked))[1]) END AS sentence FROM s""")
def _(t: Tables):
    ws = textchecks.words(c("text"))
    k = c("item_id")
    rows = t.benchmark.withColumn("ws", ws)
    quote = F.when(k % 4 == 0, F.array_join(F.slice("ws", 1, 3), " ")).when(k % 4 == 1, "never said in that source").otherwise(F.array_join(F.array(*[F.get("ws", F.lit(i)) for i in (1, 3, 4, 2, 6)]), ", "))
    place = F.when(k % 6 == 3, "nowhere").otherwise(F.concat(F.get("ws", F.lit(2)), F.lit("-"), F.get("ws", F.lit(3))))
    return textchecks.snap_quotes(rows.select(k.alias("id"), k.alias("item"), quote.alias("quote"), place.alias("place")), t.benchmark.select(k.alias("item"), "text"))


_RECORDS = """rc AS (SELECT conv_id, turn, text AS question, CASE k % 7 WHEN 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN k % 11 = 0 THEN 'fr' WHEN k % 5 = 0 THEN 'ta' ELSE 'en' END AS locale, CASE WHEN k % 13 = 0 THEN 'what' WHEN k % 3 = 0 THEN 'is_safe' ELSE 'summary' END AS intent,
      'time_min: 12 confidence: ' || CASE WHEN k % 4 = 0 THEN 'low' ELSE 'high' END AS sheet, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'Dry Dock Road takes 12 min' WHEN 2 THEN 'It is safe, 13 min' WHEN 3 THEN 'I cannot confirm the condition of any road; use your own judgement' WHEN 4 THEN 'I cannot answer that from the route data' ELSE 'Take 12.5 min or clear' END AS answer,
      CASE WHEN k % 9 = 0 THEN 'Nope' ELSE '' END AS headline FROM (SELECT *, conv_id * 10 + turn AS k FROM {conversations}) x)"""


@query("x6_record_problems", f"""WITH {_RECORDS}, b AS (SELECT *, replace(answer, 'Dry Dock Road', ' ') AS bare FROM rc)
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN split NOT IN ('train', 'val') THEN 'split' END, CASE WHEN locale NOT IN ('en', 'ta') THEN 'locale' END, CASE WHEN intent NOT IN ('is_safe', 'summary') THEN 'intent' END, CASE WHEN trim(question) = '' OR length(question) > 200 THEN 'question' END, CASE WHEN trim(answer) = '' THEN 'empty' END,
      CASE WHEN starts_with(answer, 'I cannot answer that from the route data') THEN 'fallback' END, CASE WHEN locale = 'en' AND regexp_matches(bare, '(?i)\\b(safe|safely|safest|unsafe|dry|clear|open|passable|fine|ok|okay|guaranteed)\\b|go ahead|green light') THEN 'banned' END,
      CASE WHEN locale = 'en' AND len(list_filter(regexp_extract_all(bare, '[0-9]+(\\.[0-9]+)?'), lambda n: n <> '12')) > 0 THEN 'number' END, CASE WHEN locale = 'en' AND intent = 'is_safe' AND NOT contains(answer, 'I cannot confirm the condition of any road') THEN 'refusal' END,
      CASE WHEN locale = 'en' AND contains(sheet, 'confidence: low') AND NOT contains(answer, 'use your own judgement') THEN 'hedge' END, CASE WHEN NOT starts_with(answer, headline) THEN 'headline' END], lambda x: x IS NOT NULL), ',') AS problems FROM b""")
def _(t: Tables):
    k = c("conv_id") * 10 + c("turn")
    answer = F.when(k % 6 == 0, "").when(k % 6 == 1, "Dry Dock Road takes 12 min").when(k % 6 == 2, "It is safe, 13 min").when(k % 6 == 3, "I cannot confirm the condition of any road; use your own judgement").when(k % 6 == 4, "I cannot answer that from the route data").otherwise("Take 12.5 min or clear")
    found = textchecks.record_problems(
        F.when(k % 7 == 0, "test").otherwise("train"), F.when(k % 11 == 0, "fr").when(k % 5 == 0, "ta").otherwise("en"), c("text"), F.when(k % 13 == 0, "what").when(k % 3 == 0, "is_safe").otherwise("summary"),
        F.concat(F.lit("time_min: 12 confidence: "), F.when(k % 4 == 0, "low").otherwise("high")), answer, F.when(k % 9 == 0, "Nope").otherwise(""), F.array(F.lit("Dry Dock Road")),
    )
    return t.conversations.select("conv_id", "turn", F.array_join(found, ",").alias("problems"))


_SAID = ["The road is dry now, go ahead", "no longer flooded on Dry Dock Road", "You can drive through", "Nothing moves on Dry Dock Road", "தண்ணீர் இல்லை இங்கே", "It will not flood and it is okay", "Data is limited"]
_KINDS = ["dry|go", "state change", "permission", "", "", "fine|promise", ""]


@query("x9_claim_kinds", f"""SELECT event_id, concat_ws('|', nullif([{", ".join(f"'{k}'" for k in _KINDS)}][event_id % 7 + 1], ''), CASE WHEN event_id % 5 = 0 THEN 'as usual' END, CASE WHEN event_id % 7 = 4 THEN 'tamil' END) AS kinds FROM {{events}}""")
def _(t: Tables):
    said = F.element_at(F.array(*map(F.lit, _SAID)), (c("event_id") % 7 + 1).cast("int"))
    text = F.concat_ws(". ", said, F.when(c("event_id") % 5 == 0, "Back to normal"))
    kinds = textchecks.claim_kinds(text, F.array(F.lit("Dry Dock Road")))
    return t.events.select("event_id", F.array_join(kinds, "|").alias("kinds"))


@query("x9_explanation_faults", """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Route A takes 12 min on Dry Dock Road' WHEN 1 THEN 'Flood is passable, go ahead' WHEN 2 THEN 'Use your own judgement, 99 percent sure' WHEN 3 THEN 'Anna Salai is 3.5 km' WHEN 4 THEN 'There is no data for Dry Dock Road' ELSE 'It takes ' || value || ' min' END AS text,
      [12e0, value] AS facts, CASE WHEN event_id % 4 = 0 THEN 'low' WHEN event_id % 4 = 1 THEN 'stale' ELSE 'high' END AS band FROM {events}), b AS (SELECT *, replace(replace(text, 'Dry Dock Road', ' '), 'Route A', ' ') AS bare FROM e)
    SELECT event_id, array_to_string(list_filter([CASE WHEN len(list_filter(regexp_extract_all(bare, '[0-9]+(\\.[0-9]+)?'), lambda x: len(list_filter(facts, lambda f: abs(f - CAST(x AS DOUBLE)) <= 0.05)) = 0)) > 0 THEN 'numeral' END,
      CASE WHEN len(list_filter(regexp_extract_all(text, '\\b[A-Z][a-zA-Z'']*\\b'), lambda w: w NOT IN ('Route', 'A', 'Dry', 'Dock', 'Road', 'Use', 'There', 'It'))) > 0 THEN 'entity' END,
      CASE WHEN band IN ('low', 'stale') AND NOT (contains(lower(text), 'use your own judgement') OR contains(lower(text), 'no data')) THEN 'unhedged' END, CASE WHEN regexp_matches(lower(bare), '\\b(passable|safe)\\b|go ahead') THEN 'claim' END], lambda x: x IS NOT NULL), ',') AS faults FROM b""")
def _(t: Tables):
    k = c("event_id") % 6
    text = F.when(k == 0, "Route A takes 12 min on Dry Dock Road").when(k == 1, "Flood is passable, go ahead").when(k == 2, "Use your own judgement, 99 percent sure").when(k == 3, "Anna Salai is 3.5 km").when(k == 4, "There is no data for Dry Dock Road")
    text = text.otherwise(F.concat(F.lit("It takes "), c("value").cast("string"), F.lit(" min")))
    band = F.when(c("event_id") % 4 == 0, "low").when(c("event_id") % 4 == 1, "stale").otherwise("high")
    faults = textchecks.explanation_faults(text, F.array(F.lit(12.0), "value"), F.array(F.lit("Dry Dock Road"), F.lit("Route A")), band)
    return t.events.select("event_id", F.array_join(faults, ",").alias("faults"))


@query("x12_aliases_extras", """WITH p AS (SELECT place_id, name || ' ' || place_id % 50 AS name, CAST(kind AS VARCHAR) AS kind FROM {gazetteer}), al AS (SELECT name, list_sort(list(DISTINCT s)) AS more FROM (SELECT name, unnest([upper(name), name, 'kind ' || kind]) AS s FROM p WHERE place_id % 3 = 0) x GROUP BY name),
    f AS (SELECT p.name, p.kind, list_concat([p.kind], list_filter(coalesce(al.more, []), lambda s: s <> p.name AND s <> p.kind)) AS alt FROM p LEFT JOIN al ON al.name = p.name),
    ex AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN (SELECT upper(min(name)) FROM p) ELSE 'new ' || s_suppkey END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'odd' ELSE 'town' END AS kind FROM {supplier}),
    k AS (SELECT name, kind, CAST([] AS VARCHAR[]) AS alt FROM ex WHERE kind = 'town' AND lower(name) NOT IN (SELECT lower(name) FROM p))
    SELECT name, kind, array_to_string(alt, '|') AS alt FROM f UNION ALL SELECT name, kind, array_to_string(alt, '|') FROM k""")
def _(t: Tables):
    name = F.concat("name", F.lit(" "), (c("place_id") % 50).cast("string"))
    rows = t.gazetteer.select("place_id", name.alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), c("kind").cast("string").alias("kind")).withColumn("alt", F.array("kind"))
    aliases = rows.filter("place_id % 3 = 0").select("name", F.explode(F.array(F.upper("name"), "name", F.concat(F.lit("kind "), "kind"))).alias("spelling"))
    first = rows.agg(F.upper(F.min("name")).alias("first"))  # one row
    k = c("s_suppkey")
    extras = t.supplier.crossJoin(F.broadcast(first)).select(F.when(k % 3 == 0, c("first")).otherwise(F.concat(F.lit("new "), k.cast("string"))).alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.when(k % 5 == 0, "odd").otherwise("town").alias("kind"), F.array().cast("array<string>").alias("alt"))
    kept, _ = places.with_aliases_and_extras(rows.drop("place_id"), aliases, extras, ["town", "city"])
    return kept.select("name", "kind", F.array_join("alt", "|").alias("alt"))


def _state(x: str) -> str:
    return f"regexp_replace(lower(replace({x}, '&', 'and')), '[^a-z]', '', 'g')"


_GEO = """a AS (SELECT s_suppkey AS id, chr(CAST(97 + s_suppkey % 7 AS INT)) || 'town' AS name, CASE s_nationkey % 4 WHEN 0 THEN 'Jammu & Kashmir' WHEN 1 THEN 'Bihar' WHEN 2 THEN 'Telangana' ELSE 'Goa' END AS state FROM {supplier}),
    g AS (SELECT a.id, p_partkey AS candidate, chr(CAST(65 + p_partkey % 5 AS INT)) || 'TOWN' AS name, CASE p_partkey % 6 WHEN 0 THEN 'Jammu and Kashmir' WHEN 1 THEN 'Ladakh' WHEN 2 THEN 'bihar' WHEN 3 THEN 'Jharkhand' WHEN 4 THEN 'Andhra Pradesh' END AS admin1, chr(CAST(65 + p_partkey % 7 AS INT)) || ' Town' AS admin2,
      CASE p_size % 4 WHEN 0 THEN 'PPLA2' WHEN 1 THEN 'PPL' WHEN 2 THEN 'ADM1' END AS feature_code, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 37 % 1000 END AS population FROM a JOIN {part} ON p_partkey % 20 = a.id % 20)"""


def _geo(t: Tables):
    k, n = c("s_suppkey"), c("s_nationkey") % 4
    letter = lambda base, x: F.char((base + x).cast("int"))
    asked = t.supplier.select(k.alias("id"), F.concat(letter(F.lit(97), k % 7), F.lit("town")).alias("name"), F.when(n == 0, "Jammu & Kashmir").when(n == 1, "Bihar").when(n == 2, "Telangana").otherwise("Goa").alias("state"))
    p, m = c("p_partkey"), c("p_partkey") % 6
    state = F.when(m == 0, "Jammu and Kashmir").when(m == 1, "Ladakh").when(m == 2, "bihar").when(m == 3, "Jharkhand").when(m == 4, "Andhra Pradesh")
    code = F.when(c("p_size") % 4 == 0, "PPLA2").when(c("p_size") % 4 == 1, "PPL").when(c("p_size") % 4 == 2, "ADM1")
    answers = t.part.select((p % 20).alias("r"), p.alias("candidate"), F.concat(letter(F.lit(65), p % 5), F.lit("TOWN")).alias("name"), state.alias("admin1"), F.concat(letter(F.lit(65), p % 7), F.lit(" Town")).alias("admin2"), code.alias("feature_code"), F.when(p % 3 > 0, p * 37 % 1000).alias("population"))
    return asked.withColumn("r", c("id") % 20), answers


@query("x10_geocode_tiers", f"""WITH {_GEO}, r AS (SELECT g.id, candidate, row_number() OVER (PARTITION BY g.id ORDER BY CASE WHEN starts_with(coalesce(feature_code, ''), 'PPLA') THEN 0 WHEN starts_with(coalesce(feature_code, ''), 'PPL') THEN 1 ELSE 2 END, CASE WHEN {_state('admin2')} = {_state('a.name')} THEN 0 ELSE 1 END, coalesce(population, 0) DESC, candidate) AS k
    FROM g JOIN a ON a.id = g.id WHERE {_state("coalesce(admin1, '')")} = {_state('state')}) SELECT a.id, r.candidate FROM a LEFT JOIN r ON r.id = a.id AND r.k = 1""")
def _(t: Tables):
    return places.choose_geocode(*_geo(t), on="r")


@query("x10_geocode_relaxed", f"""WITH {_GEO}, s AS (SELECT *, CASE {_state("coalesce(admin1, '')")} WHEN 'ladakh' THEN 'jammuandkashmir' WHEN 'jharkhand' THEN 'bihar' WHEN 'telangana' THEN 'andhrapradesh' ELSE {_state("coalesce(admin1, '')")} END AS u FROM g),
    r AS (SELECT s.id, candidate, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN starts_with(coalesce(feature_code, ''), 'PPLA') THEN 0 ELSE 1 END, coalesce(population, 0) DESC, candidate) AS k FROM s JOIN a ON a.id = s.id
      WHERE u = CASE {_state('state')} WHEN 'telangana' THEN 'andhrapradesh' ELSE {_state('state')} END AND ({_state('s.name')} = {_state('a.name')} OR {_state('admin2')} = {_state('a.name')})) SELECT a.id, r.candidate FROM a LEFT JOIN r ON r.id = a.id AND r.k = 1""")
def _(t: Tables):
    return places.choose_geocode(*_geo(t), relaxed=True, on="r")


@query("x4_miner_scores", """WITH m AS (SELECT id AS mined_id, node, hazard_class, source_class, row_number() OVER (PARTITION BY node, hazard_class, source_class ORDER BY id) AS n FROM {obs} WHERE id % 3 > 0), g AS (SELECT id AS gold_id, node, hazard_class, source_class, row_number() OVER (PARTITION BY node, hazard_class, source_class ORDER BY id) AS n FROM {obs} WHERE id % 4 > 0),
    x AS (SELECT coalesce(m.source_class, g.source_class) AS grp, mined_id, gold_id FROM m FULL JOIN g ON m.node = g.node AND m.hazard_class = g.hazard_class AND m.source_class = g.source_class AND m.n = g.n), y AS (SELECT grp, count(*) FILTER (WHERE mined_id IS NOT NULL AND gold_id IS NOT NULL) AS tp, count(mined_id) AS a, count(gold_id) AS b FROM x GROUP BY ROLLUP (grp))
    SELECT coalesce(grp, 'overall') AS grp, tp, round(tp / a, 6) AS precision, round(tp / b, 6) AS recall, round(2 * tp / (a + b), 6) AS f1 FROM y""")
def _(t: Tables):
    side = lambda k, name: t.obs.filter(c("id") % k > 0).select(c("id").alias(name), "node", "hazard_class", "source_class")
    pairs = studies.match_to_gold(side(3, "mined_id"), side(4, "gold_id"), ["node", "hazard_class", "source_class"])
    rows = pairs.select(F.explode(F.array("source_class", F.lit("overall"))).alias("grp"), c("gold_id").isNotNull().alias("in_gold"), c("mined_id").isNotNull().alias("in_mined"))
    return studies.mined_scores(rows, "grp").select("grp", "tp", *[r6(c(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("f9_norm_composed", "SELECT doc_id, md5(trim(regexp_replace(lower(nfc_normalize(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'é', 'e' || chr(769)) ELSE text END)), '\\s+', ' ', 'g'))) AS k FROM {documents} WHERE text NOT LIKE '%’%' AND text NOT LIKE '%“%' AND text NOT LIKE '%ß%'")
def _(t: Tables):
    from hazardspark.functions.rules import norm_text

    rows = t.documents.filter("text NOT LIKE '%’%' AND text NOT LIKE '%“%' AND text NOT LIKE '%ß%'")
    text = F.when(c("doc_id") % 2 == 0, F.replace("text", F.lit("é"), F.lit("e\u0301"))).otherwise(c("text"))
    return rows.select("doc_id", F.md5(norm_text(text, compose=True)).alias("k"))


@query("m20_scorecard_bounds", "SELECT p_partkey, round((m - b) / (1 - b), 6) AS skill, CASE WHEN lo <= 0 THEN 'no evidence of skill (interval holds 0)' WHEN (m - b) / (1 - b) < 0 THEN 'no evidence of skill (negative)' WHEN (m - b) / (1 - b) >= 0.3e0 THEN 'useful' WHEN (m - b) / (1 - b) >= 0.1e0 THEN 'modest' ELSE 'marginal' END AS verdict, round(m / pv, 6) AS lift FROM (SELECT p_partkey, (p_partkey % 100) / 100e0 AS m, (p_partkey % 77) / 99e0 AS b, CASE WHEN p_partkey % 9 > 0 THEN (p_partkey % 5 - 1) / 10e0 END AS lo, (1 + p_partkey % 7) / 20e0 AS pv FROM {part}) x")
def _(t: Tables):
    k = c("p_partkey")
    rows = t.part.select(k, ((k % 100) / 100.0).alias("m"), ((k % 77) / 99.0).alias("b"), F.when(k % 9 > 0, (k % 5 - 1) / 10.0).alias("lo"), ((1 + k % 7) / 20.0).alias("pv"))
    return scoring.scorecard(rows, "m", "b", "lo", "pv").select("p_partkey", r6(c("skill")).alias("skill"), "verdict", r6(c("lift")).alias("lift"))


# readers: a file is written from a table and read back


def _documents(rows, number, text, root: str, path: str) -> None:
    """Writes XML files of up to 500 elements, by the value of a number, each in a root."""
    docs = rows.select(F.floor(number / 500).alias("file"), text.alias("e")).groupBy("file").agg(F.array_join(F.collect_list("e"), "").alias("e"))
    docs.select(F.concat(F.lit(f"<{root}>"), "e", F.lit(f"</{root}>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@query("s2_csv_bom", "SELECT CAST(p_partkey AS VARCHAR) AS part, p_name AS name, 'a, \"b\"' AS note FROM {part}")
def _(t: Tables):
    path = new_path(t.spark, "csv")
    t.part.select(c("p_partkey").alias(f"{files.BOM}id"), "p_name", F.lit('a, "b"').alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv_bom(t.spark, path, {"id": "part", "p_name": "name"})


@query("s4_kml_placemarks", "SELECT 'n' || node AS name, CAST(col AS VARCHAR) AS col, round(lat, 6) AS lat, round(lon + 0.001e0, 6) AS lon, 2 AS points FROM {lattice_nodes}")
def _(t: Tables):
    path = new_path(t.spark, "kml")
    text = F.concat(F.lit("<Placemark><name>n"), "node", F.lit('</name><ExtendedData><SchemaData><SimpleData name="col">'), "col", F.lit("</SimpleData></SchemaData></ExtendedData><LineString><coordinates>"), "lon", F.lit(","), "lat", F.lit(",0 "), c("lon") + 0.002, F.lit(","), "lat", F.lit(",0</coordinates></LineString></Placemark>"))
    _documents(t.lattice_nodes, c("node"), text, "kml", path)
    got = files.read_kml_placemarks(t.spark, path)
    return got.select("name", F.trim(c("fields")["col"]).alias("col"), r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"), F.size("points").alias("points"))


@query("s5_geojson_features", "SELECT CAST(region_id AS VARCHAR) AS region, ring, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {regions}")
def _(t: Tables):
    path = new_path(t.spark, "geojson")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.array(p["lon"], p["lat"]))
    rings = t.regions.groupBy("region_id", "ring").agg(ring.alias("p")).withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("ring", "p"))), lambda r: r["p"])
    feature = F.struct(F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("region"), c("region_id").cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), c("coordinates")).alias("geometry")).alias("f"))
    docs = rings.groupBy("region_id").agg(shape.alias("coordinates")).select(F.to_json(F.struct(F.array(feature["f"]).alias("features"))).alias("value"))
    docs.write.option("maxRecordsPerFile", 1).text(path)
    got = files.read_geojson_features(t.spark, path)
    return got.select(c("properties")["region"].alias("region"), "ring", "seq", r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"))


@query("s6_overpass_ways", "SELECT way, seq, node, round(lat, 6) AS lat, round(lon, 6) AS lon, highway, oneway FROM {way_points} WHERE way % 9 > 0")
def _(t: Tables):
    path = new_path(t.spark, "overpass")
    points = F.array_sort(F.collect_list(F.struct("seq", "node", "lat", "lon")))
    ways = t.way_points.groupBy("way").agg(points.alias("p"), F.first("highway").alias("highway"), F.first("oneway").alias("oneway"))
    nodes = F.when(c("way") % 9 == 0, F.slice("p.node", 2, 1 << 20)).otherwise(c("p.node"))  # torn: nodes and geometry differ
    element = F.struct(F.lit("way").alias("type"), c("way").alias("id"), nodes.alias("nodes"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("geometry"), F.create_map(F.lit("highway"), "highway", F.lit("oneway"), "oneway").alias("tags"))
    docs = ways.select(F.floor(c("way") / 500).alias("file"), element.alias("e")).groupBy("file").agg(F.collect_list("e").alias("elements"))
    docs.select(F.to_json(F.struct("elements")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = files.read_overpass_ways(t.spark, path)
    return got.select("way", c("seq").cast("long").alias("seq"), "node", r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"), "highway", "oneway")


@query("s7_alert_rss", "SELECT 'alert ' || event_id AS title, CAST(date_trunc('second', ts) AS TIMESTAMP) AS published, round(10 + event_id % 7 / 10e0, 6) AS lat, round(80 + event_id % 9 / 10e0, 6) AS lon FROM {events} WHERE event_id % 3 <> 1")
def _(t: Tables):
    path = new_path(t.spark, "rss")
    k = c("event_id")
    country = F.when(k % 3 == 0, "<gdacs:country>India</gdacs:country>").when(k % 3 == 1, "<gdacs:country>Peru</gdacs:country>").otherwise("")
    lat, lon = (10 + k % 7 / 10.0).cast("string"), (80 + k % 9 / 10.0).cast("string")
    where = F.when(k % 2 == 0, F.concat(F.lit("<georss:point>"), lat, F.lit(" "), lon, F.lit("</georss:point>"))).otherwise(F.concat(F.lit("<geo:Point><geo:lat>"), lat, F.lit("</geo:lat><geo:long>"), lon, F.lit("</geo:long></geo:Point>")))
    when = F.date_format(c("ts").cast("timestamp"), "EEE, d MMM yyyy HH:mm:ss")
    _documents(t.events, k, F.concat(F.lit("<item><title>alert "), k, F.lit("</title><link>l</link><pubDate>"), when, F.lit(" GMT</pubDate>"), where, country, F.lit("</item>")), "rss", path)
    got = files.read_alert_rss(t.spark, path, "India")
    return got.select("title", c("published").cast("timestamp_ntz").alias("published"), r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"))


@query("s8_hourly_forecast", "SELECT event_id % 9 AS point, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS t, round(sum(value), 4) AS mm FROM {events} GROUP BY 1, 2")
def _(t: Tables):
    path = new_path(t.spark, "forecast")
    hours = t.events.groupBy((c("event_id") % 9).alias("point"), F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("mm"))
    replies = hours.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("h", "mm"))).alias("x"))  # the hours of a forecast at one point
    stamps = F.transform("x", lambda x: F.date_format(x["h"], "yyyy-MM-dd'T'HH:mm"))
    doc = F.struct((c("point") * 1.0).alias("latitude"), F.lit(80.0).alias("longitude"), F.struct(stamps.alias("time"), c("x.mm").alias("precipitation")).alias("hourly"))
    replies.select(F.to_json(doc).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = files.read_hourly_forecast(t.spark, path)
    return got.select(F.split("point", r"\.")[0].cast("long").alias("point"), c("t").cast("timestamp_ntz").alias("t"), F.round("mm", 4).alias("mm"))


@query("s9_gpx_traces", "SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS t, round(min(13 + event_id % 90 / 1000e0), 6) AS lat FROM {events} GROUP BY 1")
def _(t: Tables):
    path = new_path(t.spark, "gpx")
    stamp = F.date_format(F.date_trunc("second", c("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.concat(F.lit('<trkpt lat="'), 13 + c("event_id") % 90 / 1000.0, F.lit('" lon="80.1"><time>'), stamp, F.lit("</time></trkpt>"))
    _documents(t.events, c("event_id"), point, "gpx", path)
    got = files.read_gpx(t.spark, path).groupBy(c("t").cast("timestamp_ntz").alias("t")).agg(F.min("lat").alias("lat"))
    return got.select("t", r6(c("lat")).alias("lat"))


@query("s9_csv_traces", "SELECT CAST(user_id AS VARCHAR) AS trace, round(EPOCH(ts) + 0e0, 3) AS t, round(value, 6) AS s FROM {events}")
def _(t: Tables):
    path = new_path(t.spark, "traces")
    t.events.select(c("user_id").alias("trace"), (F.unix_timestamp("ts") * 1.0).cast("decimal(20,3)").alias("t"), c("value").alias("s")).write.option("header", True).csv(path)
    got = files.read_csv_traces(t.spark, path, ["trace", "t", "s"])
    return got.select("trace", F.round(c("t"), 3).alias("t"), r6(c("s")).alias("s"))


@query("s10_places", "SELECT name, round(place_id / 10e0, 6) AS lat, kind, 2 AS spellings FROM {gazetteer}")
def _(t: Tables):
    path = new_path(t.spark, "places")
    text = lambda x: c(x).cast("string")
    line = F.to_json(F.array("name", (c("place_id") / 10.0).cast("string"), F.lit("80.5"), text("kind"), F.upper("name"), F.lit("other")))
    torn = t.gazetteer.select(F.lit('["cut", 1').alias("value")).limit(1)
    t.gazetteer.select(line.alias("value")).unionByName(torn).write.text(path)
    got = files.read_places(t.spark, path)
    return got.select("name", r6(c("lat")).alias("lat"), "kind", F.size("alt").alias("spellings"))
