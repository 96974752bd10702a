"""Scalar functions, predicates and cleaning rules as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.functions import belief, geo, rules
from hazardspark.plans.registry import Tables, query
from hazardspark.plans.views import haversine

c, r6 = F.col, lambda x: F.round(x, 6)


@query("f1_distances", f"""SELECT edge_id, round({haversine('lat1', 'lon1', 'lat2', 'lon2')}, 6) AS haversine_m,
    round(6371000e0 * sqrt(pow(radians(lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2) + pow(radians(lat2 - lat1), 2)), 6) AS equirect_m FROM {{lattice_edges}}""")
def _(t: Tables):
    at = [c(x) for x in ("lat1", "lon1", "lat2", "lon2")]
    return t.lattice_edges.select("edge_id", r6(geo.haversine_m(*at)).alias("haversine_m"), r6(geo.equirect_m(*at)).alias("equirect_m"))


@query("f2_weights", """SELECT id, round(CASE WHEN distance_m > 300 THEN 0 ELSE exp(-distance_m / 75e0) END, 6) AS kappa,
    round(exp(-(EPOCH(received_at) - EPOCH(observed_at)) / h.tau), 6) AS decay, round(ln(s.alpha / (1 - s.alpha)), 6) AS weight
    FROM {obs_edge} o JOIN {hazards} h ON h.hazard_class = o.hazard_class JOIN {sources} s ON s.source_class = o.source_class""")
def _(t: Tables):
    rows = t.obs_edge.join(F.broadcast(t.hazards), "hazard_class").join(F.broadcast(t.sources), "source_class")
    age = (F.unix_timestamp("received_at") - F.unix_timestamp("observed_at")).cast("double")
    return rows.select("id", r6(belief.kernel(c("distance_m"))).alias("kappa"), r6(belief.decay(age, c("tau"))).alias("decay"), r6(belief.logit(c("alpha"))).alias("weight"))


@query("f3_reliability", "SELECT id, o.source_class, round(least(1e0, greatest(0e0, ln(alpha / (1 - alpha)) / ln(0.97e0 / 0.03e0))), 6) AS w FROM {obs} o JOIN {sources} s ON s.source_class = o.source_class")
def _(t: Tables):
    return t.obs.join(F.broadcast(t.sources), "source_class").select("id", "source_class", r6(belief.reliability_weight(c("alpha"))).alias("w"))


@query("f4_pessimistic_wald", "SELECT edge_id, user_class, round(least(1e0, prior_p + z * sqrt(prior_p * (1 - prior_p) / (edge_id % 5 + 1e0))), 6) AS p_tilde FROM {edge_prior} CROSS JOIN {users}")
def _(t: Tables):
    rows = t.edge_prior.crossJoin(F.broadcast(t.users))  # four user classes
    return rows.select("edge_id", "user_class", r6(belief.pessimistic_wald(c("prior_p"), (c("edge_id") % 5).cast("double"), c("z"))).alias("p_tilde"))


@query("f6_safe_speed", """SELECT id, round(CASE WHEN depth_mm >= 0 THEN greatest(0e0, 0.0009e0 * least(depth_mm, 300e0) * least(depth_mm, 300e0) - 0.5529e0 * least(depth_mm, 300e0) + 86.9448e0) END, 6) AS v_safe,
    round(CASE WHEN depth_mm IS NULL THEN 1e0 ELSE greatest(1e0, 40e0 / greatest(0e0, 0.0009e0 * least(depth_mm, 300e0) * least(depth_mm, 300e0) - 0.5529e0 * least(depth_mm, 300e0) + 86.9448e0)) END, 6) AS delta FROM {obs}""")
def _(t: Tables):
    return t.obs.select("id", r6(belief.v_safe_kmh(c("depth_mm"))).alias("v_safe"), r6(belief.slowdown(F.lit(40.0), c("depth_mm"))).alias("delta"))


_COST = """SELECT e.edge_id, u.user_class, round(CASE WHEN x.depth_mm > 300 AND p.prior_p >= 0.1e0 THEN NULL
    ELSE e.free_flow_seconds * (1 + p.prior_p * (CASE WHEN x.depth_mm IS NULL THEN 1e0 ELSE greatest(1e0, e.free_flow_kmh / (0.0009e0 * least(x.depth_mm, 300e0) * least(x.depth_mm, 300e0) - 0.5529e0 * least(x.depth_mm, 300e0) + 86.9448e0)) END - 1)) + u.lam * p.prior_p * e.free_flow_seconds END, 6) AS cost_s
    FROM {lattice_edges} e JOIN {edge_prior} p ON p.edge_id = e.edge_id CROSS JOIN {users} u LEFT JOIN (SELECT edge_id, max(depth_mm) AS depth_mm FROM {obs_edge} GROUP BY edge_id) x ON x.edge_id = e.edge_id"""


@query("f7_edge_cost", _COST)
def _(t: Tables):
    depth = t.obs_edge.groupBy("edge_id").agg(F.max("depth_mm").alias("depth_mm"))
    rows = t.lattice_edges.join(t.edge_prior, "edge_id").join(depth, "edge_id", "left").crossJoin(F.broadcast(t.users))
    cost = belief.edge_cost(c("free_flow_seconds"), c("free_flow_kmh"), c("prior_p"), c("depth_mm"), F.lit(1.0), c("lam"), F.lit(300.0), F.lit(0.1))
    return rows.select("edge_id", "user_class", r6(cost).alias("cost_s"))


@query("f8_profile_seconds", """WITH p AS (SELECT 'foot' AS profile UNION ALL SELECT 'bicycle' UNION ALL SELECT 'emergency' UNION ALL SELECT 'car'),
    s AS (SELECT profile, edge_id, length_m, CASE profile WHEN 'car' THEN free_flow_kmh WHEN 'foot' THEN CASE highway WHEN 'primary' THEN 4.5e0 WHEN 'trunk' THEN 4e0 ELSE 5e0 END
      WHEN 'bicycle' THEN CASE highway WHEN 'tertiary' THEN 14e0 WHEN 'secondary' THEN 12e0 WHEN 'primary' THEN 10e0 WHEN 'trunk' THEN 8e0 ELSE 15e0 END
      ELSE least(90e0, free_flow_kmh * CASE highway WHEN 'tertiary' THEN 1.15e0 WHEN 'secondary' THEN 1.3e0 WHEN 'primary' THEN 1.4e0 WHEN 'trunk' THEN 1.4e0 ELSE 1e0 END) END AS kmh, false AS reversed FROM {lattice_edges} CROSS JOIN p)
    SELECT profile, edge_id, round(length_m / (kmh / 3.6e0), 6) AS seconds, reversed FROM s
    UNION ALL SELECT s.profile, s.edge_id, round(s.length_m / (s.kmh / 3.6e0), 6), true FROM s JOIN {lattice_edges} e ON e.edge_id = s.edge_id
      WHERE s.profile = 'foot' AND NOT EXISTS (SELECT 1 FROM {lattice_edges} b WHERE b.from_node = e.to_node AND b.to_node = e.from_node)""")
def _(t: Tables):
    from hazardspark.operators.graph import profile_edges

    rows = None
    for name, profile in config.PROFILES.items():
        one = profile_edges(t.lattice_edges, profile).select(F.lit(name).alias("profile"), "edge_id", r6(c("seconds")).alias("seconds"), "reversed")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("f9_name_keys", """SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS k, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM {benchmark}""")
def _(t: Tables):
    return t.benchmark.select("item_id", rules.name_key(c("text")).alias("k"), rules.norm_text(c("text")).alias("norm"))


@query("f10_parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM {orders}""")
def _(t: Tables):
    text = F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy HH:mm")).when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return t.orders.select("o_orderkey", rules.parse_day(text).alias("d"))


@query("f11_split_list", "SELECT p_partkey, len(list_filter(list_transform(string_split(replace(p_name, ' ', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> '')) AS n, CAST(p_retailprice AS BIGINT) - CASE WHEN CAST(p_retailprice AS BIGINT) > p_retailprice THEN 1 ELSE 0 END AS price FROM {part}")
def _(t: Tables):
    parts = rules.split_list(F.regexp_replace("p_name", " ", " , ,"))
    return t.part.select("p_partkey", F.size(parts).cast("long").alias("n"), rules.to_int(F.concat(F.lit(" "), c("p_retailprice").cast("string"))).alias("price"))


@query("f12_reading_day", "SELECT event_id, CAST(ts - INTERVAL '3' HOUR AS DATE) AS day_b, CAST(ts + INTERVAL '21' HOUR AS DATE) AS day_a FROM {events}")
def _(t: Tables):
    return t.events.select("event_id", rules.reading_day(c("ts")).alias("day_b"), rules.reading_day(c("ts"), "A").alias("day_a"))


@query("f13_time_bin", """SELECT event_id, (CASE WHEN isodow(ts + INTERVAL '330' MINUTE) >= 6 THEN 'weekend' ELSE 'weekday' END) || '_' || (CASE WHEN hour(ts + INTERVAL '330' MINUTE) BETWEEN 8 AND 10 THEN 'am_peak'
    WHEN hour(ts + INTERVAL '330' MINUTE) BETWEEN 17 AND 19 THEN 'pm_peak' WHEN hour(ts + INTERVAL '330' MINUTE) BETWEEN 11 AND 16 THEN 'day' ELSE 'night' END) AS bin FROM {events}""")
def _(t: Tables):
    return t.events.select("event_id", rules.time_bin(F.unix_timestamp("ts")).alias("bin"))


@query("f14_human_age", """WITH a AS (SELECT event_id, (event_id * 977) % 400000 AS s FROM {events})
    SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN s < 5400 THEN round_even(s / 60e0, 0)::BIGINT || ' min ago'
    WHEN s < 172800 THEN replace(CAST(round_even(s / 360e0, 0) / 10 AS VARCHAR) || ' h ago', '.0 h', ' h') ELSE (s // 86400) || ' days ago' END AS age FROM a""")
def _(t: Tables):
    return t.events.select("event_id", rules.human_age((c("event_id") * 977) % 400000).alias("age"))


@query("f15_display_name", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN p_name WHEN contains(lower(p_name), lower(p_type)) THEN p_name ELSE p_name || ' (' || p_type || ')' END AS name FROM {part}""")
def _(t: Tables):
    name = F.when(c("p_partkey") % 4 != 0, c("p_name"))
    ref = F.when(c("p_partkey") % 4 == 0, c("p_brand")).when(c("p_partkey") % 4 > 1, c("p_type"))
    return t.part.select("p_partkey", rules.display_name(name, ref).alias("name"))


@query("f16_item_id", "SELECT page_id, substr(sha256(url || chr(10) || html), 1, 16) AS item FROM {pages}")
def _(t: Tables):
    return t.pages.select("page_id", F.substring(F.sha2(F.concat("url", F.lit("\n"), "html"), 256), 1, 16).alias("item"))


@query("f17_uuid7", "SELECT event_id, epoch_us(ts) // 1000 AS ms, 36::BIGINT AS chars FROM {events}")
def _(t: Tables):
    u = rules.uuid7(F.unix_millis(c("ts").cast("timestamp")), c("event_id"))
    return t.events.select("event_id", rules.uuid7_ms(u).alias("ms"), F.char_length(u).cast("long").alias("chars"))


@query("f18_mercator", "SELECT o_orderkey, round(degrees(o_totalprice * 50e0 / 6378137e0), 6) AS lon, round(degrees(atan((exp(o_totalprice * 10e0 / 6378137e0) - exp(-o_totalprice * 10e0 / 6378137e0)) / 2)), 6) AS lat FROM {orders}")
def _(t: Tables):
    return t.orders.select("o_orderkey", r6(geo.mercator_lon(c("o_totalprice") * 50)).alias("lon"), r6(geo.mercator_lat(c("o_totalprice") * 10)).alias("lat"))


@query("f19_rain_rate", "SELECT link, step, round(CASE WHEN loss - 41e0 > 0 THEN pow((loss - 41e0) / 5e0 / 0.2e0, 1 / 0.9e0) WHEN loss IS NOT NULL THEN 0 END, 6) AS mm_h FROM {link_loss}")
def _(t: Tables):
    from hazardspark.operators.signals import rain_rate

    return t.link_loss.select("link", "step", r6(rain_rate(c("loss"), F.lit(41.0), F.lit(0.0), F.lit(5.0), F.lit(0.2), F.lit(0.9))).alias("mm_h"))


@query("f20_json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}")
def _(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("p1_filter_bbox", "SELECT id, lat, lon FROM (SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {obs}) x WHERE lat BETWEEN 12.9e0 AND 13.1e0 AND lon BETWEEN 80e0 AND 80.2e0")
def _(t: Tables):
    from hazardspark.operators.observations import filter_bbox

    return filter_bbox(t.obs.select("id", r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon")), 12.9, 80.0, 13.1, 80.2)


@query("p2_filter_time", "SELECT id FROM {obs} WHERE observed_at >= TIMESTAMP '2024-01-05 00:00:00' AND received_at > TIMESTAMP '2024-01-06 00:00:00'")
def _(t: Tables):
    from hazardspark.operators.observations import filter_time

    return filter_time(t.obs, since="2024-01-05 00:00:00", received_since="2024-01-06 00:00:00").select("id")


@query("p3_within_radius", f"SELECT id, round({haversine('12.9e0', '80.1e0', 'lat', 'lon')}, 3) AS m FROM {{obs}} WHERE {haversine('12.9e0', '80.1e0', 'lat', 'lon')} <= 5000")
def _(t: Tables):
    from hazardspark.operators.observations import within_radius

    return within_radius(t.obs, 12.9, 80.1, 5000.0).select("id", F.round("distance_m", 3).alias("m"))


@query("p4_window_by_clock", "SELECT id, EPOCH(TIMESTAMP '2024-01-10 00:00:00') - EPOCH(observed_at) AS age_s FROM {obs} WHERE observed_at <= TIMESTAMP '2024-01-10 00:00:00'")
def _(t: Tables):
    from hazardspark.operators.observations import window_by_clock

    return window_by_clock(t.obs, "2024-01-10 00:00:00").select("id", (F.unix_timestamp(F.lit("2024-01-10 00:00:00").cast("timestamp")) - F.unix_timestamp("observed_at")).alias("age_s"))


@query("p5_fixed_ttl", """SELECT hazard_class, count(*) FILTER (WHERE age BETWEEN 0 AND 86400) AS kept, count(*) FILTER (WHERE NOT age BETWEEN 0 AND 86400) AS dropped
    FROM (SELECT hazard_class, EPOCH(TIMESTAMP '2024-01-10 00:00:00') - EPOCH(observed_at) AS age FROM {obs}) x GROUP BY hazard_class""")
def _(t: Tables):
    from hazardspark.operators.observations import ttl_counts

    return ttl_counts(t.obs, "2024-01-10 00:00:00", 86400)


@query("p6_validate_observations", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN id % 101 = 0 THEN 'no time' WHEN lat + CASE WHEN id % 103 = 0 THEN 90 ELSE 0 END > 90 THEN 'bad position'
    WHEN received_at < observed_at THEN 'received before observed' WHEN depth_mm < 0 THEN 'bad depth' ELSE 'valid' END AS reason FROM {obs}) x GROUP BY reason""")
def _(t: Tables):
    from hazardspark.operators.observations import validate_observations

    rows = t.obs.withColumns({"observed_at": F.when(c("id") % 101 != 0, c("observed_at")), "lat": c("lat") + F.when(c("id") % 103 == 0, 90).otherwise(0)})
    return validate_observations(rows).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


_NOW = "TIMESTAMP '2024-01-16 00:00:00'"


@query("p7_validate_field_log", f"""SELECT reason, count(*) AS n, round(sum(lat), 4) AS lats FROM (SELECT CASE WHEN depth_band IS NOT NULL AND state <> 'not_passable' THEN 'depth needs not_passable'
    WHEN site_id = 'adhoc' AND (lat IS NULL OR lon IS NULL) THEN 'adhoc needs a position' WHEN site_id = 'adhoc' AND NOT (lat BETWEEN 8 AND 14.5 AND lon BETWEEN 76 AND 81) THEN 'outside the region'
    WHEN observed_at > {_NOW} + INTERVAL '5' MINUTE THEN 'in the future' WHEN observed_at < {_NOW} - INTERVAL '14' DAY THEN 'too old' ELSE 'valid' END AS reason, round_even(lat, 4) AS lat FROM {{field_log}}) x GROUP BY reason""")
def _(t: Tables):
    from hazardspark.operators.fieldlog import validate_field_log

    return validate_field_log(t.field_log, "2024-01-16 00:00:00").groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("lat"), 4).alias("lats"))


@query("p8_normalise_heat", "SELECT event_id, CASE WHEN value / 8 >= 40 THEN 1 ELSE -1 END AS polarity FROM {events} WHERE event_id % 17 <> 0")
def _(t: Tables):
    from hazardspark.operators.observations import normalise_heat

    return normalise_heat(t.events.withColumn("apparent", F.when(c("event_id") % 17 != 0, c("value") / 8)), "apparent").select("event_id", "polarity")


@query("p9_coarsen_privacy", """SELECT id, round(CASE WHEN old THEN round(lat / 0.00135e0) * 0.00135e0 ELSE lat END, 6) AS lat, CASE WHEN old AND source_class IN ('crowd', 'app_traversal') THEN sha256(source_id) ELSE source_id END AS source_id, old AS coarsened
    FROM (SELECT *, observed_at < TIMESTAMP '2024-01-15 00:00:00' AS old FROM {obs}) x""")
def _(t: Tables):
    from hazardspark.operators.observations import coarsen_privacy

    return coarsen_privacy(t.obs, "2024-01-15 00:00:00").select("id", r6(c("lat")).alias("lat"), "source_id", "coarsened")


@query("p10_live_reports", """WITH v AS (SELECT o.*, h.tau FROM {obs_edge} o JOIN {hazards} h ON h.hazard_class = o.hazard_class WHERE EPOCH(TIMESTAMP '2024-01-10 00:00:00') - EPOCH(observed_at) BETWEEN 0 AND 2 * h.tau),
    k AS (SELECT edge_id, hazard_class, max(observed_at) FILTER (WHERE polarity = -1) AS cleared FROM v GROUP BY edge_id, hazard_class)
    SELECT v.id, v.edge_id FROM v JOIN k ON k.edge_id = v.edge_id AND k.hazard_class = v.hazard_class WHERE v.polarity = 1 AND (k.cleared IS NULL OR v.observed_at > k.cleared)""")
def _(t: Tables):
    from hazardspark.operators.observations import live_reports

    return live_reports(t.obs_edge, t.hazards, "2024-01-10 00:00:00").select("id", "edge_id")


@query("p11_report_kind", """WITH d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'No water here' WHEN 1 THEN 'about 12.5 cm deep' WHEN 2 THEN 'Test row' WHEN 3 THEN 'not water logged 3cm' ELSE 'road wet' END AS s FROM {events})
    SELECT event_id, CASE WHEN contains(lower(s), 'test') THEN NULL WHEN regexp_matches(lower(s), 'no water|no stagnation|not water') THEN 'not_waterlogged' WHEN regexp_matches(lower(s), '[0-9]+([.][0-9]+)?\\s*cm') THEN 'depth' ELSE 'report_unclear' END AS kind FROM d""")
def _(t: Tables):
    k = c("event_id") % 5
    s = F.when(k == 0, "No water here").when(k == 1, "about 12.5 cm deep").when(k == 2, "Test row").when(k == 3, "not water logged 3cm").otherwise("road wet")
    return t.events.select("event_id", rules.report_kind(s).alias("kind"))


@query("p12_depth_band", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 61 WHEN 2 THEN 152 WHEN 3 THEN round_even((event_id % 9) * 0.5e0 * 30.48e0, 0) END::BIGINT AS lo,
    CASE event_id % 5 WHEN 0 THEN 61 WHEN 1 THEN 91 WHEN 3 THEN round_even((event_id % 9 + 1) * 0.5e0 * 30.48e0, 0) END::BIGINT AS hi FROM {events}""")
def _(t: Tables):
    k = c("event_id") % 5
    span = F.format_string("%.1f-%.1f", (c("event_id") % 9) * 0.5, (c("event_id") % 9 + 1) * 0.5)
    lo, hi = rules.depth_cm(F.when(k == 0, "<2 ft").when(k == 1, "2 to 3 ft").when(k == 2, ">5ft").when(k == 3, span).otherwise("deep"))
    return t.events.select("event_id", lo.alias("lo"), hi.alias("hi"))


@query("p13_place_category", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'health' WHEN p_size < 20 THEN 'education' WHEN p_type = 'ECONOMY' THEN 'shop' WHEN p_size % 7 = 0 THEN 'landmark' WHEN p_size % 5 = 0 THEN 'park' ELSE NULL END AS category FROM {part}""")
def _(t: Tables):
    from hazardspark.operators.places import place_category

    tags = F.create_map(F.lit("amenity"), F.when(c("p_size") < 10, "hospital").when(c("p_size") < 20, "school").otherwise("bench"), F.lit("shop"), F.when(c("p_type") == "ECONOMY", "supermarket"), F.lit("historic"), F.when(c("p_size") % 7 == 0, "fort"), F.lit("leisure"), F.when(c("p_size") % 5 == 0, "garden"))
    return t.part.select("p_partkey", place_category(tags).alias("category"))


@query("p13_place_kind", """SELECT p_partkey, CASE WHEN k = 0 THEN 'worship' WHEN k = 1 THEN 'rail' WHEN k = 2 THEN 'shop' WHEN k = 3 THEN 'landmark' WHEN k = 4 THEN 'utility' WHEN k = 5 THEN 'health' WHEN k = 6 THEN 'police' END AS category,
    CASE k WHEN 0 THEN CASE p_size % 3 WHEN 0 THEN 'temple' WHEN 1 THEN 'church' ELSE 'place of worship' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'metro station' ELSE 'railway station' END WHEN 2 THEN replace(p_name, '_', ' ') WHEN 3 THEN 'theme park' WHEN 4 THEN 'power plant' WHEN 5 THEN 'ambulance station' WHEN 6 THEN 'police' END AS kind
    FROM (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS p_name, p_partkey % 8 AS k FROM {part}) x""")
def _(t: Tables):
    from hazardspark.operators.places import place_class

    k, is_k = c("p_partkey") % 8, lambda n, v: F.when(c("p_partkey") % 8 == n, v)
    religion = F.when(c("p_size") % 3 == 0, "hindu").when(c("p_size") % 3 == 1, "christian").otherwise("other")
    tags = {
        "amenity": F.when(k == 0, "place_of_worship").when(k == 6, "police"), "religion": religion, "public_transport": is_k(1, "station"), "railway": is_k(1, "yes"), "subway": F.when(c("p_size") % 2 == 0, "yes"),
        "shop": is_k(2, F.replace("p_name", F.lit(" "), F.lit("_"))), "tourism": is_k(3, "theme_park"), "power": is_k(4, "plant"), "emergency": is_k(5, "ambulance_station"),
    }
    kind = place_class(F.create_map(*[x for name, v in tags.items() for x in (F.lit(name), v)]))
    return t.part.select("p_partkey", kind["category"].alias("category"), kind["kind"].alias("kind"))


@query("p14_intensity_band", "SELECT event_id, CASE WHEN value / 6 >= 50 THEN 'violent' WHEN value / 6 >= 7.6e0 THEN 'heavy' WHEN value / 6 >= 2.5e0 THEN 'moderate' WHEN value / 6 >= 0.1e0 THEN 'light' ELSE 'none' END AS band FROM {events}")
def _(t: Tables):
    return t.events.select("event_id", rules.intensity_band(c("value") / 6).alias("band"))


@query("p15_rain_level", "SELECT slot, CASE WHEN mean_mm_h >= 15 OR peak_mm_h >= 25 THEN 'active' WHEN mean_mm_h >= 8 OR peak_mm_h >= 7.6e0 THEN 'watch' ELSE 'dry' END AS level FROM {rain_slices}")
def _(t: Tables):
    return t.rain_slices.select("slot", rules.rain_level(c("mean_mm_h"), c("peak_mm_h")).alias("level"))


@query("p16_basin_label", "SELECT node, CASE WHEN lat > 13.1e0 THEN 'Kosasthalaiyar' WHEN lat > 13.02e0 THEN 'Cooum' WHEN lat > 12.9e0 THEN 'Adyar' ELSE 'Kovalam' END AS basin FROM (SELECT node, lat + 0.0001e0 AS lat FROM {lattice_nodes}) x")
def _(t: Tables):
    return t.lattice_nodes.select("node", rules.basin_label(c("lat") + 0.0001).alias("basin"))


@query("p17_confidence_band", "SELECT id, CASE WHEN (id % 50) * 400 > 2 * h.tau THEN 'stale' WHEN id % 6 / 1.5e0 < 1 THEN 'low' WHEN id % 6 / 1.5e0 < 3 THEN 'moderate' ELSE 'high' END AS band FROM {obs} o JOIN {hazards} h ON h.hazard_class = o.hazard_class")
def _(t: Tables):
    return t.obs.join(F.broadcast(t.hazards), "hazard_class").select("id", belief.confidence_band(c("id") % 6 / 1.5, c("id") % 50 * 400, c("tau")).alias("band"))


@query("p18_language_label", """SELECT doc_id, CASE WHEN len(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 AND len(regexp_replace(text, '[^éèêç]', '', 'g')) / len(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 0.1 THEN 'fr' ELSE 'other' END AS label FROM {documents}""".replace("{L}", "\x01L\x02"))
def _(t: Tables):
    return t.documents.select("doc_id", F.when(rules.language_share(c("text"), "éèêç") >= 0.1, "fr").otherwise("other").alias("label"))


@query("p19_drop_noncommercial", "SELECT p_partkey FROM {part} WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def _(t: Tables):
    from hazardspark.operators.events import drop_licences

    return drop_licences(t.part, "p_brand", ["Brand#1", "Brand#2"]).select("p_partkey")


@query("p20_says_underpass", "SELECT p_partkey, p_name LIKE '%ring%' OR p_type LIKE '%PROMO%' AS under FROM {part}")
def _(t: Tables):
    from hazardspark.operators.places import any_tag_says

    tags = F.create_map(F.lit("name"), c("p_name"), F.lit("name:en"), c("p_type"), F.lit("size"), c("p_size").cast("string"))
    return t.part.select("p_partkey", any_tag_says(tags, "^name", ["ring", "promo"]).alias("under"))


@query("p21_footprints", """WITH s AS (SELECT region_id, seq, lat, lon, lead(lat, 1, first_lat) OVER (PARTITION BY region_id ORDER BY seq) AS lat2, lead(lon, 1, first_lon) OVER (PARTITION BY region_id ORDER BY seq) AS lon2, mid FROM
      (SELECT *, first_value(lat) OVER (PARTITION BY region_id ORDER BY seq) AS first_lat, first_value(lon) OVER (PARTITION BY region_id ORDER BY seq) AS first_lon, avg(lat) OVER (PARTITION BY region_id) AS mid FROM {regions} WHERE ring = 0) q)
    SELECT region_id, round(abs(sum(lon * lat2 - lon2 * lat)) / 2 * 111320e0 * 111320e0 * cos(radians(max(mid))) / 1e6, 4) AS km2 FROM s GROUP BY region_id""")
def _(t: Tables):
    from hazardspark.operators.places import footprint_area

    ring = t.regions.filter("ring = 0").groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("points"))
    return ring.select("region_id", F.round(footprint_area(c("points")) / 1e6, 4).alias("km2"))
