"""Studies, certificates, clusters and remaining text checks as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.operators import graph, paths, scoring, spatial, studies, textchecks
from hazardspark.plans.registry import Tables, query
from hazardspark.plans.views import drawn, haversine
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)


@query("a22_summarise_routes", "SELECT o_orderpriority AS grp, round(avg(r), 6) AS mean_detour, round(median(r), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, count(*) FILTER (WHERE r IS NULL) AS disconnected, round(avg(CASE WHEN r >= 1.5 THEN 1e0 WHEN r < 1.5 THEN 0e0 END), 6) AS long_share FROM (SELECT *, CASE WHEN o_orderkey % 19 > 0 THEN (o_totalprice + o_custkey * 20e0) / o_totalprice END AS r FROM {orders}) x GROUP BY 1")
def _(t: Tables):
    rows = t.orders.select(c("o_orderpriority").alias("grp"), F.when(c("o_orderkey") % 19 > 0, c("o_totalprice") + c("o_custkey") * 20.0).alias("duration_s"), c("o_totalprice").alias("best_s"))
    out = studies.summarise_routes(rows, "grp")
    return out.select("grp", *[r6(c(x)).alias(x) for x in ("mean_detour", "p50", "p95")], "disconnected", r6(c("long_share")).alias("long_share"))


@query("a30_feature_centre", f"""WITH u AS (SELECT * FROM (SELECT c_nationkey AS feature, c_mktsegment = 'BUILDING' AND c_nationkey % 3 > 0 AS tunnel, max(CAST(c_mktsegment = 'BUILDING' AND c_nationkey % 3 > 0 AS INT)) OVER (PARTITION BY c_nationkey) AS k, lat, lon FROM {{lattice_nodes}}) x WHERE tunnel OR k = 0),
    m AS (SELECT feature, avg(lat) AS a, avg(lon) AS o FROM u GROUP BY feature) SELECT u.feature, round(max(a), 6) AS lat, round(max(o), 6) AS lon, round(max({haversine('lat', 'lon', 'a', 'o')}), 3) AS span_m, count(*) AS pieces FROM u JOIN m ON m.feature = u.feature GROUP BY u.feature""")
def _(t: Tables):
    pieces = t.lattice_nodes.select(c("c_nationkey").alias("feature"), ((c("c_mktsegment") == "BUILDING") & (c("c_nationkey") % 3 > 0)).alias("tunnel"), "lat", "lon")
    return studies.feature_centre(pieces).select("feature", r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"), F.round("span_m", 3).alias("span_m"), "pieces")


@query("f22_name_similarity", "SELECT p_partkey, CASE WHEN lower(p_name) = 'small ring' THEN 1e0 WHEN contains(' ' || lower(p_name) || ' ', ' ring ') THEN 0.9e0 ELSE round(1 - levenshtein(lower(p_name), 'small ring') / greatest(length(p_name), 10), 6) END AS similarity FROM {part}")
def _(t: Tables):
    n, a = F.lower("p_name"), F.lit("small ring")
    ratio = 1 - F.levenshtein(n, a) / F.greatest(F.char_length(n), F.char_length(a))
    return t.part.select("p_partkey", F.when(n == a, 1.0).when(F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.lit(" ring ")), 0.9).otherwise(r6(ratio)).alias("similarity"))


@query("g4_sample_od_pairs")
def _(t: Tables):
    reached = paths.hops_from(t.lattice_edges, t.lattice_nodes.filter("node % 20 = 0"), written)
    return studies.sample_pairs(reached, 20, 20260914)


@query("g7_compare_configs", """WITH k AS (SELECT * FROM (VALUES ('C0', 0e0, 0e0), ('C2', 1e0, 0e0), ('C3', 1e0, 1e0)) AS v(cfg, use_prior, use_obs)), n AS (SELECT edge_id, count(*) AS n FROM {obs_edge} GROUP BY edge_id)
    SELECT cfg, round(sum(free_flow_seconds * (1 + use_prior * prior_p + use_obs * least(coalesce(n, 0), 5) / 10e0)), 3) AS seconds, count(*) AS edges FROM {lattice_edges} e JOIN {edge_prior} p ON p.edge_id = e.edge_id LEFT JOIN n ON n.edge_id = e.edge_id CROSS JOIN k GROUP BY cfg""")
def _(t: Tables):
    configs = t.spark.createDataFrame([("C0", 0.0, 0.0), ("C2", 1.0, 0.0), ("C3", 1.0, 1.0)], "cfg string, use_prior double, use_obs double")
    n = t.obs_edge.groupBy("edge_id").agg(F.count("*").alias("n"))
    rows = t.lattice_edges.join(t.edge_prior, "edge_id").join(n, "edge_id", "left").crossJoin(F.broadcast(configs))
    cost = c("free_flow_seconds") * (1 + c("use_prior") * c("prior_p") + c("use_obs") * F.least(F.coalesce("n", F.lit(0)), F.lit(5)) / 10.0)
    return rows.groupBy("cfg").agg(F.round(F.sum(cost), 3).alias("seconds"), F.count("*").alias("edges"))


@query("g11_exposure_share", """WITH mk AS (SELECT DISTINCT CAST(floor(lat / 0.01e0) AS BIGINT) AS cy, CAST(floor(lon / 0.01e0) AS BIGINT) AS cx FROM {zones}), e AS (SELECT r.route, e.*, greatest(1, CAST(ceil(length_m / 50e0) AS BIGINT)) AS n FROM {routes} r JOIN {lattice_edges} e ON e.edge_id = r.edge_id),
    p AS (SELECT route, lat1, lon1, lat2, lon2, n, unnest(range(n)) AS k FROM e), q AS (SELECT route, CAST(floor((lat1 + (k + 0.5e0) / n * (lat2 - lat1)) / 0.01e0) AS BIGINT) AS cy, CAST(floor((lon1 + (k + 0.5e0) / n * (lon2 - lon1)) / 0.01e0) AS BIGINT) AS cx FROM p)
    SELECT route, round(avg(CASE WHEN mk.cy IS NULL THEN 0e0 ELSE 1e0 END), 6) AS share, count(*) AS points FROM q LEFT JOIN mk ON mk.cy = q.cy AND mk.cx = q.cx GROUP BY route""")
def _(t: Tables):
    from hazardspark.functions.geo import cell

    mask = t.zones.select(cell(c("lat"), 0.01).alias("cy"), cell(c("lon"), 0.01).alias("cx")).distinct()
    lines = t.routes.join(t.lattice_edges, "edge_id").select("route", "lat1", "lon1", "lat2", "lon2", "length_m")
    return studies.exposure_share(lines, mask, 0.01).select("route", r6(c("share")).alias("share"), "points")


@query("g12_pareto_sweep", """WITH r AS (SELECT r.route, sum(e.free_flow_seconds) AS seconds, avg(p.prior_p) AS p, CAST(count(*) AS DOUBLE) AS n_eff FROM {routes} r JOIN {lattice_edges} e ON e.edge_id = r.edge_id JOIN {edge_prior} p ON p.edge_id = r.edge_id GROUP BY r.route),
    x AS (SELECT z, lam, seconds, least(1e0, p + z * sqrt(p * (1 - p) / (n_eff + 1))) AS pt FROM r CROSS JOIN (SELECT 0e0 AS z UNION ALL SELECT 1e0 UNION ALL SELECT 2e0) a CROSS JOIN (SELECT 0.3e0 AS lam UNION ALL SELECT 1e0) b)
    SELECT z, lam, round(avg(seconds * (1 + lam * pt)), 6) AS mean_cost, round(avg(pt), 6) AS mean_risk, count(*) AS n FROM x GROUP BY z, lam""")
def _(t: Tables):
    rows = t.routes.join(t.lattice_edges.select("edge_id", "free_flow_seconds"), "edge_id").join(t.edge_prior, "edge_id")
    routes = rows.groupBy("route").agg(F.sum("free_flow_seconds").alias("seconds"), F.avg("prior_p").alias("p"), F.count("*").cast("double").alias("n_eff"))
    grid = t.spark.createDataFrame([(z, lam) for z in (0.0, 1.0, 2.0) for lam in (0.3, 1.0)], "z double, lam double")
    return studies.pareto_sweep(routes, grid).select("z", "lam", r6(c("mean_cost")).alias("mean_cost"), r6(c("mean_risk")).alias("mean_risk"), "n")


@query("g13_compare_modes", """WITH e AS (SELECT r.route, e.length_m, e.length_m / (e.free_flow_kmh / 3.6e0) AS car, e.length_m / (CASE highway WHEN 'primary' THEN 4.5e0 WHEN 'trunk' THEN 4e0 ELSE 5e0 END / 3.6e0) AS foot FROM {routes} r JOIN {lattice_edges} e ON e.edge_id = r.edge_id),
    s AS (SELECT 'car' AS mode, route, sum(length_m) AS m, sum(car) AS s FROM e GROUP BY route UNION ALL SELECT 'foot', route, sum(length_m), sum(foot) FROM e GROUP BY route)
    SELECT mode, count(*) AS found, round(median(m) / 1000, 6) AS km, round(median(s) / 60, 6) AS minutes, round(median(m / s * 3.6e0), 6) AS kmh FROM s GROUP BY mode""")
def _(t: Tables):
    rows = None
    for mode in ("car", "foot"):
        edges = graph.profile_edges(t.lattice_edges, config.PROFILES[mode]).filter("NOT reversed").select("edge_id", "length_m", "seconds")
        one = t.routes.join(edges, "edge_id").select(F.lit(mode).alias("mode"), "route", "length_m", "seconds")
        rows = one if rows is None else rows.unionByName(one)
    return studies.compare_modes(rows, "mode", written).select("mode", "found", *[r6(c(x)).alias(x) for x in ("km", "minutes", "kmh")])


@query("g14_held_out_reports", """WITH o AS (SELECT DISTINCT edge_id FROM {obs_edge} WHERE source_class = 'official_feed'), k AS (SELECT DISTINCT edge_id FROM {obs_edge} WHERE source_class = 'crowd')
    SELECT r.route, count(o.edge_id) AS official, count(CASE WHEN k.edge_id IS NULL THEN o.edge_id END) AS official_unseen FROM {routes} r LEFT JOIN o ON o.edge_id = r.edge_id LEFT JOIN k ON k.edge_id = r.edge_id GROUP BY r.route""")
def _(t: Tables):
    seen = lambda s, name: t.obs_edge.filter(c("source_class") == s).select("edge_id").distinct().withColumn(name, F.lit(1))
    rows = t.routes.join(seen("official_feed", "o"), "edge_id", "left").join(seen("crowd", "k"), "edge_id", "left")
    return rows.groupBy("route").agg(F.count("o").alias("official"), F.count(F.when(c("k").isNull(), c("o"))).alias("official_unseen"))


@query("j13_nearest_lead", f"""WITH p AS (SELECT z.zone_id AS id, r.region_id, {haversine('z.lat', 'z.lon', 'r.lat', 'r.lon')} AS d FROM {{zones}} z JOIN {{regions}} r ON r.ring = 0 AND r.seq = 0 AND abs(z.lat - r.lat) < 0.03e0 AND abs(z.lon - r.lon) < 0.03e0)
    SELECT z.zone_id AS id, x.region_id, round(x.d, 3) AS distance_m FROM {{zones}} z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, region_id) AS k FROM p WHERE d <= 2500) x ON x.id = z.zone_id AND x.k = 1""")
def _(t: Tables):
    leads = t.regions.filter("ring = 0 AND seq = 0").select("region_id", "lat", "lon")
    return spatial.nearest_point(t.zones.select(c("zone_id").alias("id"), "lat", "lon"), leads, 2500.0, "region_id").select("id", "region_id", F.round("distance_m", 3).alias("distance_m"))


@query("j16_snap_signals", f"SELECT DISTINCT n.node FROM {{obs}} o JOIN {{lattice_nodes}} n ON abs(o.lat - n.lat) < 0.002e0 AND abs(o.lon - n.lon) < 0.002e0 WHERE {haversine('o.lat', 'o.lon', 'n.lat', 'n.lon')} <= 30")
def _(t: Tables):
    found = spatial.nearest_point(t.obs.select("id", "lat", "lon"), t.lattice_nodes.select("node", "lat", "lon"), 30.0, "node", 0.002, 0.002)
    return found.filter("node IS NOT NULL").select("node").distinct()


@query("j20_link_neighbours", f"SELECT a.zone_id AS link, b.zone_id AS other FROM {{zones}} a JOIN {{zones}} b ON a.zone_id <> b.zone_id AND abs(a.lat - b.lat) < 0.06e0 AND abs(a.lon - b.lon) < 0.06e0 WHERE {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 5000")
def _(t: Tables):
    return studies.link_neighbours(t.zones.select(c("zone_id").alias("link"), "lat", "lon"), 5000.0, 0.06)


@query("m7_calibration_by_age", """WITH g AS (SELECT unnest([0, 6, 24, 72]) AS age_h), x AS (SELECT g.age_h, o.edge_id, max(CASE WHEN o.source_class = 'official_feed' AND o.polarity = 1 THEN 1 ELSE 0 END) AS y,
      sum(CASE WHEN o.source_class <> 'official_feed' THEN polarity * CASE WHEN distance_m > 300 THEN 0e0 ELSE exp(-distance_m / 75e0) END * exp(-g.age_h * 3600e0 / h.tau) * ln(s.alpha / (1 - s.alpha)) ELSE 0e0 END) AS shift
      FROM {obs_edge} o CROSS JOIN g JOIN {hazards} h ON h.hazard_class = o.hazard_class JOIN {sources} s ON s.source_class = o.source_class GROUP BY g.age_h, o.edge_id)
    SELECT x.age_h, round(avg(pow(1 / (1 + exp(-(ln(p.prior_p / (1 - p.prior_p)) + shift))) - y, 2)), 6) AS brier, round(avg(pow(p.prior_p - y, 2)), 6) AS brier_prior, count(*) AS n FROM x JOIN {edge_prior} p ON p.edge_id = x.edge_id GROUP BY x.age_h""")
def _(t: Tables):
    from hazardspark.functions.belief import decay, kernel, logit, sigmoid

    ages = t.spark.createDataFrame([(a,) for a in (0, 6, 24, 72)], "age_h int")
    rows = t.obs_edge.join(F.broadcast(t.hazards), "hazard_class").join(F.broadcast(t.sources), "source_class").crossJoin(F.broadcast(ages))
    official = c("source_class") == "official_feed"
    w = c("polarity") * kernel(c("distance_m")) * decay(c("age_h") * 3600.0, c("tau")) * logit(c("alpha"))
    sums = rows.groupBy("age_h", "edge_id").agg(F.max(F.when(official & (c("polarity") == 1), 1).otherwise(0)).alias("y"), F.sum(F.when(~official, w).otherwise(0.0)).alias("shift"))
    p = sigmoid(logit(c("prior_p")) + c("shift"))
    scored = sums.join(t.edge_prior, "edge_id")
    return scored.groupBy("age_h").agg(r6(F.avg(F.pow(p - c("y"), 2))).alias("brier"), r6(F.avg(F.pow(c("prior_p") - c("y"), 2))).alias("brier_prior"), F.count("*").alias("n"))


@query("m10_route_certificates", """WITH o AS (SELECT edge_id, true AS pos FROM {obs_edge} WHERE source_class = 'official_feed' GROUP BY edge_id)
    SELECT r.route, round(min(CASE WHEN pos THEN prior_p END), 6) AS lowest, min(CASE WHEN pos THEN prior_p END) >= 0.1e0 AS covered, round(sum(CASE WHEN prior_p >= 0.1e0 THEN free_flow_seconds ELSE 0 END) / sum(free_flow_seconds), 6) AS flagged_share
    FROM {routes} r JOIN {lattice_edges} e ON e.edge_id = r.edge_id JOIN {edge_prior} p ON p.edge_id = r.edge_id LEFT JOIN o ON o.edge_id = r.edge_id GROUP BY r.route""")
def _(t: Tables):
    positive = t.obs_edge.filter("source_class = 'official_feed'").select("edge_id").distinct().withColumn("positive", F.lit(True))
    scores = t.edge_prior.withColumnRenamed("prior_p", "score").join(positive, "edge_id", "left")
    routes = t.routes.join(t.lattice_edges.select("edge_id", c("free_flow_seconds").alias("seconds")), "edge_id")
    out = studies.route_certificates(routes, scores, 0.1)
    return out.select("route", r6(c("lowest")).alias("lowest"), "covered", r6(c("flagged_share")).alias("flagged_share"))


@query("m28_greedy_clusters")
def _(t: Tables):
    return studies.greedy_clusters(t.zones, 3000.0, written)


@query("m30_unseen_blocks", """WITH s AS (SELECT *, CAST(floor(id / 3e0) AS BIGINT) % 90 AS blk FROM {scored}), tr AS (SELECT DISTINCT blk FROM s WHERE id % 10 < 2), te AS (SELECT * FROM s WHERE id % 10 >= 2 AND blk NOT IN (SELECT blk FROM tr)),
    gr AS (SELECT score, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM te GROUP BY score), cu AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp, sum(tp) OVER () AS p FROM gr) SELECT round(CASE WHEN max(p) > 0 THEN sum(tp * ctp / (ctp + cfp)) / max(p) END, 6) AS ap FROM cu""")
def _(t: Tables):
    s = t.scored.withColumn("blk", F.floor(c("id") / 3) % 90)
    seen = s.filter("id % 10 < 2").select("blk").distinct()
    return scoring.weighted_ap_auc(s.filter("id % 10 >= 2").join(seen, "blk", "left_anti")).select(r6(c("ap")).alias("ap"))


_M31 = f"""WITH bl AS (SELECT block, dense_rank() OVER (ORDER BY block) - 1 AS b FROM {{scored}} GROUP BY block), {drawn(200)},
    r AS (SELECT bl.b, y, scorer, v FROM (SELECT block, y, 'score' AS scorer, score AS v FROM {{scored}} UNION ALL SELECT block, y, 'score_b', score_b FROM {{scored}}) x JOIN bl ON bl.block = x.block),
    ct AS (SELECT scorer, quantile_cont(v, 0.9) AS cut FROM r GROUP BY scorer),
    w AS (SELECT rep, r.*, times FROM r JOIN dr ON dr.b = r.b UNION ALL SELECT NULL, r.*, 1 FROM r),
    gr AS (SELECT rep, w.scorer, v, v >= cut AS top, CAST(sum(times * y) AS DOUBLE) AS tp, CAST(sum(times * (1 - y)) AS DOUBLE) AS fp FROM w JOIN ct ON ct.scorer = w.scorer GROUP BY 1, 2, 3, 4),
    cu AS (SELECT *, sum(tp) OVER k AS ctp, sum(fp) OVER k AS cfp, sum(tp) OVER (PARTITION BY rep, scorer) AS p, sum(fp) OVER (PARTITION BY rep, scorer) AS q FROM gr WINDOW k AS (PARTITION BY rep, scorer ORDER BY v DESC)),
    ms AS (SELECT rep, scorer, CASE WHEN max(p) > 0 THEN sum(tp * ctp / (ctp + cfp)) / max(p) END AS ap, CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(tp * (q - cfp + fp / 2)) / (max(p) * max(q)) END AS auc, sum(CASE WHEN top THEN tp ELSE 0 END) / nullif(max(p), 0) AS capture FROM cu GROUP BY rep, scorer),
    lg AS (SELECT rep, measure, max(v) FILTER (WHERE scorer = 'score') AS a, max(v) FILTER (WHERE scorer = 'score_b') AS o FROM (UNPIVOT ms ON ap, auc, capture INTO NAME measure VALUE v) u GROUP BY rep, measure)
    SELECT measure, round(max(a) FILTER (WHERE rep IS NULL), 6) AS a, round(max(o) FILTER (WHERE rep IS NULL), 6) AS b, round(quantile_cont(a, 0.025) FILTER (WHERE rep IS NOT NULL), 6) AS a_low, round(quantile_cont(a, 0.975) FILTER (WHERE rep IS NOT NULL), 6) AS a_high,
      round(quantile_cont(a - o, 0.025) FILTER (WHERE rep IS NOT NULL), 6) AS diff_low, round(quantile_cont(a - o, 0.975) FILTER (WHERE rep IS NOT NULL), 6) AS diff_high, round(avg(CASE WHEN a > o THEN 1e0 ELSE 0e0 END) FILTER (WHERE rep IS NOT NULL), 6) AS a_better FROM lg GROUP BY measure"""


@query("m31_joint_bootstrap", _M31)
def _(t: Tables):
    blocks = t.scored.select("block").distinct().withColumn("b", (F.dense_rank().over(Window.orderBy("block")) - 1).cast("long"))  # a row for each block
    found = scoring.joint_block_bootstrap(t.scored.join(blocks, "block"), blocks, ["score", "score_b"], 200)
    long = found.unpivot(["rep", "scorer"], ["ap", "auc", "capture"], "measure", "v").groupBy("rep", "measure").pivot("scorer", ["score", "score_b"]).agg(F.max("v"))
    rep, a, b = c("rep").isNotNull(), c("score"), c("score_b")
    point = lambda x: r6(F.max(F.when(~rep, x)))
    bound = lambda x, q: r6(F.percentile(F.when(rep, x), q))
    return long.groupBy("measure").agg(
        point(a).alias("a"), point(b).alias("b"), bound(a, 0.025).alias("a_low"), bound(a, 0.975).alias("a_high"), bound(a - b, 0.025).alias("diff_low"), bound(a - b, 0.975).alias("diff_high"),
        r6(F.avg(F.when(rep, (a > b).cast("double")))).alias("a_better"),
    )


@query("t6_candidate_order", "SELECT zone_id, row_number() OVER (ORDER BY category = 'Very High' DESC, zone_id % 3 = 0 DESC, area DESC, zone_id) AS place FROM {zones} ORDER BY place LIMIT 25")
def _(t: Tables):
    top = t.zones.orderBy(F.desc(c("category") == "Very High"), F.desc(c("zone_id") % 3 == 0), F.desc("area"), "zone_id").limit(25)  # a top-k report
    w = Window.orderBy(F.desc(c("category") == "Very High"), F.desc(c("zone_id") % 3 == 0), F.desc("area"), "zone_id")
    return top.select("zone_id", F.row_number().over(w).alias("place"))


@query("t7_farthest_points")
def _(t: Tables):
    picked = studies.farthest_points(t.lattice_nodes.select(c("node").alias("id"), "lat", "lon"), 5)
    return t.spark.createDataFrame(list(enumerate(picked)), "place long, id long")


@query("u3_corpus_union", "SELECT id, min(src) AS src FROM (SELECT event_id AS id, 1 AS src FROM {events} WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 2 FROM {events} WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 3 FROM {events} WHERE event_id % 5 = 0) x GROUP BY id")
def _(t: Tables):
    part = lambda k, s: t.events.filter(c("event_id") % k == 0).select(c("event_id").alias("id"), F.lit(s).alias("src"))
    return part(2, 1).unionByName(part(3, 2)).unionByName(part(5, 3)).groupBy("id").agg(F.min("src").alias("src"))


@query("w17_match_passes", """WITH m AS (SELECT *, sum(CASE WHEN s BETWEEN -80 AND 30 THEN 0 ELSE 1 END) OVER (PARTITION BY trace ORDER BY t) AS run FROM (SELECT trace, t, ((t * 3 + trace) % 160) - 110 + 0e0 AS s FROM {traces}) q),
    r AS (SELECT trace, run, arg_min(s, t) AS s0, arg_max(s, t) AS s1, min(t) AS t0, max(t) AS t1 FROM m WHERE s BETWEEN -80 AND 30 GROUP BY trace, run) SELECT trace, t0, t1 FROM r WHERE s0 <= -60 AND s1 >= 10""")
def _(t: Tables):
    rows = t.traces.select("trace", "t", (((c("t") * 3 + c("trace")) % 160) - 110).cast("double").alias("s"))
    return studies.corridor_passes(rows, 80.0, 30.0)


@query("x3_match_mined", """WITH m AS (SELECT id AS mined_id, node, hazard_class, row_number() OVER (PARTITION BY node, hazard_class ORDER BY id) AS n FROM {obs} WHERE id % 3 > 0), g AS (SELECT id AS gold_id, node, hazard_class, row_number() OVER (PARTITION BY node, hazard_class ORDER BY id) AS n FROM {obs} WHERE id % 4 > 0)
    SELECT coalesce(m.hazard_class, g.hazard_class) AS hazard_class, count(*) FILTER (WHERE mined_id IS NOT NULL AND gold_id IS NOT NULL) AS tp, round(count(*) FILTER (WHERE mined_id IS NOT NULL AND gold_id IS NOT NULL) / count(mined_id), 6) AS precision, round(count(*) FILTER (WHERE mined_id IS NOT NULL AND gold_id IS NOT NULL) / count(gold_id), 6) AS recall
    FROM m FULL JOIN g ON m.node = g.node AND m.hazard_class = g.hazard_class AND m.n = g.n GROUP BY 1""")
def _(t: Tables):
    side = lambda k, name: t.obs.filter(c("id") % k > 0).select(c("id").alias(name), "node", "hazard_class")
    pairs = studies.match_to_gold(side(3, "mined_id"), side(4, "gold_id"), ["node", "hazard_class"])
    rows = pairs.select("hazard_class", c("gold_id").isNotNull().alias("in_gold"), c("mined_id").isNotNull().alias("in_mined"))
    return studies.mined_scores(rows, "hazard_class").select("hazard_class", "tp", r6(c("precision")).alias("precision"), r6(c("recall")).alias("recall"))


@query("x5_export_reviewed", "SELECT node, CASE WHEN polarity = 1 THEN hazard_class ELSE 'corrected' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY received_at DESC, id DESC) AS r FROM {obs}) x WHERE r = 1 AND source_class <> 'crowd'")
def _(t: Tables):
    latest = textchecks.latest_decision(t.obs, ["node"], [F.desc("received_at"), F.desc("id")])
    return latest.filter("source_class <> 'crowd'").select("node", F.coalesce(F.when(c("polarity") == 1, c("hazard_class")), F.lit("corrected")).alias("label"))


@query("x10_choose_geocode", "SELECT p_name AS name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS r FROM {part} WHERE p_size < 40) x WHERE r = 1")
def _(t: Tables):
    from hazardspark.operators.events import first_by

    tier = F.when(c("p_type") == "ECONOMY", 0).otherwise(1)
    return first_by(t.part.filter("p_size < 40"), ["p_name"], [tier, F.desc("p_retailprice"), "p_partkey"]).select(c("p_name").alias("name"), "p_partkey")
