"""Models, calibration, configurations and certificates in full, as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazardspark.operators import beliefs, events, models, routes, scoring, studies, terrain
from hazardspark.plans.q_belief import _CONFIG, _KAPPA, AT
from hazardspark.plans.q_whole import catalogue
from hazardspark.plans.registry import Tables, query
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)
_AT = f"TIMESTAMP '{AT}'"
_WEIGHT = "least(1e0, greatest(0e0, ln(alpha / (1 - alpha)) / ln(0.97e0 / 0.03e0)))"


@query("m15_gbt_grid")
def _(t: Tables):
    held = F.dense_rank().over(Window.orderBy("block")) % 3 == 0
    blocks = t.scored.select("block").distinct().select("block", held.alias("held"))  # a row for each source
    rows = t.scored.join(F.broadcast(blocks), "block").withColumn("part", F.when(c("held"), "test").when(c("id") % 4 == 0, "val").otherwise("train"))
    return models.train_gbt_grid(rows, ["score", "score_b"], [(2, 4), (3, 4)], written).select("depth", "rounds", *[r6(c(x)).alias(x) for x in ("val_ap", "ap", "auc", "alert_recall")])


@query("m18_isotonic_out_of_fold")
def _(t: Tables):
    return models.isotonic_out_of_fold(t.scored.withColumn("fold", c("id") % 4), 4).select("id", r6(c("calibrated")).alias("calibrated"))


@query("m13_logistic_leg")
def _(t: Tables):
    groups = sorted(r[0] for r in t.scored.select("grp").distinct().collect())  # languages
    return models.logistic_out_of_group(t.scored, groups, ["score", "score_b"]).select("id", r6(c("p")).alias("p"))


@query("m29_transfer_eval")
def _(t: Tables):
    out = models.transfer_eval(t.scored, c("id") % 5 == 0, ["score", "score_b"], 50, written)
    return out.select("single", *[r6(c(x)).alias(x) for x in ("model_ap", "single_ap", "gain", "low", "high")])


#: Name, evidence (none: no hazards at all), threshold that closes an edge, weight of risk.
CONFIGS = [("C0", "none", None, 0.0), ("C1", "beta", 0.5, 0.0), ("Chyb", "beta", 0.5, 5.0), ("C2", "shared", None, 0.3), ("C3", "beta", None, 0.3), ("C3_l5", "beta", None, 5.0), ("C3_l20", "beta", None, 20.0), ("C4", "ttl", None, 0.3), ("Cinf", "hindsight", None, 0.3)]
SHARED_TAU_S, TTL_S = 7300.0, 6 * 3600.0

_VARIANTS = f"""vr AS (SELECT o.edge_id, v, sum(polarity * {_KAPPA} * {_WEIGHT} * CASE v WHEN 'shared' THEN exp(-age / {SHARED_TAU_S}e0) WHEN 'ttl' THEN 1e0 ELSE exp(-greatest(age, 0) / h.tau) END) AS s
      FROM (SELECT *, EPOCH({_AT}) - EPOCH(observed_at) AS age FROM {{obs_edge}}) o JOIN {{hazards}} h ON h.hazard_class = o.hazard_class JOIN {{sources}} s ON s.source_class = o.source_class CROSS JOIN (VALUES ('beta'), ('shared'), ('ttl'), ('hindsight')) AS k(v)
      WHERE v = 'hindsight' OR (age >= 0 AND (v <> 'ttl' OR age <= {TTL_S})) GROUP BY o.edge_id, v)"""


@query("g7_config_costs", f"""WITH {_CONFIG}, {_VARIANTS.replace("7300.0e0", "7300e0")}, cf AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{v}', {'NULL' if b is None else b}, {lam})" for n, v, b, lam in CONFIGS)}) AS x(cfg, v, block, lam)),
    p AS (SELECT e.edge_id, e.free_flow_seconds AS f, cf.*, g.hazard_class, h.severity, CASE WHEN g.edge_id IS NULL OR cf.v = 'none' THEN NULL ELSE (2 * g.prior_p + 2 * greatest(coalesce(s, 0), 0)) / (2 + 2 * abs(coalesce(s, 0))) END AS p
      FROM {{lattice_edges}} e CROSS JOIN cf LEFT JOIN cfg g ON g.edge_id = e.edge_id LEFT JOIN {{hazards}} h ON h.hazard_class = g.hazard_class LEFT JOIN vr ON vr.edge_id = e.edge_id AND vr.v = cf.v)
    SELECT cfg, count(*) AS edges, count(*) FILTER (WHERE p > block) AS blocked, round(sum(CASE WHEN p > block THEN 0 ELSE f * (1 + coalesce(lam * p * severity, 0)) END), 4) AS seconds FROM p GROUP BY cfg""")
def _(t: Tables):
    spark = t.spark
    variants = spark.createDataFrame([("beta",), ("shared",), ("ttl",), ("hindsight",)], "variant string")
    configs = spark.createDataFrame(CONFIGS, "cfg string, variant string, block double, lam double")
    priced = studies.config_costs(t.lattice_edges, beliefs.hazard_config(t.obs_edge, t.edge_prior, t.hazards), t.obs_edge, t.hazards, t.sources, AT, variants, configs, SHARED_TAU_S, TTL_S)
    return priced.groupBy("cfg").agg(F.count("*").alias("edges"), F.count_if("blocked").alias("blocked"), F.round(F.sum(F.coalesce("cost_s", F.lit(0.0))), 4).alias("seconds"))


_AGES = [0, 1, 6, 24, 72, 168]
_CAL = f"""kc AS (SELECT * FROM {{obs_edge}} WHERE source_class <> 'official_feed'), cn AS (SELECT edge_id, k.hazard_class, count(*) AS n FROM kc k GROUP BY 1, 2),
    dm AS (SELECT edge_id, hazard_class FROM (SELECT cn.*, row_number() OVER (PARTITION BY edge_id ORDER BY n DESC, h.severity DESC, cn.hazard_class) AS r FROM cn JOIN {{hazards}} h ON h.hazard_class = cn.hazard_class) q WHERE r = 1),
    lb AS (SELECT edge_id, max(CASE WHEN source_class = 'official_feed' THEN 1 ELSE 0 END) AS y FROM {{obs_edge}} GROUP BY edge_id),
    nt AS (SELECT kc.edge_id, dm.hazard_class, h.tau, sum(polarity * {_KAPPA} * {_WEIGHT}) AS s, sum(CASE WHEN polarity > 0 THEN {_KAPPA} * alpha ELSE 0 END) AS r, sum(CASE WHEN polarity <= 0 THEN {_KAPPA} * alpha ELSE 0 END) AS q
      FROM kc JOIN dm ON dm.edge_id = kc.edge_id AND dm.hazard_class = kc.hazard_class JOIN {{hazards}} h ON h.hazard_class = kc.hazard_class JOIN {{sources}} s ON s.source_class = kc.source_class GROUP BY 1, 2, 3),
    ag AS (SELECT unnest({_AGES}) AS age_h), bs AS (SELECT nt.*, age_h, p.prior_p, y FROM nt CROSS JOIN ag JOIN {{edge_prior}} p ON p.edge_id = nt.edge_id JOIN lb ON lb.edge_id = nt.edge_id),
    sc AS (SELECT edge_id, hazard_class, age_h, y, sr, CASE sr WHEN 'prior' THEN prior_p WHEN 'reputation' THEN (r * pow(0.9e0, age_h) + 1) / ((r + q) * pow(0.9e0, age_h) + 2)
      ELSE (2 * prior_p + 2 * greatest(s * f, 0)) / (2 + 2 * abs(s * f)) END AS p FROM (SELECT *, CASE sr WHEN 'shared' THEN exp(-age_h * 3600e0 / 7300e0) WHEN 'model' THEN exp(-age_h * 3600e0 / tau) WHEN 'ttl' THEN CASE WHEN age_h <= 6 THEN 1e0 ELSE 0e0 END END AS f FROM bs CROSS JOIN (VALUES ('prior'), ('shared'), ('model'), ('ttl'), ('reputation')) AS v(sr)) z)"""


@query("m7_calibration_study", f"""WITH {_CAL}, k AS (SELECT *, row_number() OVER (PARTITION BY age_h, sr ORDER BY p, edge_id) AS rn, rank() OVER (PARTITION BY age_h, sr ORDER BY p) + (count(*) OVER (PARTITION BY age_h, sr, p) - 1) / 2 AS mr, count(*) OVER (PARTITION BY age_h, sr) AS n FROM (SELECT edge_id, age_h, sr, y, round(p, 9) AS p FROM sc) w),
    e AS (SELECT age_h, sr, sum(m / n * abs(mp - my)) AS ece FROM (SELECT age_h, sr, (rn - 1) // greatest(1, n // 10) AS b, count(*) AS m, avg(p) AS mp, avg(y) AS my, max(n) AS n FROM k GROUP BY 1, 2, 3) g GROUP BY 1, 2)
    SELECT k.age_h, k.sr AS scorer, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(any_value(e.ece), 6) AS ece, round((sum(CASE WHEN y = 1 THEN mr ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc FROM k JOIN e ON e.age_h = k.age_h AND e.sr = k.sr GROUP BY 1, 2""")
def _(t: Tables):
    rows = studies.calibration_scores(t.obs_edge, t.edge_prior, t.hazards, t.sources, _AGES, SHARED_TAU_S, TTL_S).withColumn("p", F.round("p", 9))
    rows = written(rows, "calibration")
    by = ["age_h", "scorer"]
    brier = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.pow(c("p") - c("y"), 2)).alias("brier"))
    out = brier.join(scoring.grouped_ece(rows, by, "p", "y", "edge_id"), by).join(scoring.auroc(rows, "p", "y", by), by)
    return out.select("age_h", "scorer", "n", *[r6(c(x)).alias(x) for x in ("brier", "ece", "auroc")])


@query("m7_calibration_strata", f"""WITH {_CAL} SELECT age_h, sr AS scorer, hazard_class, count(*) AS n, round(avg(pow(round(p, 9) - y, 2)), 6) AS brier, round(avg(y), 6) AS rate FROM sc GROUP BY 1, 2, 3""")
def _(t: Tables):
    rows = studies.calibration_scores(t.obs_edge, t.edge_prior, t.hazards, t.sources, _AGES, SHARED_TAU_S, TTL_S).withColumn("p", F.round("p", 9))
    return rows.groupBy("age_h", "scorer", "hazard_class").agg(F.count("*").alias("n"), r6(F.avg(F.pow(c("p") - c("y"), 2))).alias("brier"), r6(F.avg("y")).alias("rate"))


@query("m10_conformal_certificates", """WITH o AS (SELECT DISTINCT edge_id FROM {obs_edge} WHERE source_class = 'official_feed'), ps AS (SELECT prior_p, row_number() OVER (ORDER BY prior_p, p.edge_id) AS r, count(*) OVER () AS n FROM {edge_prior} p JOIN o ON o.edge_id = p.edge_id WHERE p.edge_id % 2 = 0),
    th AS (SELECT max(CASE WHEN r = CAST(floor(0.1e0 * (n + 1)) AS BIGINT) THEN prior_p END) AS tau FROM ps)
    SELECT r.route, round(min(CASE WHEN o.edge_id IS NOT NULL THEN prior_p END), 6) AS lowest, min(CASE WHEN o.edge_id IS NOT NULL THEN prior_p END) >= max(coalesce(tau, -1e0)) AS covered, round(sum(CASE WHEN prior_p >= coalesce(tau, -1e0) THEN free_flow_seconds ELSE 0 END) / sum(free_flow_seconds), 6) AS flagged_share
    FROM {routes} r JOIN {lattice_edges} e ON e.edge_id = r.edge_id JOIN {edge_prior} p ON p.edge_id = r.edge_id CROSS JOIN th LEFT JOIN o ON o.edge_id = r.edge_id GROUP BY r.route""")
def _(t: Tables):
    positive = t.obs_edge.filter("source_class = 'official_feed'").select("edge_id").distinct().withColumn("positive", F.lit(True))
    scores = t.edge_prior.withColumnRenamed("prior_p", "score").join(positive, "edge_id", "left")
    known = scores.filter("edge_id % 2 = 0").select("score", F.coalesce(c("positive").cast("int"), F.lit(0)).alias("y"), F.lit("all").alias("grp"), c("edge_id").alias("id"))
    tau = (scoring.conformal_thresholds(known, 0.1).first() or {"tau": None})["tau"]  # one group
    lines = t.routes.join(t.lattice_edges.select("edge_id", c("free_flow_seconds").alias("seconds")), "edge_id")
    out = studies.route_certificates(lines, scores, -1.0 if tau is None else tau)
    return out.select("route", r6(c("lowest")).alias("lowest"), "covered", r6(c("flagged_share")).alias("flagged_share"))


@query("m22_slope", """SELECT a.row, a.col, round(degrees(atan(sqrt(pow((e.elev - w.elev) / 2 / 100e0, 2) + pow((s.elev - n.elev) / 2 / 100e0, 2)))), 6) + 0e0 AS slope FROM {grid} a LEFT JOIN {grid} w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN {grid} e ON e.row = a.row AND e.col = a.col + 1
    LEFT JOIN {grid} n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN {grid} s ON s.row = a.row + 1 AND s.col = a.col""")
def _(t: Tables):
    return terrain.slope(t.grid, 100.0).select("row", "col", (r6(c("slope")) + 0.0).alias("slope"))


@query("m22_nearest_masked", """WITH m AS (SELECT * FROM {grid} WHERE elev > 90), d AS (SELECT a.row, a.col, m.elev AS value, sqrt(pow(a.row - m.row, 2) + pow(a.col - m.col, 2)) AS cells, row_number() OVER (PARTITION BY a.row, a.col ORDER BY pow(a.row - m.row, 2) + pow(a.col - m.col, 2), m.row, m.col) AS r FROM {grid} a JOIN m ON abs(a.row - m.row) <= 4 AND abs(a.col - m.col) <= 4 WHERE pow(a.row - m.row, 2) + pow(a.col - m.col, 2) <= 16)
    SELECT g.row, g.col, round(d.cells, 6) AS cells, d.value FROM {grid} g LEFT JOIN d ON d.row = g.row AND d.col = g.col AND d.r = 1""")
def _(t: Tables):
    return terrain.nearest_masked(t.grid, c("elev") > 90, 4).select("row", "col", r6(c("cells")).alias("cells"), "value")


_SIDES = """sd AS (SELECT region_id, lat AS y1, lon AS x1, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2 FROM {regions} WINDOW w AS (PARTITION BY region_id, ring ORDER BY seq))"""
_POINT = ("12.75e0 + CAST(floor(d * 47 / 40e0) AS BIGINT) * 0.0125e0 + d % 4 * 0.009e0", "79.95e0 + d * 47 % 40 * 0.01e0 + d % 3 * 0.008e0")


@query("j8_link_polygons", f"""WITH {_SIDES}, dp AS (SELECT d, {_POINT[0]} AS lat, {_POINT[1]} AS lon FROM (SELECT unnest(range(25)) AS d) q),
    ins AS (SELECT dp.d, sd.region_id FROM dp JOIN sd ON (sd.y1 > dp.lat) <> (sd.y2 > dp.lat) AND dp.lon < (sd.x2 - sd.x1) * (dp.lat - sd.y1) / (sd.y2 - sd.y1) + sd.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
    SELECT a.event_id AS a_id, b.event_id AS b_id, a.district FROM {{catalogue_a}} a JOIN ins ON ins.d = a.district JOIN {{catalogue_b}} b ON b.district = ins.region_id AND a.first_day - 3 <= b.last_day + 3 AND b.first_day - 3 <= a.last_day + 3""")
def _(t: Tables):
    d = c("n_nationkey")
    points = t.nation.select(d.alias("district"), (12.75 + F.floor(d * 47 / 40) * 0.0125 + d % 4 * 0.009).alias("lat"), (79.95 + d * 47 % 40 * 0.01 + d % 3 * 0.008).alias("lon"))
    areas = catalogue(t, 1).withColumnRenamed("district", "region_id")
    return events.link_by_polygon(catalogue(t, 0), areas, points, t.regions)


@query("a21_route_report", f"""WITH {_CONFIG}, x AS (SELECT r.route, r.edge_id, CASE WHEN r.edge_id % 6 = 0 THEN e.to_node END AS signal, CASE WHEN g.n IS NULL OR g.n < 2 THEN e.street_name END AS gap, CASE WHEN g.edge_id IS NULL THEN 3 WHEN g.n < 1 THEN 0 WHEN g.n < 3 THEN 1 ELSE 2 END AS band FROM {{routes}} r JOIN {{lattice_edges}} e ON e.edge_id = r.edge_id LEFT JOIN cfg g ON g.edge_id = r.edge_id)
    SELECT route, count(DISTINCT signal) AS signals, count(DISTINCT gap) AS gaps, ['low', 'moderate', 'high', 'none'][min(band) + 1] AS worst_band FROM x GROUP BY route""")
def _(t: Tables):
    cfg = beliefs.hazard_config(t.obs_edge, t.edge_prior, t.hazards).select("edge_id", "n")
    rows = t.routes.join(t.lattice_edges, "edge_id").join(cfg, "edge_id", "left")
    band = F.when(c("n").isNull(), "none").when(c("n") < 1, "low").when(c("n") < 3, "moderate").otherwise("high")
    rows = rows.select("route", F.when(c("edge_id") % 6 == 0, c("to_node")).alias("signal"), F.when(c("n").isNull() | (c("n") < 2), c("street_name")).alias("gap"), band.alias("band"))
    return routes.route_report(rows, ["low", "moderate", "high", "none"])


@query("t1_event_recall", """WITH e AS (SELECT district, first_day, last_day FROM {catalogue_a}), al AS (SELECT DISTINCT district, day FROM {panel} WHERE mm >= 110) SELECT count(*) AS events, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM al WHERE al.district = e.district AND al.day BETWEEN e.first_day - 1 AND e.last_day)) AS found FROM e""")
def _(t: Tables):
    alerts = t.panel.filter("mm >= 110").select("district", "day")
    return scoring.event_recall(alerts, catalogue(t, 0), "district")
