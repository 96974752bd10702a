"""Scores, resampling, samples, terrain and signals as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazardspark.operators import routes, scoring, signals, terrain
from hazardspark.plans.registry import Tables, query
from hazardspark.plans.views import drawn
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)

_BINS = "bn AS (SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n, sum(score) AS sp, sum(y) AS sy, sum(pow(score - y, 2)) AS se FROM {scored} GROUP BY 1), tt AS (SELECT sum(n) AS n, sum(sy) AS y FROM bn)"


@query("m1_brier_murphy", f"""WITH {_BINS} SELECT round(sum(se) / max(tt.n), 6) AS brier, round(sum(bn.n * pow((sp - sy) / bn.n, 2)) / max(tt.n), 6) AS reliability, round(sum(bn.n * pow(sy / bn.n - tt.y / tt.n, 2)) / max(tt.n), 6) AS resolution, round(max(tt.y / tt.n * (1 - tt.y / tt.n)), 6) AS uncertainty FROM bn CROSS JOIN tt""")
def _(t: Tables):
    return scoring.brier_murphy(t.scored).select(*[r6(c(x)).alias(x) for x in ("brier", "reliability", "resolution", "uncertainty")])


@query("m2_adaptive_ece", """WITH k AS (SELECT score, y, row_number() OVER (ORDER BY score, id) AS r, count(*) OVER () AS n FROM {scored}), b AS (SELECT (r - 1) // greatest(1, n // 10) AS b, count(*) AS m, avg(score) AS mp, avg(y) AS my, max(n) AS n FROM k GROUP BY 1) SELECT round(sum(m / n * abs(mp - my)), 6) AS ece FROM b""")
def _(t: Tables):
    return scoring.adaptive_ece(t.scored, t.scored.count()).select(r6(c("ece")).alias("ece"))


@query("m3_log_loss", """WITH b AS (SELECT avg(y) AS base FROM {scored}) SELECT round(avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, score))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, score))))), 6) AS loss, round(1 - avg(pow(score - y, 2)) / avg(pow(base - y, 2)), 6) AS skill FROM {scored} CROSS JOIN b""")
def _(t: Tables):
    base = t.scored.agg(F.avg("y").alias("base"))  # one row
    skill = 1 - F.avg(F.pow(c("score") - c("y"), 2)) / F.avg(F.pow(c("base") - c("y"), 2))
    return t.scored.crossJoin(F.broadcast(base)).agg(r6(scoring.log_loss(c("score"), c("y"))).alias("loss"), r6(skill).alias("skill"))


@query("m4_auroc", """WITH k AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2 AS r FROM {scored})
    SELECT grp, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc FROM k GROUP BY grp""")
def _(t: Tables):
    return scoring.auroc(t.scored, by=["grp"]).select("grp", r6(c("auroc")).alias("auroc"))


_AP = """gr AS (SELECT score, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM {scored} GROUP BY score), cu AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM gr)"""


@query("m5_weighted_ap_auc", f"WITH {_AP} SELECT round(sum(tp * ctp / (ctp + cfp)) / max(p), 6) AS ap, round(sum(tp * (n - cfp + fp / 2)) / (max(p) * max(n)), 6) AS auc FROM cu")
def _(t: Tables):
    return scoring.weighted_ap_auc(t.scored).select(r6(c("ap")).alias("ap"), r6(c("auc")).alias("auc"))


@query("m6_reliability_table", "SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(sum(w * score) / sum(w), 6) AS mean_p, round(sum(w * y) / sum(w), 6) AS rate FROM {scored} GROUP BY 1")
def _(t: Tables):
    return scoring.reliability_table(t.scored, w="w").select("bin", "n", r6(c("mean_p")).alias("mean_p"), r6(c("rate")).alias("rate"))


_TAU = "th AS (SELECT grp, n, (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score, id) AS r FROM {scored} s WHERE s.y = 1 AND s.grp = g.grp) q WHERE r = CAST(floor(0.1e0 * (g.n + 1)) AS BIGINT)) AS tau FROM (SELECT grp, count(*) AS n FROM {scored} WHERE y = 1 GROUP BY grp) g)"


@query("m8_conformal_thresholds", f"WITH {_TAU} SELECT grp, round(tau, 6) AS tau, n FROM th")
def _(t: Tables):
    return scoring.conformal_thresholds(t.scored, 0.1).select("grp", r6(c("tau")).alias("tau"), "n")


@query("m8_conformal_rates", f"WITH {_TAU} SELECT s.grp, round(avg(CASE WHEN y = 1 THEN CASE WHEN tau IS NULL OR score >= tau THEN 1e0 ELSE 0e0 END END), 6) AS coverage, round(avg(CASE WHEN y = 0 THEN CASE WHEN tau IS NULL OR score >= tau THEN 1e0 ELSE 0e0 END END), 6) AS false_flag, count(*) AS n FROM {{scored}} s LEFT JOIN th ON th.grp = s.grp GROUP BY s.grp")
def _(t: Tables):
    rows = scoring.conformal_rates(t.scored, scoring.conformal_thresholds(t.scored, 0.1))
    return rows.select("grp", r6(c("coverage")).alias("coverage"), r6(c("false_flag")).alias("false_flag"), "n")


@query("m9_conformal_splits", """WITH sp AS (SELECT s.*, k.split, (s.id * 7919 + k.split * 104729 + s.id * k.split) % 101 < 50 AS cal FROM {scored} s CROSS JOIN (SELECT unnest(range(20)) AS split) k),
    n AS (SELECT split, grp, CAST(floor(0.1e0 * (count(*) + 1)) AS BIGINT) AS k FROM sp WHERE cal AND y = 1 GROUP BY split, grp),
    r AS (SELECT split, grp, score, row_number() OVER (PARTITION BY split, grp ORDER BY score, id) AS r FROM sp WHERE cal AND y = 1),
    th AS (SELECT n.split, n.grp, r.score AS tau FROM n LEFT JOIN r ON r.split = n.split AND r.grp = n.grp AND r.r = n.k)
    SELECT sp.split, round(avg(CASE WHEN th.tau IS NULL OR score >= th.tau THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM sp LEFT JOIN th ON th.split = sp.split AND th.grp = sp.grp WHERE NOT cal AND y = 1 GROUP BY sp.split""")
def _(t: Tables):
    half = (c("id") * 7919 + c("split") * 104729 + c("id") * c("split")) % 101 < 50
    rows = t.scored.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("cal", half).withColumn("key", F.concat_ws("|", "split", "grp"))
    tau = scoring.conformal_thresholds(rows.filter("cal"), 0.1, group="key").select("key", "tau")
    test = rows.filter("NOT cal AND y = 1").join(tau, "key", "left")
    return test.groupBy("split").agg(r6(F.avg((c("tau").isNull() | (c("score") >= c("tau"))).cast("double"))).alias("coverage"))


_BLOCKS = f"bl AS (SELECT block, dense_rank() OVER (ORDER BY block) - 1 AS b, sum(pow(score - y, 2)) AS num, sum(pow(score_b - y, 2)) AS num_b, CAST(count(*) AS DOUBLE) AS den FROM {{scored}} GROUP BY block), {drawn(200)}"


def _blocks(t: Tables, num):
    sums = t.scored.groupBy("block").agg(F.sum(num).alias("num"), F.count("*").cast("double").alias("den"))
    return sums.withColumn("b", (F.dense_rank().over(Window.orderBy("block")) - 1).cast("long"))  # a row for each block


@query("m11_block_bootstrap", f"WITH {_BLOCKS}, v AS (SELECT rep, sum(times * num) / sum(times * den) AS v FROM dr JOIN bl ON bl.b = dr.b GROUP BY rep) SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.975), 6) AS hi, count(*) AS reps FROM v")
def _(t: Tables):
    v = scoring.block_bootstrap(_blocks(t, F.pow(c("score") - c("y"), 2)), 200)
    return v.agg(*[r6(F.percentile("value", q)).alias(a) for q, a in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))], F.count("*").alias("reps"))


@query("m12_paired_bootstrap", f"WITH {_BLOCKS}, v AS (SELECT rep, sum(times * (num - num_b)) / sum(times * den) AS v FROM dr JOIN bl ON bl.b = dr.b GROUP BY rep) SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v")
def _(t: Tables):
    v = scoring.block_bootstrap(_blocks(t, F.pow(c("score") - c("y"), 2) - F.pow(c("score_b") - c("y"), 2)), 200)
    return v.agg(*[r6(F.percentile("value", q)).alias(a) for q, a in ((0.025, "lo"), (0.975, "hi"))])


@query("m13_leave_one_group_out", """SELECT a.grp, a.block, round((SELECT avg(y) FROM {scored} s WHERE s.grp <> a.grp), 6) AS base, round((SELECT avg(y) FROM {scored} s WHERE s.grp <> a.grp AND s.block = a.block), 6) AS history, count(*) AS n FROM {scored} a GROUP BY a.grp, a.block""")
def _(t: Tables):
    return scoring.leave_one_group_out(t.scored).select("grp", "block", r6(c("base")).alias("base"), r6(c("history")).alias("history"), "n")


@query("m14_spatial_folds", "WITH b AS (SELECT node, CAST(floor(lat / 0.05e0) AS BIGINT) AS a, CAST(floor(lon / 0.05e0) AS BIGINT) AS o FROM {lattice_nodes}), d AS (SELECT *, dense_rank() OVER (ORDER BY a, o) AS block FROM b) SELECT node, block, (block * 7919 + 104729) % 5 AS fold FROM d")
def _(t: Tables):
    at = t.lattice_nodes.select("node", F.floor(c("lat") / 0.05).alias("a"), F.floor(c("lon") / 0.05).alias("o"))
    blocks = at.select("a", "o").distinct().withColumn("block", F.row_number().over(Window.orderBy("a", "o")).cast("long"))  # a row for each block
    return at.join(blocks, ["a", "o"]).select("node", "block", ((c("block") * 7919 + 104729) % 5).alias("fold"))


@query("m16_balanced_weights", "SELECT id, round(0.5e0 * count(*) OVER (PARTITION BY block) / count(*) OVER (PARTITION BY block, y), 6) AS weight FROM {scored}")
def _(t: Tables):
    n = t.scored.groupBy("block", "y").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("block")))
    return t.scored.join(n, ["block", "y"]).select("id", r6(0.5 * c("total") / c("n")).alias("weight"))


@query("m17_best_single_feature", """WITH f AS (SELECT 'score' AS f, y, score AS v, w FROM {scored} UNION ALL SELECT 'score_b', y, score_b, w FROM {scored}), gr AS (SELECT f, v, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM f GROUP BY f, v),
    cu AS (SELECT *, sum(tp) OVER (PARTITION BY f ORDER BY v DESC) AS ctp, sum(fp) OVER (PARTITION BY f ORDER BY v DESC) AS cfp, sum(tp) OVER (PARTITION BY f) AS p FROM gr), ap AS (SELECT f, sum(tp * ctp / (ctp + cfp)) / max(p) AS ap FROM cu GROUP BY f)
    SELECT arg_max(f, (ap, f)) AS feature, round(max(ap), 6) AS ap FROM ap""")
def _(t: Tables):
    long = t.scored.select("y", "w", "score", "score_b").unpivot(["y", "w"], ["score", "score_b"], "feature", "v")
    ap = scoring.weighted_ap_auc(long, "v", by=["feature"])
    return ap.agg(F.max_by("feature", F.struct("ap", "feature")).alias("feature"), r6(F.max("ap")).alias("ap"))


@query("m19_shuffled_labels", """WITH a AS (SELECT id, block, row_number() OVER (PARTITION BY block ORDER BY id) AS r FROM {scored}), b AS (SELECT y, block, row_number() OVER (PARTITION BY block ORDER BY (id * 7919) % 10007, id) AS r FROM {scored}) SELECT a.id, b.y FROM a JOIN b ON a.block = b.block AND a.r = b.r""")
def _(t: Tables):
    number = lambda *o: F.row_number().over(Window.partitionBy("block").orderBy(*o)).alias("r")
    a = t.scored.select("id", "block", number("id"))
    return a.join(t.scored.select("y", "block", number((c("id") * 7919) % 10007, "id")), ["block", "r"]).select("id", "y")


@query("m20_scorecard", "SELECT p_partkey, round((m - b) / (1 - b), 6) AS skill, CASE WHEN (m - b) / (1 - b) < 0 THEN 'no evidence of skill (negative)' WHEN (m - b) / (1 - b) >= 0.3e0 THEN 'useful' WHEN (m - b) / (1 - b) >= 0.1e0 THEN 'modest' ELSE 'marginal' END AS verdict FROM (SELECT p_partkey, (p_partkey % 100) / 100e0 AS m, (p_partkey % 77) / 99e0 AS b FROM {part}) x")
def _(t: Tables):
    rows = t.part.select("p_partkey", ((c("p_partkey") % 100) / 100.0).alias("m"), ((c("p_partkey") % 77) / 99.0).alias("b"))
    return scoring.scorecard(rows, "m", "b").select("p_partkey", r6(c("skill")).alias("skill"), "verdict")


@query("m21_percentile_of_points", "SELECT row, col, round(cume_dist() OVER (ORDER BY elev), 6) AS pct FROM {grid}")
def _(t: Tables):
    n = t.grid.groupBy("elev").agg(F.count("*").alias("n"))
    at = scoring.running(n, "elev", ["n"]).crossJoin(F.broadcast(t.grid.agg(F.count("*").alias("total")))).select("elev", (c("c_n") / c("total")).alias("pct"))
    return t.grid.join(at, "elev").select("row", "col", r6(c("pct")).alias("pct"))


@query("a19_percentiles", """WITH k AS (SELECT block, score, row_number() OVER (PARTITION BY block ORDER BY score, id) AS r, count(*) OVER (PARTITION BY block) AS n FROM {scored})
    SELECT block, round(quantile_cont(score, 0.9), 6) AS linear, round(max(CASE WHEN r = CAST(floor(0.9e0 * n) AS BIGINT) + 1 THEN score END), 6) AS by_index FROM k GROUP BY block""")
def _(t: Tables):
    n = t.scored.groupBy("block").agg(F.count("*").alias("n"))
    rows = scoring.ranked(t.scored, "score", "id", ["block"]).join(n, "block")
    pick = F.max(F.when(c("rank") == F.floor(0.9 * c("n")) + 1, c("score")))
    return rows.groupBy("block").agg(r6(F.percentile("score", 0.9)).alias("linear"), r6(pick).alias("by_index"))


@query("t1_top_alerts", "WITH k AS (SELECT *, row_number() OVER (ORDER BY score, id) AS r, count(*) OVER () AS n FROM {scored}) SELECT id FROM {scored} WHERE score >= (SELECT score FROM k WHERE r = CAST(floor(n * 0.98e0) AS BIGINT) + 1)")
def _(t: Tables):
    return scoring.top_alerts(t.scored, t.scored.count()).select("id")


@query("t4_allocate_by_rank", "WITH a AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM {scored}), b AS (SELECT score_b, row_number() OVER (ORDER BY score_b, id) AS r FROM {scored}) SELECT a.id, round(b.score_b, 6) AS allocated FROM a JOIN b ON a.r = b.r")
def _(t: Tables):
    return scoring.allocate_by_rank(t.scored, "score_b", "score").select("id", r6(c("allocated")).alias("allocated"))


@query("t5_stratified_sample", "WITH k AS (SELECT id, row_number() OVER (PARTITION BY block, y ORDER BY (id * 7919) % 100003, id) AS r, count(*) OVER (PARTITION BY block, y) AS n FROM {scored}) SELECT id, round(n / least(n, 5), 6) AS weight FROM k WHERE r <= 5")
def _(t: Tables):
    key = F.struct((c("id") * 7919) % 100003, c("id"))
    return scoring.stratified_sample(t.scored, ["block", "y"], 5, key).select("id", r6(c("weight")).alias("weight"))


@query("w11_link_excess", "SELECT link, step, round(CASE WHEN count(loss) OVER w >= 4 THEN loss - median(loss) OVER w END, 6) AS excess, round(CASE WHEN count(loss) OVER w >= 4 THEN stddev_pop(loss) OVER w END, 6) AS spread FROM {link_loss} WINDOW w AS (PARTITION BY link ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def _(t: Tables):
    return signals.link_excess(t.link_loss, 8).select("link", "step", r6(c("excess")).alias("excess"), r6(c("spread")).alias("spread"))


@query("w12_dry_baseline", """WITH d AS (SELECT link, step, median(loss) OVER (PARTITION BY link ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS b FROM {link_loss} WHERE loss <= 55 AND loss IS NOT NULL)
    SELECT l.link, l.step, round((SELECT arg_max(b, d.step) FROM d WHERE d.link = l.link AND d.step <= l.step), 6) AS base FROM {link_loss} l""")
def _(t: Tables):
    rows = t.link_loss.withColumn("wet", F.coalesce(c("loss") > 55, F.lit(False)))
    return signals.dry_baseline(rows, 10).select("link", "step", r6(c("base")).alias("base"))


@query("w16_slow_runs", "WITH m AS (SELECT link, step, coalesce(loss < 50, false) AS s, sum(CASE WHEN coalesce(loss < 50, false) THEN 0 ELSE 1 END) OVER (PARTITION BY link ORDER BY step) AS run FROM {link_loss}) SELECT link, min(step) AS first, max(step) AS last, count(*) AS n FROM m WHERE s GROUP BY link, run")
def _(t: Tables):
    return signals.slow_runs(t.link_loss, c("loss") < 50, "link", "step").select("link", "first", "last", "n")


@query("m26_cycle_candidates", "WITH cy AS (SELECT 40 + i * 5e0 AS cycle FROM (SELECT unnest(range(29)) AS i) q), e AS (SELECT user_id % 10 AS site, EPOCH(ts) % 86400 AS t FROM {events} WHERE event_type = 'click') SELECT site, cycle, round(sqrt(pow(sum(cos(2 * pi() * t / cycle)), 2) + pow(sum(sin(2 * pi() * t / cycle)), 2)) / count(*), 6) AS resultant, count(*) AS n FROM e CROSS JOIN cy GROUP BY site, cycle")
def _(t: Tables):
    rows = t.events.filter("event_type = 'click'").select((c("user_id") % 10).alias("site"), (F.unix_timestamp("ts") % 86400).alias("t"))
    return signals.cycle_candidates(rows, "site", "t", 40.0, 180.0, 5.0).select("site", "cycle", r6(c("resultant")).alias("resultant"), "n")


@query("m22_terrain_windows", """SELECT a.row, a.col, round(a.elev - avg(b.elev), 6) + 0e0 AS tpi, round(a.elev - min(b.elev), 6) AS relief FROM {grid} a JOIN {grid} b ON abs(b.row - a.row) <= 2 AND abs(b.col - a.col) <= 2 GROUP BY a.row, a.col, a.elev""")
def _(t: Tables):
    return terrain.local_windows(t.grid, 2).select("row", "col", (r6(c("tpi")) + 0.0).alias("tpi"), r6(c("relief")).alias("relief"))


_FLOW = """nb AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2, (a.elev - b.elev) / CASE WHEN a.row <> b.row AND a.col <> b.col THEN sqrt(2e0) ELSE 1e0 END AS d FROM {grid} a JOIN {grid} b ON abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 AND (b.row <> a.row OR b.col <> a.col)),
    fd AS (SELECT row, col, r2, c2, d FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d DESC, r2, c2) AS k FROM nb WHERE d > 0) q WHERE k = 1)"""


@query("m23_flow_direction", f"WITH {_FLOW} SELECT row, col, r2 AS to_row, c2 AS to_col, round(d, 6) AS drop FROM fd")
def _(t: Tables):
    return terrain.flow_direction(t.grid).select("row", "col", "to_row", "to_col", r6(c("drop")).alias("drop"))


@query("m24_flow_accumulation", f"WITH RECURSIVE {_FLOW}, rc AS (SELECT row AS r0, col AS c0, row, col FROM {{grid}} UNION ALL SELECT rc.r0, rc.c0, fd.r2, fd.c2 FROM rc JOIN fd ON fd.row = rc.row AND fd.col = rc.col) SELECT row, col, count(*) AS n FROM rc GROUP BY row, col")
def _(t: Tables):
    return terrain.flow_accumulation(t.grid, written)


@query("m25_depression_fill")
def _(t: Tables):
    return terrain.depression_fill(t.grid, written)


@query("j19_paired_config", "SELECT a.id, round(a.score - b.score_b, 6) AS diff FROM {scored} a JOIN {scored} b ON a.id = b.id WHERE a.id % 5 <> 0 AND b.id % 7 <> 0")
def _(t: Tables):
    pairs = routes.paired(t.scored.filter("id % 5 <> 0").select("id", "score"), t.scored.filter("id % 7 <> 0").select("id", "score_b"), "id")
    return pairs.select("id", r6(c("score") - c("score_b")).alias("diff"))


@query("a33_exposure_efficiency", "SELECT count(*) AS n, round(median((score - score_b) / x), 6) AS median, round(quantile_cont((score - score_b) / x, 0.95), 6) AS p95 FROM (SELECT *, CAST(id % 11 - 3 AS DOUBLE) AS x FROM {scored}) q WHERE x > 0")
def _(t: Tables):
    pairs = t.scored.select(c("score").alias("risk_a"), c("score_b").alias("risk_b"), F.lit(0.0).alias("s_a"), (c("id") % 11 - 3).cast("double").alias("s_b"))
    return routes.exposure_efficiency(pairs).select("n", r6(c("median")).alias("median"), r6(c("p95")).alias("p95"))


@query("m15_train_gbt")
def _(t: Tables):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = t.scored.withColumn("label", c("y").cast("double"))
    data = VectorAssembler(inputCols=["score", "score_b", "w"], outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=7, weightCol="w").fit(data.filter("id % 4 <> 0"))
    test = model.transform(data.filter("id % 4 = 0")).withColumn("p", vector_to_array("probability")[1])
    return scoring.weighted_ap_auc(test, "p").select(r6(c("ap")).alias("ap"), r6(c("auc")).alias("auc"))


@query("m18_isotonic")
def _(t: Tables):
    from pyspark.ml.regression import IsotonicRegression

    data = t.scored.select("id", "grp", c("y").cast("double").alias("label"), c("score").alias("features"))
    model = IsotonicRegression().fit(data.filter("id % 2 = 0"))
    return model.transform(data.filter("id % 2 = 1")).select("id", r6(c("prediction")).alias("calibrated"))
