"""Beliefs per edge: dominant class, fused evidence, configurations, restrictions and risk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.functions.belief import decay, edge_cost, kernel, logit, reliability_weight, sigmoid
from hazardspark.operators.observations import age_s, live_reports, window_by_clock
from hazardspark.operators.spatial import points_near


def attach_snap(obs: DataFrame, snap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations with their edge, and the count of snaps without an observation."""
    return obs.join(snap, "id"), snap.join(obs.select("id"), "id", "left_anti").agg(F.count("*").alias("orphans"))


def reverse_twins(edges: DataFrame) -> DataFrame:
    """(edge_id, twin_id): the lowest edge of the opposite direction; no loops."""
    back = edges.select(F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"), F.col("edge_id").alias("twin_id"))
    return edges.filter("from_node <> to_node").join(back, ["from_node", "to_node"]).groupBy("edge_id").agg(F.min("twin_id").alias("twin_id"))


def attach_reverse_twins(attached: DataFrame, edges: DataFrame) -> DataFrame:
    """Every report also on the reverse of its edge, once for each (edge, report)."""
    other = attached.join(reverse_twins(edges), "edge_id").withColumn("edge_id", F.col("twin_id")).drop("twin_id")
    return attached.unionByName(other).dropDuplicates(["edge_id", "id"])


def zone_prior(edges: DataFrame, zones: DataFrame, radius_m: float = config.ZONE_RADIUS_M, box: float | None = None) -> DataFrame:
    """(edge_id, prior_p, prior_logodds, n_zones): mean of the zones' probabilities around the edge's middle, weighted 1 - d / radius; the
    lowest category where there is none. zones: lat, lon, p. Zones within the radius are those of `points_near`, in a box if one is given."""
    mid = edges.select("edge_id", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    near = points_near(mid, zones.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "p"), radius_m, box=box)
    near = near.withColumn("w", 1 - F.col("distance_m") / radius_m).filter("w >= 0")
    sums = near.groupBy("edge_id").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("p")).alias("swp"), F.count("*").alias("n_zones"))
    p = F.when(F.col("sw") > 0, F.col("swp") / F.col("sw")).otherwise(config.ZONE_FLOOR)
    out = edges.select("edge_id").join(sums, "edge_id", "left").select("edge_id", p.alias("prior_p"), F.coalesce("n_zones", F.lit(0)).alias("n_zones"))
    return out.withColumn("prior_logodds", logit(F.col("prior_p")))


def dominant_class(attached: DataFrame, hazards: DataFrame) -> DataFrame:
    """(edge_id, hazard_class, n, dropped): most reports, then severity, then name; `dropped` reports are of other classes. Reports are
    combined to one row for each edge and class before any edge's rows meet."""
    counts = attached.groupBy("edge_id", "hazard_class").agg(F.count("*").alias("n")).join(F.broadcast(hazards), "hazard_class")
    order = Window.partitionBy("edge_id").orderBy(F.desc("n"), F.desc("severity"), "hazard_class")
    total = F.sum("n").over(Window.partitionBy("edge_id"))
    return counts.withColumns({"__r": F.row_number().over(order), "dropped": total - F.col("n")}).filter("__r = 1").select("edge_id", "hazard_class", "n", "dropped")


def prior_only_edges(prior: DataFrame, attached: DataFrame, at_least: float = config.PRIOR_ONLY_AT) -> DataFrame:
    return prior.filter(F.col("prior_p") >= at_least).join(attached.select("edge_id").distinct(), "edge_id", "left_anti")


def hazard_config(attached: DataFrame, prior: DataFrame, hazards: DataFrame) -> DataFrame:
    """Edges with reports, with the parameters of their dominant class, and edges that have a high prior only. Joins to the prior, and no
    union of the two kinds of edges: Spark takes a union of sides dealt by edge for dealt by edge itself, and then fails where it reads them
    as two lists of partitions."""
    reported = attached.select("edge_id").distinct().withColumn("__reported", F.lit(True))
    seen = dominant_class(attached, hazards).select("edge_id", "hazard_class", "n")
    rows = prior.join(reported, "edge_id", "left").join(seen, "edge_id", "left").withColumn("observed", F.col("hazard_class").isNotNull())
    only = F.when(F.col("__reported").isNull() & (F.col("prior_p") >= config.PRIOR_ONLY_AT), config.PRIOR_ONLY_CLASS)
    rows = rows.withColumns({"hazard_class": F.coalesce("hazard_class", only), "n": F.coalesce("n", F.lit(0).cast("long"))}).filter("hazard_class IS NOT NULL")
    return rows.select("edge_id", "hazard_class", "prior_p", "n", "observed").join(F.broadcast(hazards), "hazard_class")


def _evidence(attached: DataFrame, hazards: DataFrame, sources: DataFrame, at: str | Column) -> DataFrame:
    rows = window_by_clock(attached, at).join(F.broadcast(hazards), "hazard_class").join(F.broadcast(sources), "source_class")
    return rows.withColumn("kappa", kernel(F.col("distance_m"))).filter("kappa > 0").withColumn("w", F.col("kappa") * decay(age_s(at).cast("double"), F.col("tau")))


def fuse_logodds(attached: DataFrame, prior: DataFrame, hazards: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """(edge_id, logodds, p_mean, n_eff, newest, n): the prior's log-odds moved by signed, decayed reports."""
    rows = _evidence(attached, hazards, sources, at)
    sums = rows.groupBy("edge_id").agg(F.sum(F.col("polarity") * F.col("w") * logit(F.col("alpha"))).alias("shift"), F.sum("w").alias("n_eff"), F.max("observed_at").alias("newest"), F.count("*").alias("n"))
    out = sums.join(prior, "edge_id").withColumn("logodds", logit(F.col("prior_p")) + F.col("shift"))
    return out.select("edge_id", "logodds", sigmoid(F.col("logodds")).alias("p_mean"), "n_eff", "newest", "n")


def fuse_beta(attached: DataFrame, prior: DataFrame, hazards: DataFrame, sources: DataFrame, at: str, strength: float = config.PRIOR_STRENGTH, scale: float = config.EVIDENCE_SCALE) -> DataFrame:
    """(edge_id, alpha, beta, p_mean, n_eff, newest): signed net evidence added to a Beta prior."""
    rows = _evidence(attached, hazards, sources, at)
    sums = rows.groupBy("edge_id").agg(F.sum(F.col("polarity") * F.col("w") * reliability_weight(F.col("alpha"))).alias("s"), F.max("observed_at").alias("newest"))
    p0 = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prior_p")))
    out = sums.join(prior, "edge_id").withColumns({"alpha": strength * p0 + scale * F.greatest("s", F.lit(0.0)), "beta": strength * (1 - p0) + scale * F.greatest(-F.col("s"), F.lit(0.0))})
    return out.select("edge_id", "alpha", "beta", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("p_mean"), F.abs("s").alias("n_eff"), "newest")


def beta_reputation(attached: DataFrame, sources: DataFrame, at: str, forgetting: float = config.FORGETTING_PER_HOUR) -> DataFrame:
    rows = window_by_clock(attached, at).join(F.broadcast(sources), "source_class")
    w = kernel(F.col("distance_m")) * F.col("alpha") * F.pow(F.lit(forgetting), age_s(at) / 3600)
    sums = rows.groupBy("edge_id").agg(F.sum(F.when(F.col("polarity") > 0, w).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("polarity") <= 0, w).otherwise(0.0)).alias("s"))
    return sums.withColumn("p_mean", (F.col("r") + 1) / (F.col("r") + F.col("s") + 2))


def newest_reliable_depth(attached: DataFrame, dominant: DataFrame, sources: DataFrame, at_least: float = config.RELIABLE_AT) -> DataFrame:
    good = attached.join(F.broadcast(sources).filter(F.col("alpha") >= at_least), "source_class").filter("depth_mm IS NOT NULL")
    good = good.join(dominant.select("edge_id", "hazard_class"), ["edge_id", "hazard_class"])
    return good.groupBy("edge_id").agg(F.max_by("depth_mm", F.struct("observed_at", "id")).alias("depth_mm"))


def edge_summary(attached: DataFrame, hazards: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """(edge_id, hazard_class, n, dropped, s, newest, depth_mm): of each edge with reports the dominant class, the net evidence at the time
    `at` (null without any), its newest report and the newest reliable depth of the dominant class, as `dominant_class`, `fuse_beta` and
    `newest_reliable_depth` have them. Reports are read once and combined by edge and class before any edge's rows meet."""
    rows = attached.join(F.broadcast(hazards.select("hazard_class", "tau", "severity")), "hazard_class").join(F.broadcast(sources), "source_class", "left")
    near = kernel(F.col("distance_m"))
    age = age_s(at).cast("double")
    counts = (age >= 0) & (near > 0) & F.col("alpha").isNotNull()
    weight = F.col("polarity") * near * decay(age, F.col("tau")) * reliability_weight(F.col("alpha"))
    deep = F.when((F.col("alpha") >= config.RELIABLE_AT) & F.col("depth_mm").isNotNull(), F.struct("observed_at", "id", "depth_mm"))
    by = rows.groupBy("edge_id", "hazard_class", "severity").agg(F.count("*").alias("n"), F.sum(F.when(counts, weight)).alias("s"), F.max(F.when(counts, F.col("observed_at"))).alias("newest"), F.max(deep).alias("deep"))
    first = F.struct((-F.col("n")).alias("a"), (-F.col("severity")).alias("b"), "hazard_class", "n", F.col("deep.depth_mm").alias("depth_mm"))
    out = by.groupBy("edge_id").agg(F.min(first).alias("f"), F.sum("n").alias("total"), F.sum("s").alias("s"), F.max("newest").alias("newest"))
    return out.select("edge_id", "f.hazard_class", "f.n", (F.col("total") - F.col("f.n")).alias("dropped"), "s", "newest", "f.depth_mm")


def configured_beliefs(summary: DataFrame, prior: DataFrame, hazards: DataFrame, at_least: float = config.PRIOR_ONLY_AT, strength: float = config.PRIOR_STRENGTH, scale: float = config.EVIDENCE_SCALE) -> DataFrame:
    """`hazard_config`, `fuse_beta` and depths in one table, from an edge summary: edges with reports, and those with a high prior only."""
    rows = prior.join(summary, "edge_id", "left").withColumn("observed", F.col("hazard_class").isNotNull())
    rows = rows.withColumn("hazard_class", F.coalesce("hazard_class", F.when(F.col("prior_p") >= at_least, config.PRIOR_ONLY_CLASS))).filter("hazard_class IS NOT NULL")
    p0 = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prior_p")))
    net = lambda s: scale * F.greatest(s, F.lit(0.0))
    alpha = F.when(F.col("s").isNotNull(), strength * p0 + net(F.col("s")))
    beta = F.when(F.col("s").isNotNull(), strength * (1 - p0) + net(-F.col("s")))
    rows = rows.withColumns({"alpha": alpha, "beta": beta}).withColumn("p_mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return rows.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).join(F.broadcast(hazards), "hazard_class")


def _quantiles(a: pd.Series, b: pd.Series, z: pd.Series) -> pd.Series:
    """Edges of one prior share parameters: each distinct triple of a batch is solved once, and none without caution."""
    rows = np.stack([x.to_numpy(float) for x in (a, b, z)], axis=1)
    out = rows[:, 0] / (rows[:, 0] + rows[:, 1])
    ask = rows[:, 2] > 0
    if ask.any():
        distinct, at = np.unique(rows[ask], axis=0, return_inverse=True)
        out[ask] = beta_quantile(*distinct.T)[at.ravel()]
    return pd.Series(out)


def pessimistic_beta(a: Column, b: Column, z: Column) -> Column:
    """Beta quantile at the normal probability of z, never below the mean; found by bisection on the regularised incomplete beta."""
    return F.pandas_udf(_quantiles, "double")(a, b, z)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    from math import erf

    return np.array([0.5 * (1 + erf(x / 2**0.5)) for x in z])


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Gauss-Legendre quadrature on the side of the mean where x lies. A low first parameter p is taken with
    t = u^(1/p), which removes the singularity at 0; a high one as it is, where that substitution would squeeze the mass to one end."""
    from math import lgamma

    nodes, weights = np.polynomial.legendre.leggauss(200)
    swap = x > a / (a + b)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    low = p < 3
    top = np.where(low, y ** np.where(low, p, 1.0), y)
    u = (nodes[None, :] + 1) / 2 * top[:, None]
    t = np.where(low[:, None], u ** (1 / np.where(low, p, 1.0))[:, None], u)
    rest = np.log(np.maximum(1 - t, 1e-300)) * (q[:, None] - 1)
    log_b = np.array([lgamma(i) + lgamma(j) - lgamma(i + j) for i, j in zip(a, b, strict=True)])
    log_f = rest + np.where(low[:, None], -np.log(p)[:, None], np.log(np.maximum(t, 1e-300)) * (p[:, None] - 1)) - log_b[:, None]
    part = np.clip((np.exp(log_f) * weights[None, :]).sum(axis=1) / 2 * top, 0, 1)
    return np.where(swap, 1 - part, part)


def beta_quantile(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    mean, q = a / (a + b), _normal_cdf(z)
    lo, hi = mean.copy(), np.ones_like(mean)
    todo = (z > 0) & (beta_cdf(mean, a, b) < q)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = beta_cdf(mid, a, b) < q
        lo, hi = np.where(todo & low, mid, lo), np.where(todo & ~low, mid, hi)
    return np.where(todo, (lo + hi) / 2, mean)


def priced_edges(edges: DataFrame, configured: DataFrame, users: DataFrame, z_zero: bool = False) -> DataFrame:
    """Cost in seconds of each edge for each user class; null: removed. Edges without a configuration cost their free-flow time. configured:
    from `configured_beliefs`."""
    rows = configured.select("edge_id", "hazard_class", "severity", "h_max_mm", "epsilon", "prior_p", "alpha", "beta", "p_mean", "depth_mm")
    rows = edges.select("edge_id", "free_flow_seconds", "free_flow_kmh").join(rows, "edge_id", "left").crossJoin(F.broadcast(users))  # four user classes
    mean = F.coalesce("p_mean", "prior_p", F.lit(0.0))
    p0 = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prior_p")))
    a, b = F.coalesce("alpha", config.PRIOR_STRENGTH * p0), F.coalesce("beta", config.PRIOR_STRENGTH * (1 - p0))
    p = mean if z_zero else F.when(F.col("hazard_class").isNull() | (F.col("z") == 0), mean).otherwise(pessimistic_beta(F.coalesce(a, F.lit(1.0)), F.coalesce(b, F.lit(1.0)), F.col("z")))
    rows = rows.withColumn("p", p)
    cost = edge_cost(F.col("free_flow_seconds"), F.col("free_flow_kmh"), F.col("p"), F.col("depth_mm"), F.coalesce("severity", F.lit(0.0)), F.col("lam"), F.coalesce("h_max_mm", F.lit(float("inf"))), F.coalesce("epsilon", F.lit(1.0)))
    return rows.select("edge_id", "user_class", "hazard_class", "p", cost.alias("cost_s"))


def restricted_edges(attached: DataFrame, hazards: DataFrame, sources: DataFrame, at: str, classes: list[str], index: DataFrame, most: float = config.MAX_FLOOD_INDEX, reports: int = config.MIN_REPORTS) -> DataFrame:
    """(edge_id, rule): edges closed by enough live reports of a class or one from a reliable source, or by a flood index (p_mean) over
    the limit where a live flood report stands; the first rule that holds."""
    live = live_reports(attached, hazards, at).join(F.broadcast(sources), "source_class")
    by = live.groupBy("edge_id", "hazard_class").agg(F.count("*").alias("n"), F.max("alpha").alias("best"))
    avoid = by.filter(F.col("hazard_class").isin(*classes) & ((F.col("n") >= reports) | (F.col("best") >= config.RELIABLE_AT)))
    flood = by.filter(F.col("hazard_class").isin("flood", "waterlogging") & ((F.col("n") >= reports) | (F.col("best") >= config.RELIABLE_AT))).select("edge_id").distinct()
    deep = flood.join(index.filter(F.col("p_mean") > most), "edge_id", "left_semi")
    place = {k: i for i, k in enumerate(classes)}
    order = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("hazard_class"))
    rules = avoid.select("edge_id", order.alias("o"), F.col("hazard_class").alias("rule")).unionByName(deep.select("edge_id", F.lit(len(classes)).alias("o"), F.lit("flood_index").alias("rule")))
    return rules.groupBy("edge_id").agg(F.min_by("rule", "o").alias("rule"))
