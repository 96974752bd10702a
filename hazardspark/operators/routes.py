"""Route tables: edges of paths, exposure, facts and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.operators.scoring import block_bootstrap


def route_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (route, seq, node) -> (route, seq, u, v, edge_id): the cheapest of parallel edges; null where there is none."""
    pairs = paths.withColumnRenamed("node", "u").withColumn("v", F.lead("u").over(Window.partitionBy("route").orderBy("seq"))).filter("v IS NOT NULL")
    best = edges.groupBy(F.col("from_node").alias("u"), F.col("to_node").alias("v")).agg(F.min(F.struct("free_flow_seconds", "edge_id")).alias("b")).select("u", "v", "b.edge_id")
    return pairs.join(best, ["u", "v"], "left").select("route", "seq", "u", "v", "edge_id")


def route_exposure(rows: DataFrame, high: float) -> DataFrame:
    """rows: route, edge_id, p, free_flow_seconds, observed."""
    p, s = F.col("p"), F.col("free_flow_seconds")
    return rows.groupBy("route").agg(
        F.count("*").alias("edges"), F.sum(p).alias("sum_p"), F.sum(F.when(F.coalesce("observed", F.lit(False)), p).otherwise(0.0)).alias("sum_observed"), F.max(p).alias("worst_p"),
        (F.sum(p * s) / F.sum(s)).alias("mean_p"), F.sum(F.when(p >= high, s).otherwise(0.0)).alias("high_s"),
    )


def main_streets(rows: DataFrame, k: int, least_m: float) -> DataFrame:
    """The k longest streets of a route with at least least_m, in the order in which it meets them."""
    by = rows.groupBy("route", "street_name").agg(F.sum("length_m").alias("m"), F.min("seq").alias("first")).filter(F.col("m") >= least_m)
    top = by.withColumn("r", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("m"), "street_name"))).filter(F.col("r") <= k)
    names = F.array_sort(F.collect_list(F.struct("first", "street_name")))  # at most k
    return top.groupBy("route").agg(F.array_join(F.transform(names, lambda x: x["street_name"]), " > ").alias("streets"), F.count("*").alias("n"))


def route_report(rows: DataFrame, bands: list[str]) -> DataFrame:
    """rows (route, signal or null, gap label or null, band) -> (route, signals, gaps, worst_band): distinct signals and gap labels, and
    the first band in the given order that an edge of the route has."""
    place = F.array_position(F.array(*map(F.lit, bands)), F.col("band"))
    out = rows.groupBy("route").agg(F.count_distinct("signal").alias("signals"), F.count_distinct("gap").alias("gaps"), F.min(place).alias("b"))
    return out.select("route", "signals", "gaps", F.element_at(F.array(*map(F.lit, bands)), F.col("b").cast("int")).alias("worst_band"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both with one key, and none of the others."""
    return a.alias("a").join(b.alias("b"), key)


def exposure_efficiency(pairs: DataFrame) -> DataFrame:
    """pairs (risk_a, risk_b, s_a, s_b): risk avoided for each extra second, where b takes longer."""
    extra = pairs.filter("s_b > s_a").withColumn("per_s", (F.col("risk_a") - F.col("risk_b")) / (F.col("s_b") - F.col("s_a")))
    return extra.agg(F.count("*").alias("n"), F.percentile("per_s", 0.5).alias("median"), F.percentile("per_s", 0.95).alias("p95"))


def route_changes(legs: DataFrame, base: str, by: str = "variant") -> DataFrame:
    """legs (by, source, target, edge_id) of searched routes -> (by, source, target, edges, base_edges, shared, differs) of every variant but
    the base one, for pairs that both have a route of at least one edge: whether the two sets of edges are not the same."""
    pair = ["source", "target"]
    rows = legs.select(by, *pair, "edge_id").distinct()
    count = rows.groupBy(by, *pair).agg(F.count("*").alias("edges"))
    first = rows.filter(F.col(by) == base).drop(by)
    others = count.filter(F.col(by) != base).join(count.filter(F.col(by) == base).select(*pair, F.col("edges").alias("base_edges")), pair)
    shared = rows.filter(F.col(by) != base).join(first, [*pair, "edge_id"]).groupBy(by, *pair).agg(F.count("*").alias("shared"))
    out = others.join(shared, [by, *pair], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    return out.withColumn("differs", (F.col("edges") != F.col("shared")) | (F.col("base_edges") != F.col("shared"))).select(by, *pair, "edges", "base_edges", "shared", "differs")


def compare_searched_modes(legs: DataFrame, base: str, by: str = "mode") -> DataFrame:
    """legs (by, source, target, edge_id, length_m, seconds) -> (by, found, km, minutes, kmh, differing): routes found, medians, and the
    share of the routes, found by both, that do not run over the base mode's edges (null for the base)."""
    routes = legs.groupBy(by, "source", "target").agg(F.sum("length_m").alias("m"), F.sum("seconds").alias("s"))
    out = routes.groupBy(by).agg(F.count("*").alias("found"), (F.percentile("m", 0.5) / 1000).alias("km"), (F.percentile("s", 0.5) / 60).alias("minutes"), F.percentile(F.col("m") / F.col("s") * 3.6, 0.5).alias("kmh"))
    share = route_changes(legs, base, by).groupBy(by).agg(F.avg(F.col("differs").cast("double")).alias("differing"))
    return out.join(share, by, "left")


def held_out_counts(legs: DataFrame, held_out: DataFrame, by: str = "variant") -> DataFrame:
    """(by, source, target, edges, held_out): how many edges of each searched route have a report that its costs did not know."""
    marked = legs.join(held_out.select("edge_id", F.lit(1).alias("__h")).distinct(), "edge_id", "left")
    return marked.groupBy(by, "source", "target").agg(F.count("*").alias("edges"), F.count("__h").alias("held_out"))


def paired_difference(counts: DataFrame, a: str, b: str, replicates: int, by: str = "variant", value: str = "held_out", seed: int = 1) -> DataFrame:
    """One row: pairs that both variants have, mean of each, mean of a - b, and its 2.5 and 97.5 percent bounds over replicates that draw the
    pairs anew (both variants with the same draws)."""
    side = lambda v, name: counts.filter(F.col(by) == v).select("source", "target", F.col(value).cast("double").alias(name))
    pairs = side(a, "a").join(side(b, "b"), ["source", "target"]).withColumn("d", F.col("a") - F.col("b"))
    blocks = pairs.withColumn("k", (F.row_number().over(Window.orderBy("source", "target")) - 1).cast("long"))  # a row for each sampled pair
    drawn = block_bootstrap(blocks.select(F.col("k").alias("b"), F.col("d").alias("num"), F.lit(1.0).alias("den")), replicates, seed=seed)
    bounds = drawn.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    point = pairs.agg(F.count("*").alias("pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("difference"))
    return point.crossJoin(bounds)  # one row each
