"""Street graphs: splitting ways, edges, inventories, reachability and shortest costs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.geo import haversine_m

Written = Callable[[DataFrame, str], DataFrame]
KMH = {"trunk": 60.0, "primary": 45.0, "secondary": 40.0, "tertiary": 30.0}


def by_way():
    return Window.partitionBy("way").orderBy("seq")


def profile_edges(edges: DataFrame, profile: tuple) -> DataFrame:
    """Edges that a traveller may use, with seconds: own speeds by road class, or the car's times a factor; closed classes left out.
    Who ignores one-way rules also gets the reverse of edges without one (reversed: true, same edge_id)."""
    speeds, default, factors, cap, closed, both_ways = profile
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else None
    kmh = F.col("free_flow_kmh")
    if default is not None:
        kmh = F.coalesce(F.element_at(table(speeds), F.col("highway")), F.lit(default)) if speeds else F.lit(default)
    elif factors:
        kmh = kmh * F.coalesce(F.element_at(table(factors), F.col("highway")), F.lit(1.0))
    kmh = F.least(kmh, F.lit(cap)) if cap else kmh
    out = edges.filter(~F.col("highway").isin(*closed)) if closed else edges
    out = out.withColumns({"seconds": F.col("length_m") / (kmh / 3.6), "reversed": F.lit(False)})
    if both_ways:
        back = edges.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))
        single = out.join(back, ["from_node", "to_node"], "left_anti")
        turned = single.withColumns({"from_node": F.col("to_node"), "to_node": F.col("from_node"), "reversed": F.lit(True)}).select(out.columns)
        out = out.unionByName(turned)
    return out


def junction_nodes(points: DataFrame) -> DataFrame:
    """Nodes used at least twice, or at an end of a way. points: way, seq, node."""
    ends = points.withColumn("last", F.max("seq").over(Window.partitionBy("way"))).withColumn("end", (F.col("seq") == 1) | (F.col("seq") == F.col("last")))
    return ends.groupBy("node").agg(F.count("*").alias("uses"), F.max("end").alias("at_end")).filter("uses >= 2 OR at_end").select("node")


def split_ways(points: DataFrame) -> DataFrame:
    """points with `segment`: the number of junctions passed, so a segment runs from one junction to the next."""
    marks = points.join(junction_nodes(points).withColumn("junction", F.lit(1)), "node", "left")
    return marks.withColumn("segment", F.coalesce(F.sum("junction").over(by_way().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("junction", F.coalesce("junction", F.lit(0)))


def split_ways_capped(points: DataFrame, cap_m: float) -> DataFrame:
    """points with `segment` where a stretch also ends once it is cap_m long. A way's points are folded in order; a way is bounded."""
    step = F.coalesce(haversine_m(F.lag("lat").over(by_way()), F.lag("lon").over(by_way()), F.col("lat"), F.col("lon")), F.lit(0.0))
    marks = points.join(junction_nodes(points).withColumn("junction", F.lit(1)), "node", "left").withColumns({"step": step, "junction": F.coalesce("junction", F.lit(0))})
    ways = marks.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("seq", "step", "junction"))).alias("p"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("segments"))

    def fold(s, x):
        m = s["m"] + x["step"]
        cut = (x["junction"] == 1) | (m >= cap_m)
        return F.struct(F.when(cut, 0.0).otherwise(m).alias("m"), (s["n"] + cut.cast("int")).alias("n"), F.concat(s["segments"], F.array(s["n"])).alias("segments"))

    numbers = ways.select("way", F.explode(F.arrays_zip(F.col("p.seq").alias("seq"), F.aggregate("p", start, fold, lambda s: s["segments"]).alias("segment"))).alias("x"))
    return marks.drop("step").join(numbers.select("way", "x.seq", "x.segment"), ["way", "seq"])


def way_lengths(points: DataFrame) -> DataFrame:
    step = haversine_m(F.col("lat"), F.col("lon"), F.lead("lat").over(by_way()), F.lead("lon").over(by_way()))
    return points.withColumn("step", step).groupBy("way").agg(F.sum("step").alias("length_m"), F.count("*").alias("points"))


def build_graph(points: DataFrame, cap_m: float | None = None) -> DataFrame:
    """Directed edges (way, segment, from_node, to_node, length_m, seconds, highway, backward) between junctions, which also end once they
    are cap_m long, if given; loops are left out. points: way, seq, node, lat, lon, highway, oneway ('yes', '-1' or other)."""
    marked = split_ways(points) if cap_m is None else split_ways_capped(points, cap_m)
    step = haversine_m(F.lag("lat").over(by_way()), F.lag("lon").over(by_way()), F.col("lat"), F.col("lon"))
    steps = marked.withColumns({"step": step, "before": F.lag("node").over(by_way())}).filter("before IS NOT NULL")
    segments = steps.groupBy("way", "segment").agg(
        F.min_by("before", "seq").alias("a"), F.max_by("node", "seq").alias("b"), F.sum("step").alias("length_m"), F.first("highway").alias("highway"), F.first("oneway").alias("oneway")
    )
    kmh = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KMH.items() for x in kv]), F.col("highway")), F.lit(20.0))
    directions = F.when(F.col("oneway") == "yes", F.array(F.lit(False))).when(F.col("oneway") == "-1", F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    out = segments.filter("a <> b").withColumns({"backward": F.explode(directions), "seconds": F.col("length_m") / (kmh / 3.6)})
    return out.select("way", "segment", F.when(F.col("backward"), F.col("b")).otherwise(F.col("a")).alias("from_node"), F.when(F.col("backward"), F.col("a")).otherwise(F.col("b")).alias("to_node"), "length_m", "seconds", "highway", "backward")


def choropleth(edges: DataFrame, p: str, size: float) -> DataFrame:
    cy, cx = F.bround(F.col("lat1") / size).cast("long"), F.bround(F.col("lon1") / size).cast("long")
    return edges.groupBy(cy.alias("cy"), cx.alias("cx")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.max(p).alias("max_p"), F.avg("lat1").alias("lat"), F.avg("lon1").alias("lon"))


def road_inventory(edges: DataFrame, levels: list[str]) -> DataFrame:
    """Edges and km by class in the order of importance, and running totals. At most one row for each class."""
    level = F.array_position(F.array(*map(F.lit, levels)), F.col("highway")).cast("int")
    by = edges.groupBy(level.alias("level"), "highway").agg(F.count("*").alias("edges"), (F.sum("length_m") / 1000).alias("km"))
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumns({"edges_to": F.sum("edges").over(w), "km_to": F.sum("km").over(w)})


def street_stretches(edges: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(street_name, stretch, edges, length_m, edge_id, lat, lon): edges of one name that share nodes, and of each stretch the edge whose
    middle is nearest to the mean of all middles (in degrees; ties within 1e-12: the lowest id), which stands for it on a map. Each edge
    is linked to the lowest edge of its name at either end, not to all of them. Ends of edges (lat1, lon1, lat2, lon2) may be missing; then
    no edge stands for the stretch."""
    ends = edges.select("edge_id", "street_name", F.explode(F.array("from_node", "to_node")).alias("node"))
    low = ends.groupBy("street_name", "node").agg(F.min("edge_id").alias("b"))
    named = components(ends.join(low, ["street_name", "node"]).select(F.col("edge_id").alias("a"), "b"))
    rows = edges.join(named, edges["edge_id"] == named["node"], "left").withColumn("stretch", F.coalesce("component", "edge_id"))
    if not {"lat1", "lon1", "lat2", "lon2"} <= set(edges.columns):
        return rows.groupBy("street_name", "stretch").agg(F.count("*").alias("edges"), F.sum("length_m").alias("length_m"))
    by = ["street_name", "stretch"]
    rows = rows.select(*by, "edge_id", "length_m", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("edges"), F.sum("length_m").alias("total_m"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    far = F.round(F.pow(F.col("lat") - F.col("clat"), 2) + F.pow(F.col("lon") - F.col("clon"), 2), 12)
    nearest = rows.join(whole.select(*by, "clat", "clon"), by).groupBy(*by).agg(F.min(F.struct(far.alias("far"), "edge_id", "lat", "lon")).alias("e"))
    return whole.join(nearest, by).select(*by, "edges", F.col("total_m").alias("length_m"), "e.edge_id", "e.lat", "e.lon")


def reachable(edges: DataFrame, sources: DataFrame, written: Written, hops: int | None = None, rounds: int = 1_000_000) -> DataFrame:
    """(source, node, hops) for every node reached along directed edges (in at most `hops`, if stated), by rounds from the frontier until
    it is empty; an error where the round limit is met before."""
    seen = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")), "reached")
    front = seen
    for hop in range(1, rounds + 1):
        if hops is not None and hop > hops:
            break
        step = front.join(edges, front["node"] == edges["from_node"]).select("source", F.col("to_node").alias("node")).distinct()
        front = written(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 10 == 0:
            seen = written(seen, "reached")
    else:
        raise RuntimeError(f"reachable: nodes are left after {rounds} rounds")
    return seen


def shortest_costs(edges: DataFrame, sources: DataFrame, written: Written, rounds: int = 1_000_000, limit: float | None = None, by: tuple[str, ...] = (), compact: int = 8, doublings: int = 2) -> DataFrame:
    """(by, source, node, cost) of the cheapest paths over priced edges (by, from_node, to_node, cost; null cost: removed). With `by`, each
    of its values (a variant of the costs, few) is a graph of its own and all are searched at once.

    Edges are first put together to shortcuts of up to 2^doublings edges (4 by default), which divides the rounds by as much for a few
    tens of shortcuts a node. Each round relaxes the shortcuts out of nodes whose cost has just improved, for all sources, until none does;
    it writes the improved rows only. The least row of a node counts, and every `compact` rounds the rows are put together. An error
    where the round limit is met before.
    """
    key = [*by, "source", "node"]
    steps = written(edges.filter("cost IS NOT NULL").groupBy(*by, "from_node", "to_node").agg(F.min("cost").alias("step")), "steps")
    for _ in range(doublings):
        on = steps.select(*by, F.col("from_node").alias("to_node"), F.col("to_node").alias("next"), F.col("step").alias("more"))
        longer = steps.join(on, [*by, "to_node"]).select(*by, "from_node", F.col("next").alias("to_node"), (F.col("step") + F.col("more")).alias("step"))
        steps = written(steps.unionByName(longer).groupBy(*by, "from_node", "to_node").agg(F.min("step").alias("step")), "steps")
    start = sources.select(F.col("node").alias("source"), "node").distinct()
    start = start.crossJoin(F.broadcast(steps.select(*by).distinct())) if by else start  # few variants
    front = written(start.select(*key, F.lit(0.0).alias("cost")), "costs")
    known = [front]
    for _ in range(rounds):
        tried = front.withColumnRenamed("node", "from_node").join(steps, [*by, "from_node"])
        tried = tried.groupBy(*by, "source", F.col("to_node").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        tried = tried if limit is None else tried.filter(F.col("new") <= limit)
        best = reduce(DataFrame.unionByName, known)
        better = tried.join(best, key, "left").groupBy(*key, "new").agg(F.min("cost").alias("cost")).filter("cost IS NULL OR new < cost - 1e-9")
        front = written(better.select(*key, F.col("new").alias("cost")), "costs")
        if front.isEmpty():
            break
        known.append(front)
        if len(known) > compact:
            known = [written(reduce(DataFrame.unionByName, known).groupBy(*key).agg(F.min("cost").alias("cost")), "costs")]
    else:
        raise RuntimeError(f"shortest_costs: costs still improve after {rounds} rounds")
    return reduce(DataFrame.unionByName, known).groupBy(*key).agg(F.min("cost").alias("cost"))


def routes(costs: DataFrame, edges: DataFrame, pairs: DataFrame, written: Written, rounds: int = 1_000_000, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, source, target, path): nodes from source to target, back over the edge that completes the cheapest cost (ties to the lower node).

    Each node knows the part of its path from an ancestor on, and takes over its ancestor's part in each round, so parts double and
    rounds grow with the logarithm of the longest path; an error where the round limit is met before all have reached their source.
    """
    at = [*by, "source"]
    steps = edges.filter("cost IS NOT NULL").groupBy(*by, "from_node", "to_node").agg(F.min("cost").alias("step"))
    before = costs.select(*at, F.col("node").alias("from_node"), F.col("cost").alias("cost0"))
    on = costs.withColumnRenamed("node", "to_node").join(steps, [*by, "to_node"]).join(before, [*at, "from_node"]).filter("abs(cost0 + step - cost) < 1e-6 AND to_node <> source")
    parts = written(on.groupBy(*at, F.col("to_node").alias("node")).agg(F.min("from_node").alias("ancestor")).withColumn("path", F.array("node")), "path-parts")
    for _ in range(rounds):
        above = parts.select(*at, F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("path").alias("before"))
        if parts.join(above, [*at, "ancestor"], "left_semi").isEmpty():
            break
        joined = parts.join(above, [*at, "ancestor"], "left")
        parts = written(joined.select(*at, "node", F.coalesce("next", "ancestor").alias("ancestor"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")), "path-parts")
    else:
        raise RuntimeError(f"routes: parts are left after {rounds} rounds")
    whole = parts.filter("ancestor = source").select(*at, F.col("node").alias("target"), F.concat(F.array("source"), "path").alias("path"))
    own = costs.filter("node = source").select(*at, F.col("node").alias("target"), F.array("node").alias("path"))
    return pairs.join(whole.unionByName(own), ["source", "target"])


def path_edges(paths: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, source, target, seq, edge_id): the edges of paths, of parallel ones the cheapest (ties to the lower id)."""
    legs = paths.select(*by, "source", "target", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("seq", "from_node"), "path")
    legs = legs.withColumn("to_node", F.element_at("path", F.col("seq") + 2)).drop("path")
    cheapest = edges.filter("cost IS NOT NULL").groupBy(*by, "from_node", "to_node").agg(F.min(F.struct("cost", "edge_id")).alias("e"))
    return legs.join(cheapest, [*by, "from_node", "to_node"]).select(*by, "source", "target", "seq", F.col("e.edge_id").alias("edge_id"), F.col("e.cost").alias("cost"))
