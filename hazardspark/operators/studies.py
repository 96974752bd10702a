"""Comparisons of configurations, modes and areas, certificates of routes, and clusters of points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.functions.belief import kernel, reliability_weight
from hazardspark.functions.geo import DEGREE_M, EARTH_M, cell, grid_cell, grid_cover, haversine_m
from hazardspark.operators.beliefs import dominant_class
from hazardspark.operators.observations import age_s
from hazardspark.operators.spatial import points_near

Written = Callable[[DataFrame, str], DataFrame]


def summarise_routes(routes: DataFrame, by: str) -> DataFrame:
    """routes (by, duration_s, best_s; null duration: disconnected): detour mean and percentiles, disconnected, share at least 1.5 times as long."""
    ratio = F.col("duration_s") / F.col("best_s")
    return routes.groupBy(by).agg(
        F.avg(ratio).alias("mean_detour"), F.percentile(ratio, 0.5).alias("p50"), F.percentile(ratio, 0.95).alias("p95"), F.count_if(F.col("duration_s").isNull()).alias("disconnected"),
        F.avg(F.when(ratio.isNotNull(), (ratio >= 1.5).cast("double"))).alias("long_share"),
    )


def feature_centre(pieces: DataFrame) -> DataFrame:
    """pieces (feature, tunnel, lat, lon): centre of the tunnel pieces, or of all where there is none, and the farthest used piece."""
    used = pieces.withColumn("any", F.max("tunnel").over(Window.partitionBy("feature"))).filter("tunnel OR NOT any")
    centre = used.groupBy("feature").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return used.join(centre, "feature").groupBy("feature").agg(F.first("clat").alias("lat"), F.first("clon").alias("lon"), F.max(d).alias("span_m"), F.count("*").alias("pieces"))


def exposure_share(lines: DataFrame, mask: DataFrame, size: float, step_m: float = 50.0) -> DataFrame:
    """lines (route, lat1, lon1, lat2, lon2, length_m): share of points, one every step_m of each line, that lie in a cell of the mask (cy, cx)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length_m") / step_m))
    points = lines.select("*", n.alias("n")).select("route", "lat1", "lon1", "lat2", "lon2", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    f = (F.col("k") + 0.5) / F.col("n")
    at = points.select("route", cell(F.col("lat1") + f * (F.col("lat2") - F.col("lat1")), size).alias("cy"), cell(F.col("lon1") + f * (F.col("lon2") - F.col("lon1")), size).alias("cx"))
    counts = at.groupBy("route", "cy", "cx").agg(F.count("*").alias("n"))
    inside = counts.join(mask.select("cy", "cx", F.lit(1).alias("in")), ["cy", "cx"], "left")
    return inside.groupBy("route").agg((F.sum(F.when(F.col("in") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.sum("n").alias("points"))


def pareto_sweep(routes: DataFrame, grid: DataFrame) -> DataFrame:
    """routes (route, seconds, p, n_eff): cost and caution of every (z, lam) of a small grid."""
    p = F.least(F.lit(1.0), F.col("p") + F.col("z") * F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n_eff") + 1)))
    rows = routes.crossJoin(F.broadcast(grid)).withColumn("pt", p)
    return rows.groupBy("z", "lam").agg(F.avg(F.col("seconds") * (1 + F.col("lam") * F.col("pt"))).alias("mean_cost"), F.avg("pt").alias("mean_risk"), F.count("*").alias("n"))


def config_costs(edges: DataFrame, configured: DataFrame, attached: DataFrame, hazards: DataFrame, sources: DataFrame, at: str, variants: DataFrame, configs: DataFrame, shared_tau_s: float, ttl_s: float) -> DataFrame:
    """(cfg, edge_id, p, blocked, cost_s): the cost of every edge under every configuration; null where it is closed.

    variants names the ways to weigh reports up to the time `at`: beta (own decay of the class), shared (one decay), ttl (all alike for
    ttl_s, then none), hindsight (later reports too). configs (cfg, variant or 'none', block, lam): an edge whose probability exceeds
    `block` is closed, others cost seconds (1 + lam p severity). Reports are read once and combined by edge and variant."""
    rows = attached.join(F.broadcast(hazards), "hazard_class").join(F.broadcast(sources), "source_class").crossJoin(F.broadcast(variants)).withColumn("age", age_s(at).cast("double"))
    v, age = F.col("variant"), F.col("age")
    seen = (v == "hindsight") | ((age >= 0) & ((v != "ttl") | (age <= ttl_s)))
    fade = F.when(v == "shared", F.exp(-age / shared_tau_s)).when(v == "ttl", 1.0).otherwise(F.exp(-F.greatest(age, F.lit(0.0)) / F.col("tau")))
    net = rows.filter(seen).groupBy("edge_id", "variant").agg(F.sum(F.col("polarity") * kernel(F.col("distance_m")) * reliability_weight(F.col("alpha")) * fade).alias("s"))
    every = edges.select("edge_id", "free_flow_seconds").crossJoin(F.broadcast(configs))
    known = configured.select("edge_id", "prior_p", "severity", F.lit(True).alias("known"))
    out = every.join(known, "edge_id", "left").join(net, ["edge_id", "variant"], "left")
    s, n, k = F.coalesce("s", F.lit(0.0)), config.PRIOR_STRENGTH, config.EVIDENCE_SCALE
    p = F.when(F.col("known") & (v != "none"), (n * F.col("prior_p") + k * F.greatest(s, F.lit(0.0))) / (n + k * F.abs(s)))
    out = out.withColumn("p", p).withColumn("blocked", F.coalesce(F.col("p") > F.col("block"), F.lit(False)))
    cost = F.col("free_flow_seconds") * (1 + F.coalesce(F.col("lam") * F.col("p") * F.col("severity"), F.lit(0.0)))
    return out.select("cfg", "edge_id", "p", "blocked", F.when(~F.col("blocked"), cost).alias("cost_s"))


def calibration_scores(attached: DataFrame, prior: DataFrame, hazards: DataFrame, sources: DataFrame, ages_h: list[int], shared_tau_s: float, ttl_s: float, official: str = "official_feed") -> DataFrame:
    """(edge_id, hazard_class, age_h, scorer, p, y) for every edge with reports that are not official: y, whether it has an official one;
    p, the probability from the other reports of its dominant class if they were of the given age, by five scorers: the prior, one
    shared decay, the model (decay of the class), ttl, and reputation."""
    crowd = attached.filter(F.col("source_class") != official)
    label = attached.groupBy("edge_id").agg(F.max((F.col("source_class") == official).cast("int")).alias("y"))
    rows = crowd.join(dominant_class(crowd, hazards).select("edge_id", "hazard_class"), ["edge_id", "hazard_class"]).join(F.broadcast(hazards), "hazard_class").join(F.broadcast(sources), "source_class")
    near = kernel(F.col("distance_m"))
    vote = lambda test: F.sum(F.when(test, near * F.col("alpha")).otherwise(0.0))
    net = rows.groupBy("edge_id", "hazard_class", "tau").agg(F.sum(F.col("polarity") * near * reliability_weight(F.col("alpha"))).alias("s"), vote(F.col("polarity") > 0).alias("r"), vote(F.col("polarity") <= 0).alias("q"))
    base = net.join(prior, "edge_id").join(label, "edge_id").withColumn("age_h", F.explode(F.array(*map(F.lit, ages_h))))
    seconds, fade = F.col("age_h") * 3600.0, F.pow(F.lit(config.FORGETTING_PER_HOUR), F.col("age_h"))
    n, k = config.PRIOR_STRENGTH, config.EVIDENCE_SCALE

    def beta(f):
        s = F.col("s") * f
        return (n * F.col("prior_p") + k * F.greatest(s, F.lit(0.0))) / (n + k * F.abs(s))

    scores = {
        "prior": F.col("prior_p"), "shared": beta(F.exp(-seconds / shared_tau_s)), "model": beta(F.exp(-seconds / F.col("tau"))), "ttl": beta((seconds <= ttl_s).cast("double")),
        "reputation": (F.col("r") * fade + 1) / ((F.col("r") + F.col("q")) * fade + 2),
    }
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("scorer"), p.alias("p")) for name, p in scores.items()])).alias("x")
    return base.select("edge_id", "hazard_class", "age_h", "y", each).select("edge_id", "hazard_class", "age_h", "x.scorer", "x.p", "y")


def exact_medians(rows: DataFrame, by: str, columns: list[str], written: Written, width: float = 2e-4) -> DataFrame:
    """(by, column, n, median) of the values that are not null, exact (between the two middle ones the mean), without holding all values of a
    group: a sketch gives bounds around the middle, and only the values between them are counted one by one. Bounds are widened until they
    hold the middle."""
    pair = F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("value")) for x in columns])).alias("x")
    rows = written(rows.select(by, pair).select(by, "x.column", "x.value").filter("value IS NOT NULL"), "median-values")
    key, middle = [by, "column"], (F.col("n") - 1) / 2
    while True:
        at = F.array(F.lit(max(0.0, 0.5 - width)), F.lit(min(1.0, 0.5 + width)))
        cut = rows.groupBy(*key).agg(F.percentile_approx("value", at, 10_000).alias("c"))
        bound = cut.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("c")[0].alias("lo"), F.col("c")[1].alias("hi"))
        near = rows.join(F.broadcast(bound), F.col(by).eqNullSafe(F.col(f"__{by}")) & (F.col("column") == F.col("__column")))  # a row for each group and column
        whole = width >= 0.5
        below, above = F.col("value") < F.col("lo"), F.col("value") > F.col("hi")
        place = F.when(F.lit(not whole) & below, F.lit(None)).when(F.lit(not whole) & above, F.lit(None)).otherwise(F.col("value"))
        some = near.select(*key, place.alias("value"), F.when(below, 0).otherwise(1).alias("side")).groupBy(*key, "value", F.when(F.col("value").isNull(), F.col("side")).otherwise(0).alias("side")).agg(F.count("*").alias("k"))
        order = Window.partitionBy(*key).orderBy("side", F.col("value").asc_nulls_first())
        upto = written(some.withColumns({"to": F.sum("k").over(order), "n": F.sum("k").over(Window.partitionBy(*key))}).withColumn("from", F.col("to") - F.col("k")), "median-counts")
        holds = lambda rank: (F.col("from") <= rank) & (rank < F.col("to"))
        pick = upto.groupBy(*key).agg(F.max("n").alias("n"), F.max(F.when(holds(F.floor(middle)), F.col("value"))).alias("a"), F.max(F.when(holds(F.ceil(middle)), F.col("value"))).alias("b"))
        if whole or pick.filter("a IS NULL OR b IS NULL").isEmpty():
            return pick.select(*key, "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * 0.5 + F.col("b") * 0.5).alias("median"))
        width *= 10


def compare_modes(edges: DataFrame, by: str, written: Written) -> DataFrame:
    """edges (by, route, length_m, seconds; null seconds: closed): found routes, median km, minutes and km/h of each mode."""
    routes = edges.groupBy(by, "route").agg(F.sum("length_m").alias("m"), F.sum("seconds").alias("s"), F.count_if(F.col("seconds").isNull()).alias("closed"))
    ok = written(routes.filter("closed = 0").withColumn("v", F.col("m") / F.col("s") * 3.6).select(by, "m", "s", "v"), "mode-routes")
    medians = exact_medians(ok, by, ["m", "s", "v"], written)
    value = lambda x: F.max(F.when(F.col("column") == x, F.col("median")))
    found = ok.groupBy(by).agg(F.count("*").alias("found"))
    return found.join(medians.groupBy(by).agg((value("m") / 1000).alias("km"), (value("s") / 60).alias("minutes"), value("v").alias("kmh")), by, "left")


def route_certificates(routes: DataFrame, scores: DataFrame, tau: float) -> DataFrame:
    """routes (route, edge_id, seconds), scores (edge_id, score, positive): lowest score on positive edges, whether all of them are flagged,
    share of seconds flagged. Routes without a positive edge have no lowest score."""
    rows = routes.join(scores, "edge_id", "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "positive": F.coalesce("positive", F.lit(False))})
    return rows.groupBy("route").agg(
        F.min(F.when(F.col("positive"), F.col("score"))).alias("lowest"), (F.min(F.when(F.col("positive"), F.col("score"))) >= tau).alias("covered"),
        (F.sum(F.when(F.col("score") >= tau, F.col("seconds")).otherwise(0.0)) / F.sum("seconds")).alias("flagged_share"),
    )


def link_neighbours(links: DataFrame, radius_m: float, box: float | None = None) -> DataFrame:
    """(link, other) whose midpoints lie within the radius (and the box, as in `points_near`), anywhere on the sphere. All pairs are asked for, so a dense place has many."""
    others = links.select(F.col("link").alias("other"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return points_near(links.select("link", "lat", "lon"), others, radius_m, box=box).filter("link <> other").select("link", "other")


def sample_pairs(reached: DataFrame, n: int, seed: int) -> DataFrame:
    """n (source, target) pairs, target reachable and different, in the order of a seeded hash."""
    pairs = reached.filter("source <> node").select("source", F.col("node").alias("target"))
    return pairs.orderBy(F.xxhash64(F.lit(seed), "source", "target"), "source", "target").limit(n)


def farthest_points(points: DataFrame, n: int) -> list[int]:
    """Ids of n points, the first of lowest id and each next the farthest from those before; n is small and each step is one pass."""
    first = points.orderBy("id").first()
    picked, rows = [first["id"]], points.withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.lit(first["lat"]), F.lit(first["lon"])))
    while len(picked) < n:
        best = rows.agg(F.max(F.struct("d", (-F.col("id")).alias("k"), "id", "lat", "lon")).alias("b")).first()["b"]
        picked.append(best["id"])
        rows = rows.withColumn("d", F.least("d", haversine_m(F.col("lat"), F.col("lon"), F.lit(best["lat"]), F.lit(best["lon"]))))
    return picked


def greedy_clusters(zones: DataFrame, radius_m: float, written: Written) -> DataFrame:
    """(zone_id, cluster): in falling area (ties: lower id), each zone that is still free becomes a centre and takes all free zones within
    the radius. In each round the free zones that lead all their free neighbours become centres, which gives the same centres as one
    zone after another; a zone then belongs to the first centre in reach."""
    order = F.struct((-F.col("area")).alias("k"), F.col("zone_id").alias("i"))
    free = written(zones.select("zone_id", order.alias("place")), "free-zones")
    near = link_neighbours(zones.select(F.col("zone_id").alias("link"), "lat", "lon"), radius_m)
    place = lambda on: free.select(F.col("zone_id").alias(on), F.col("place").alias(f"{on}_place"))
    pairs = written(near.join(place("link"), "link").join(place("other"), "other"), "zone-pairs")
    live, centres = pairs, free.limit(0)
    while True:
        beaten = live.filter("other_place < link_place").select(F.col("link").alias("zone_id")).distinct()
        found = written(free.join(beaten, "zone_id", "left_anti"), "centres")
        centres = written(centres.unionByName(found), "centres")
        taken = live.join(found.select(F.col("zone_id").alias("link")), "link", "left_semi").select(F.col("other").alias("zone_id"))
        free = written(free.join(found.select("zone_id").unionByName(taken).distinct(), "zone_id", "left_anti"), "free-zones")
        if free.isEmpty():
            break
        left = free.select("zone_id")
        live = written(live.join(left, live["link"] == left["zone_id"], "left_semi").join(left, live["other"] == left["zone_id"], "left_semi"), "zone-pairs")
    reach = pairs.join(centres.select(F.col("zone_id").alias("other")), "other", "left_semi").groupBy("link").agg(F.min_by("other", "other_place").alias("cluster"))
    own = centres.select("zone_id", F.col("zone_id").alias("cluster"))
    members = reach.join(own.select(F.col("zone_id").alias("link")), "link", "left_anti")
    return own.unionByName(members.select(F.col("link").alias("zone_id"), "cluster"))


def _metres(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lats)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(h))


def _settle(rows: pa.Table) -> pa.Table:
    """One block of one radius: settles, in order, the zones of the block that no earlier unsettled zone within 2.02 radii can touch."""
    x = {c: rows[c].to_numpy() for c in ("kind", "zone_id", "lat", "lon", "area", "members")}
    radius = rows["radius"][0].as_py()
    old = x["kind"] == 2
    name, lat, lon, area, members = (list(x[c][old]) for c in ("zone_id", "lat", "lon", "area", "members"))
    born = list(zip((-rows["born_area"].to_numpy()[old]).tolist(), name, strict=True))  # the order of the clusters' first zones
    changed: dict[int, None] = {}
    waiting_lat, waiting_lon, settled = [], [], []
    zones = np.flatnonzero(~old)
    for i in zones[np.lexsort((x["zone_id"][zones], -x["area"][zones]))]:
        zone, y, z, weight = int(x["zone_id"][i]), float(x["lat"][i]), float(x["lon"][i]), float(x["area"][i])
        if x["kind"][i] == 1 or (waiting_lat and _metres(y, z, np.array(waiting_lat), np.array(waiting_lon)).min() <= 2.02 * radius):
            waiting_lat.append(y)
            waiting_lon.append(z)
            continue
        far = _metres(y, z, np.array(lat), np.array(lon)) if lat else np.zeros(0)
        near = far.min(initial=np.inf)
        if near <= radius:
            k = max(np.flatnonzero(far == near).tolist(), key=lambda c: born[c])  # of equally near ones the youngest
            total = area[k] + weight
            if total > 0:
                lat[k], lon[k] = (lat[k] * area[k] + y * weight) / total, (lon[k] * area[k] + z * weight) / total
            area[k], members[k] = total, members[k] + 1
        else:
            k = len(name)
            for column, value in ((name, zone), (lat, y), (lon, z), (area, weight), (members, 1), (born, (-weight, zone))):
                column.append(value)
        changed[k] = None
        settled.append((zone, y, z, weight, int(name[k])))
    some = list(changed)
    columns = {
        "radius": [radius] * (len(settled) + len(some)), "kind": [0] * len(settled) + [2] * len(some),
        "zone_id": [s[0] for s in settled] + [int(name[k]) for k in some], "lat": [s[1] for s in settled] + [float(lat[k]) for k in some], "lon": [s[2] for s in settled] + [float(lon[k]) for k in some],
        "area": [s[3] for s in settled] + [float(area[k]) for k in some], "members": [1] * len(settled) + [int(members[k]) for k in some],
        "born_area": [s[3] for s in settled] + [-float(born[k][0]) for k in some], "cluster": [s[4] for s in settled] + [int(name[k]) for k in some],
    }
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(columns.items(), _SETTLED.values(), strict=True)})


_SETTLED = {"radius": pa.float64(), "kind": pa.int32(), "zone_id": pa.int64(), "lat": pa.float64(), "lon": pa.float64(), "area": pa.float64(), "members": pa.int64(), "born_area": pa.float64(), "cluster": pa.int64()}


def running_clusters(zones: DataFrame, radii: list[float], written: Written, rounds: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Clusters whose centres move: in falling area (ties: lower id) each zone joins the nearest cluster whose centre, the area-weighted mean
    of its zones so far, lies within the radius (equally near: the youngest), else it starts one. zones: zone_id, lat, lon, area.
    Returns (radius, zone_id, cluster) and (radius, cluster, lat, lon, area, members); a cluster is named by its first zone. All radii are
    swept in one pass. Zones without area do not move a centre; zones without
    an id or a place are left out.

    The zone that joined a centre last lies within a radius of it, so a zone's choice depends only on earlier zones within two radii. A
    round deals zones to blocks of 16 radii, with the unsettled zones of two radii around them and the clusters in reach; a block settles
    its zones in order, but for those behind an unsettled one from outside. Blocks that settle in one round cannot touch one cluster.
    Zones near one another depend on each other's order by definition, so a block is one task; it holds five numbers a zone.
    """
    fields = ["radius", "kind", "zone_id", "lat", "lon", "area", "members", "born_area"]
    spark = zones.sparkSession
    some = zones.select(F.col("zone_id").cast("long").alias("zone_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce(F.col("area").cast("double"), F.lit(0.0)).alias("area"))
    some = some.filter("zone_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    left = some.select(F.explode(F.array(*map(F.lit, map(float, radii)))).alias("radius"), F.lit(0).alias("kind"), "zone_id", "lat", "lon", "area", F.lit(1).cast("long").alias("members"), F.col("area").alias("born_area"))
    left = written(left, "zones-left")
    schema = ", ".join(f"{c} {'int' if t == pa.int32() else 'bigint' if t == pa.int64() else 'double'}" for c, t in _SETTLED.items())
    settled = clusters = spark.createDataFrame([], schema)
    for _ in range(rounds):
        if left.isEmpty():
            return settled.select("radius", "zone_id", "cluster"), clusters.select("radius", "cluster", "lat", "lon", "area", "members")
        dealt = None
        for radius in map(float, radii):
            size = 16 * radius / DEGREE_M
            mine = lambda df: df.filter(F.col("radius") == radius)  # noqa: B023, E731
            home = grid_cell(F.col("lat"), F.col("lon"), size)
            around = F.explode(grid_cover(F.col("lat"), F.col("lon"), 2.02 * radius, size))
            zone = mine(left).select(*fields, home.alias("home"), around.alias("at")).withColumn("kind", F.when(F.col("home") == F.col("at"), 0).otherwise(1)).drop("home")
            centre = mine(clusters).select(*fields, F.explode(grid_cover(F.col("lat"), F.col("lon"), 1.01 * radius, size)).alias("at"))
            both = zone.unionByName(centre)
            dealt = both if dealt is None else dealt.unionByName(both)
        dealt = dealt.select(*fields, F.col("at.cy").alias("cy"), F.col("at.cx").alias("cx"))
        new = written(dealt.groupBy("radius", "cy", "cx").applyInArrow(_settle, schema), "zones-settled")
        done = new.filter("kind = 0")
        settled = settled.unionByName(done)
        left = written(left.join(done.select("radius", "zone_id"), ["radius", "zone_id"], "left_anti"), "zones-left")
        moved = new.filter("kind = 2")
        clusters = written(clusters.join(moved.select("radius", "cluster"), ["radius", "cluster"], "left_anti").select(moved.columns).unionByName(moved), "zone-clusters")
    raise RuntimeError(f"running_clusters: zones are left after {rounds} rounds")


def corridor_passes(rows: DataFrame, before_m: float, after_m: float) -> DataFrame:
    """rows (trace, t, s): maximal runs inside [-before, after] that begin near one end and finish near the other."""
    w = Window.partitionBy("trace").orderBy("t")
    inside = F.col("s").between(-before_m, after_m)
    marked = rows.withColumn("run", F.sum(F.when(inside, 0).otherwise(1)).over(w)).filter(inside)
    runs = marked.groupBy("trace", "run").agg(F.min_by("s", "t").alias("s0"), F.max_by("s", "t").alias("s1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return runs.filter((F.col("s0") <= -before_m + 20) & (F.col("s1") >= after_m - 20)).select("trace", "t0", "t1")


def mined_scores(matches: DataFrame, by: str) -> DataFrame:
    """matches (by, in_gold, in_mined): precision, recall and F1."""
    both = F.count_if(F.col("in_gold") & F.col("in_mined"))
    n = matches.groupBy(by).agg(both.alias("tp"), F.count_if(F.col("in_mined")).alias("mined"), F.count_if(F.col("in_gold")).alias("gold"))
    return n.select(by, "tp", F.try_divide("tp", "mined").alias("precision"), F.try_divide("tp", "gold").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("mined") + F.col("gold")).alias("f1"))


def match_to_gold(mined: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """One-to-one by number within equal keys, in label order: (key, n, mined_id, gold_id), full outer."""
    number = lambda df, i: df.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(i)))
    return number(mined, "mined_id").join(number(gold, "gold_id"), [*key, "n"], "full")
