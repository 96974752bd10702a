"""Spatial joins: by grid cell for ranges and nearest neighbours, by ring crossings for polygons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.geo import DEGREE_M, cell, grid_cell, grid_cover, haversine_m, point_segment_m


def _cells(lo: str, hi: str, size: float):
    return F.explode(F.sequence(cell(F.col(lo), size), cell(F.col(hi), size)))


def edge_cells(edges: DataFrame, size: float) -> DataFrame:
    """Edges dealt to every cell that the box around the segment touches."""
    box = edges.withColumns({"__s": F.least("lat1", "lat2"), "__n": F.greatest("lat1", "lat2"), "__w": F.least("lon1", "lon2"), "__e": F.greatest("lon1", "lon2")})
    return box.withColumn("cy", _cells("__s", "__n", size)).withColumn("cx", _cells("__w", "__e", size)).drop("__s", "__n", "__w", "__e")


def edges_near(points: DataFrame, edges: DataFrame, radius_m: float, size: float = 0.01) -> DataFrame:
    """All (point, edge) pairs within the radius: points are dealt to the cells their circle touches, edges to the cells of their box;
    a pair that meets in several cells is kept in its first. points: id, lat, lon."""
    d_lat, d_lon = radius_m / DEGREE_M * 1.001, F.lit(radius_m / DEGREE_M * 1.001) / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs("lat"))))
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("lon") - d_lon < -180, F.lit(360.0)), F.when(F.col("lon") + d_lon > 180, F.lit(-360.0))))
    p = points.withColumn("__lon", F.col("lon")).withColumn("__turn", F.explode(turns)).withColumn("lon", F.col("lon") + F.col("__turn"))
    p = p.withColumns({"__s": F.col("lat") - d_lat, "__n": F.col("lat") + d_lat, "__w": F.col("lon") - d_lon, "__e": F.col("lon") + d_lon})
    p = p.withColumn("cy", _cells("__s", "__n", size)).withColumn("cx", _cells("__w", "__e", size))
    e = edge_cells(edges.select("edge_id", "lat1", "lon1", "lat2", "lon2"), size)
    d = point_segment_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pairs = p.join(e, ["cy", "cx"]).withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)
    first_y = F.greatest(cell(F.col("__s"), size), cell(F.least("lat1", "lat2"), size))
    first_x = F.greatest(cell(F.col("__w"), size), cell(F.least("lon1", "lon2"), size))
    return pairs.filter((F.col("cy") == first_y) & (F.col("cx") == first_x)).withColumn("lon", F.col("__lon")).select(*points.columns, "edge_id", "distance_m")


def nearest_edge(points: DataFrame, edges: DataFrame, written: Callable[[DataFrame, str], DataFrame], start_m: float = 400.0, most_m: float = 500_000.0) -> DataFrame:
    """(id, edge_id, distance_m) of the nearest segment, ties to the lower edge; null for points with none within most_m. A ring of start_m
    settles most points exactly (whatever is nearer lies in it); the rest are tried again with four times the radius and cells to match.
    Rings close at 180 degrees."""
    radius, left, found = min(start_m, most_m), points.select("id", "lat", "lon"), None
    while True:
        near = edges_near(left, edges, radius, size=radius / DEGREE_M * 2)
        best = written(near.groupBy("id").agg(F.min(F.struct("distance_m", "edge_id")).alias("b")).select("id", "b.edge_id", "b.distance_m"), "nearest-edge")
        found = best if found is None else found.unionByName(best)
        left = written(left.join(best.select("id"), "id", "left_anti"), "nearest-left")
        if radius >= most_m or left.isEmpty():
            none = left.select("id", F.lit(None).cast(best.schema["edge_id"].dataType).alias("edge_id"), F.lit(None).cast("double").alias("distance_m"))
            return found.unionByName(none)
        radius = min(4 * radius, most_m)


def edges_within(points: DataFrame, edges: DataFrame, radius_m: float = 75.0, limit: int = 24, wider_m: float = 200.0, wider_limit: int = 4) -> DataFrame:
    """The nearest edges of each point within the radius; points without one get a few from a wider ring."""
    def top(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance_m", "edge_id"))).filter(F.col("rank") <= n)

    close = edges_near(points.select("id", "lat", "lon"), edges, radius_m)
    alone = points.select("id", "lat", "lon").join(close.select("id").distinct(), "id", "left_anti")
    return top(close, limit).unionByName(top(edges_near(alone, edges, wider_m), wider_limit)).select("id", "edge_id", "distance_m", "rank")


def points_near(points: DataFrame, places: DataFrame, radius_m: float, size: float | None = None, box: float | None = None) -> DataFrame:
    """All pairs of points (any columns; lat, lon) and places (key columns; plat, plon) within the radius, with distance_m, anywhere on the
    sphere: a place is dealt to the cells that its circle touches, a point lies in one. With `box`, both degrees as they are written also
    differ by less than that, which at high latitudes is less than the circle."""
    size = size or max(radius_m / DEGREE_M, 1e-6)
    a = points.withColumn("__c", grid_cell(F.col("lat"), F.col("lon"), size)).withColumns({"__cy": F.col("__c.cy"), "__cx": F.col("__c.cx")}).drop("__c")
    b = places.withColumn("__c", F.explode(grid_cover(F.col("plat"), F.col("plon"), radius_m, size))).withColumns({"__cy": F.col("__c.cy"), "__cx": F.col("__c.cx")}).drop("__c")
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    met = a.join(b, ["__cy", "__cx"])
    met = met if box is None else met.filter((F.abs(F.col("lat") - F.col("plat")) < box) & (F.abs(F.col("lon") - F.col("plon")) < box))
    return met.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m).drop("__cy", "__cx")


def nearest_point(points: DataFrame, places: DataFrame, radius_m: float, key: str, size: float | None = None, box: float | None = None) -> DataFrame:
    """points with the nearest place (key, distance_m) within the radius (and the box, as in `points_near`), ties to the lower key; null
    where there is none. places: key, lat, lon."""
    near = points_near(points.select("id", "lat", "lon"), places.select(key, F.col("lat").alias("plat"), F.col("lon").alias("plon")), radius_m, size, box)
    best = near.groupBy("id").agg(F.min(F.struct("distance_m", key)).alias("__b")).select("id", F.col(f"__b.{key}").alias(key), "__b.distance_m")
    return points.join(best, "id", "left")


_SIDE = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def _touching(sides, x0, y0, x1, y1):
    """The sides that meet the closed box."""

    def meets(s):
        across = lambda x, y: (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
        corners = [across(x, y) for x in (x0, x1) for y in (y0, y1)]
        beside = (F.greatest(s["x1"], s["x2"]) < x0) | (F.least(s["x1"], s["x2"]) > x1) | (F.greatest(s["y1"], s["y2"]) < y0) | (F.least(s["y1"], s["y2"]) > y1)
        return ~beside & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.filter(sides, meets)


def _crossed(sides, x0, y0, x, y):
    """How many sides the way from (x0, y0) up or down to y and then along to x crosses."""
    at_x0 = lambda s: s["y1"] + (x0 - s["x1"]) * (s["y2"] - s["y1"]) / (s["x2"] - s["x1"])
    at_y = lambda s: s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"])
    up = F.filter(sides, lambda s: F.when((s["x1"] > x0) != (s["x2"] > x0), (at_x0(s) > y0) != (at_x0(s) > y)).otherwise(False))
    along = F.filter(sides, lambda s: F.when((s["y1"] > y) != (s["y2"] > y), (at_y(s) > x) != (at_y(s) > x0)).otherwise(False))
    return F.size(up) + F.size(along)


def polygon_cover(rings: DataFrame, size: float, most: int) -> DataFrame:
    """(region_id, cy, cx, n, sy, sx, x0, y0, odd, sides): cells that cover the regions (rings: region_id, ring, seq, lat, lon).

    A region's sides are dealt to the cells of `size` degrees that they meet. A cell with more than `most` sides is cut into n by n parts
    (n follows from the number, at most 32), other cells have n = 1. Each part carries only its own sides and whether its south-west
    corner lies inside (`odd`, even-odd rule over all rings); parts without sides are wholly inside (those outside are left out).
    """
    w = Window.partitionBy("region_id", "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = Window.partitionBy("region_id", "ring").orderBy("seq")
    side = rings.select(
        "region_id", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.coalesce(F.lead("lon").over(step), F.first("lon").over(w)).alias("x2"), F.coalesce(F.lead("lat").over(step), F.first("lat").over(w)).alias("y2")
    )
    box = side.withColumns({"lo_x": F.least("x1", "x2"), "hi_x": F.greatest("x1", "x2"), "lo_y": F.least("y1", "y2"), "hi_y": F.greatest("y1", "y2")})
    # a side on the border of two cells belongs to both
    low = lambda c: F.ceil(F.col(c) / size).cast("long") - 1
    dealt = box.withColumn("cy", F.explode(F.sequence(low("lo_y"), cell(F.col("hi_y"), size)))).withColumn("cx", F.explode(F.sequence(low("lo_x"), cell(F.col("hi_x"), size))))
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    one = F.struct("x1", "y1", "x2", "y2")
    dealt = dealt.withColumn("s", _touching(F.array(one), x0, y0, x0 + size, y0 + size)).filter("size(s) = 1")
    edge = dealt.groupBy("region_id", "cy", "cx").agg(F.collect_list(one).alias("sides"))

    # sides that cross a row's lower line, by the column behind which they do
    lines = box.withColumn("cy", F.explode(F.sequence(cell(F.col("lo_y"), size), cell(F.col("hi_y"), size)))).withColumn("y", F.col("cy") * size).filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = lines.groupBy("region_id", "cy", (F.ceil(at / size).cast("long") - 1).alias("cx")).agg(F.count("*").alias("k"))
    span = edge.groupBy("region_id", "cy").agg(F.min("cx").alias("a"), F.max("cx").alias("b")).withColumn("cx", F.explode(F.sequence("a", "b"))).drop("a", "b")
    marks = span.withColumns({"k": F.lit(0).cast("long"), "own": F.lit(True)}).unionByName(crossings.withColumn("own", F.lit(False)))
    right = Window.partitionBy("region_id", "cy").orderBy(F.desc("cx")).rangeBetween(Window.unboundedPreceding, 0)
    odd = marks.withColumn("odd", F.sum("k").over(right) % 2 == 1).filter("own").select("region_id", "cy", "cx", "odd")
    cells = odd.join(edge, ["region_id", "cy", "cx"], "left").withColumn("sides", F.coalesce("sides", F.expr(f"CAST(array() AS {_SIDE})"))).filter("odd OR size(sides) > 0")

    n = F.when(F.size("sides") > most, F.least(F.lit(32), F.ceil(F.size("sides") / most).cast("int") + 1)).otherwise(1)
    cells = cells.withColumns({"n": n, "x0": x0, "y0": y0})
    parts = cells.withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    h = F.lit(size) / F.col("n")
    px, py = F.col("x0") + F.col("sx") * h, F.col("y0") + F.col("sy") * h
    own = F.when(F.col("n") == 1, F.col("sides")).otherwise(_touching(F.col("sides"), px - 1e-12, py - 1e-12, px + h + 1e-12, py + h + 1e-12))
    inside = F.when(F.col("n") == 1, F.col("odd")).otherwise((F.col("odd").cast("int") + _crossed(F.col("sides"), F.col("x0"), F.col("y0"), px, py)) % 2 == 1)
    parts = parts.select("region_id", "cy", "cx", "n", "sy", "sx", px.alias("px"), py.alias("py"), inside.alias("inside"), own.alias("own")).filter("inside OR size(own) > 0")
    return parts.withColumnsRenamed({"px": "x0", "py": "y0", "inside": "odd", "own": "sides"})


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float = 0.05, most: int = 32) -> DataFrame:
    """(id, region_id) of points inside a region by the even-odd rule over all its rings, so holes and several parts count right.
    rings: region_id, ring, seq, lat, lon. A point meets one part of each region whose cells hold it: in a part without sides it is inside,
    else the sides of that part decide (about `most`), however many the region has. Regions over 180 degrees are not joined up."""
    cover = polygon_cover(rings, size, most)
    p = points.select("id", F.col("lat").alias("y"), F.col("lon").alias("x"), cell(F.col("lat"), size).alias("cy"), cell(F.col("lon"), size).alias("cx"))
    cuts = cover.select("region_id", "cy", "cx", "n").distinct()
    part = lambda v, c: F.least(F.col("n") - 1, F.greatest(F.lit(0), F.floor((F.col(v) - F.col(c) * size) / size * F.col("n")))).cast("int")
    at = p.join(cuts, ["cy", "cx"]).withColumns({"sy": part("y", "cy"), "sx": part("x", "cx")})
    met = at.join(cover.drop("n"), ["region_id", "cy", "cx", "sy", "sx"])
    inside = (F.col("odd").cast("int") + _crossed(F.col("sides"), F.col("x0"), F.col("y0"), F.col("x"), F.col("y"))) % 2 == 1
    return met.filter(F.when(F.size("sides") == 0, F.col("odd")).otherwise(inside)).select("id", "region_id")


def nearest_by_day(obs: DataFrame, gauges: DataFrame, max_km: float = 10.0) -> DataFrame:
    """(id, gauge, mm, km): the nearest gauge with a reading on the observation's day. gauges: gauge, lat, lon, day, mm. Gauges are dealt
    to the nine cells around them, so an observation meets those of its day nearby only."""
    size = max_km / 108.4 * 1.05  # degrees, by the shorter of the two scales
    shift = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    g = gauges.withColumn("__dy", shift).withColumn("__dx", shift)
    g = g.withColumns({"cy": cell(F.col("lat"), size) + F.col("__dy"), "cx": cell(F.col("lon"), size) + F.col("__dx")}).alias("g")
    o = obs.withColumns({"cy": cell(F.col("lat"), size), "cx": cell(F.col("lon"), size)}).alias("o")
    km = F.hypot((F.col("g.lat") - F.col("o.lat")) * 111.32, (F.col("g.lon") - F.col("o.lon")) * 108.4)
    same = (F.col("o.day") == F.col("g.day")) & (F.col("o.cy") == F.col("g.cy")) & (F.col("o.cx") == F.col("g.cx"))
    near = o.join(g, same).withColumn("km", km).filter(F.col("km") <= max_km)
    return near.groupBy(F.col("o.id").alias("id")).agg(F.min(F.struct("km", F.col("g.gauge").alias("gauge"), F.col("g.mm").alias("mm"))).alias("b")).select("id", "b.gauge", "b.mm", "b.km")


def nearest_area(points: DataFrame, places: DataFrame, familiar: list[str], familiar_m: float = 1200.0, any_m: float = 2000.0) -> DataFrame:
    """(id, place_id, distance_m): the nearest place of a familiar kind within familiar_m, else the nearest of any kind within any_m, else
    null. places: place_id, kind, lat, lon."""
    known = nearest_point(points, places.filter(F.col("kind").isin(*familiar)), familiar_m, "place_id").select("id", F.col("place_id").alias("__p"), F.col("distance_m").alias("__d"))
    other = nearest_point(points, places, any_m, "place_id").select("id", "place_id", "distance_m")
    first = lambda a, b: F.when(F.col("__p").isNotNull(), F.col(a)).otherwise(F.col(b))
    return known.join(other, "id").select("id", first("__p", "place_id").alias("place_id"), first("__d", "distance_m").alias("distance_m"))


def station_climate(daily: DataFrame) -> DataFrame:
    """(station, lat, lon, annual_mm, wet_p95): rain of a mean year, and the 95th percentile of days with 1 mm or more. daily: station,
    lat, lon, mm."""
    wet = F.when(F.col("mm") >= 1, F.col("mm"))
    return daily.groupBy("station").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), (F.avg("mm") * 365.25).alias("annual_mm"), F.percentile(wet, 0.95).alias("wet_p95"))


def nearest_station_climate(points: DataFrame, stations: DataFrame, max_km: float = 150.0) -> DataFrame:
    """points (id, lat, lon) with the climate of the nearest station; null where that is too far."""
    near = nearest_point(points, stations, max_km * 1000, "station")
    return near.join(stations.select("station", "annual_mm", "wet_p95"), "station", "left")
