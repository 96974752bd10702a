"""Literal vectors and properties of functions and operators, files and streams."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.functions import belief, geo, rules
from hazardspark.operators import beliefs, events, fieldlog, graph, observations, rain, scoring, spatial, terrain
from hazardspark.operators.components import connected_components
from hazardspark.sources import files
from hazardspark.streaming import streams
from hazardspark.tables import written


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_belief_functions(spark):
    v = lambda c: value(spark, c)
    assert abs(v(belief.logit(F.lit(0.9))) - 2.1972245773) < 1e-9 and v(belief.logit(F.lit(1.0))) is None
    assert v(belief.kernel(F.lit(0.0))) == 1 and abs(v(belief.kernel(F.lit(75.0))) - math.exp(-1)) < 1e-12 and v(belief.kernel(F.lit(300.1))) == 0
    assert v(belief.reliability_weight(F.lit(0.5))) == 0 and v(belief.reliability_weight(F.lit(0.97))) == 1
    assert v(belief.pessimistic_wald(F.lit(0.5), F.lit(0.0), F.lit(2.0))) == 1
    assert abs(v(belief.v_safe_kmh(F.lit(0.0))) - 86.9448) < 1e-9 and v(belief.slowdown(F.lit(30.0), F.lit(0.0))) == 1
    assert v(belief.edge_cost(F.lit(100.0), F.lit(40.0), F.lit(0.5), F.lit(320.0), F.lit(1.0), F.lit(0.3), F.lit(300.0), F.lit(0.1))) is None
    assert v(belief.edge_cost(F.lit(100.0), F.lit(40.0), F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0), F.lit(0.3), F.lit(300.0), F.lit(0.1))) == 115


def test_beta_quantile_against_known_values():
    q = lambda a, b, p: float(beliefs.beta_quantile(np.array([a]), np.array([b]), np.array([p]))[0])
    assert abs(beliefs._normal_cdf(np.array([1.28]))[0] - 0.8997274) < 1e-6 and abs(beliefs._normal_cdf(np.array([2.0]))[0] - 0.9772499) < 1e-6
    assert abs(q(1.0, 1.0, 2.0) - 0.9772499) < 1e-6  # uniform
    assert abs(q(2.0, 1.0, 1.28) - math.sqrt(0.8997274)) < 1e-6
    assert abs(q(1.0, 3.0, 2.0) - (1 - (1 - 0.9772499) ** (1 / 3))) < 1e-6
    assert q(3.0, 5.0, 0.0) == 0.375
    x = np.linspace(0.05, 0.95, 7)
    cdf = lambda a, b, at=x: beliefs.beta_cdf(at, np.full(7, a), np.full(7, b))

    def closed(a, b, at):  # for a whole b
        terms = lambda u: sum(math.comb(b - 1, k) * (-1) ** k * u ** (a + k) / (a + k) for k in range(b))
        return terms(at) / terms(1.0)

    assert np.abs(cdf(0.5, 0.5) - 2 / np.pi * np.arcsin(np.sqrt(x))).max() < 1e-3
    assert np.abs(cdf(0.2, 3.0) - closed(0.2, 3, x)).max() < 1e-6
    assert np.abs(cdf(8.0, 0.4) - (1 - closed(0.4, 8, 1 - x))).max() < 1e-3
    grid = (np.arange(400_000) + 0.5) / 400_000
    dense = grid**29 * (1 - grid) ** 49
    assert np.abs(cdf(30.0, 50.0) - np.interp(x, grid, np.cumsum(dense) / dense.sum())).max() < 1e-4


def test_rules(spark):
    v = lambda c: value(spark, c)
    assert [v(rules.human_age(F.lit(s))) for s in (10, 120, 7200, 9000, 200000)] == ["just now", "2 min ago", "2 h ago", "2.5 h ago", "2 days ago"]
    lo, hi = rules.depth_cm(F.lit("1.5-2.5"))
    assert (v(lo), v(hi)) == (46, 76)
    assert v(rules.display_name(F.lit("Salem Highway"), F.lit("NH 544"))) == "Salem Highway (NH 544)" and v(rules.display_name(F.lit(None), F.lit("NH 44"))) == "NH 44"
    assert v(rules.csv_plain(rules.csv_safe(F.lit("=1+1")))) == "=1+1" and v(rules.csv_safe(F.lit("=1+1"))) == "'=1+1"
    assert str(v(rules.parse_day(F.lit("03-11-2015 14:05")))) == "2015-11-03" and v(rules.parse_day(F.lit("2015/11/03"))) is None
    assert v(rules.to_int(F.lit(" 12.0 "))) == 12 and v(rules.to_int(F.lit("x"))) is None
    assert v(rules.time_bin(F.lit(1704164400))) == "weekday_am_peak"  # 2024-01-02 03:00 UTC, 08:30 local
    assert v(rules.basin_label(F.lit(13.1))) == "Cooum" and v(rules.intensity_band(F.lit(7.6))) == "heavy"
    assert v(rules.uuid7_ms(rules.uuid7(F.lit(1704067200123), F.lit(77)))) == 1704067200123


def test_distances(spark):
    v = lambda *a: value(spark, geo.haversine_m(*map(F.lit, a)))
    assert abs(v(0.0, 0.0, 0.0, 1.0) - 111194.93) < 0.1
    assert abs(value(spark, geo.point_segment_m(*map(F.lit, (0.001, 0.5, 0.0, 0.0, 0.0, 1.0)))) - 111.32) < 1e-6
    assert abs(value(spark, geo.point_segment_m(*map(F.lit, (0.0, 2.0, 0.0, 0.0, 0.0, 1.0)))) - 111320) < 1


def observation(k, at, cls="flood", polarity=1, source="crowd", edge=1, d=0.0, depth=None):
    return (k, cls, polarity, f"2024-01-01 {at}", source, edge, d, depth)


OBS = "id long, hazard_class string, polarity int, observed_at string, source_class string, edge_id long, distance_m double, depth_mm double"


def obs_frame(spark, rows):
    return spark.createDataFrame(rows, OBS).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def test_fusion(spark):
    rows = [observation(1, "10:00:00"), observation(2, "08:00:00", polarity=-1, source="municipal_sensor", d=75.0), observation(3, "13:00:00"), observation(4, "09:00:00", d=301.0)]
    prior = spark.createDataFrame([(1, 0.2)], "edge_id long, prior_p double")
    h, s = config.hazards(spark), config.sources(spark)
    (got,) = beliefs.fuse_logodds(obs_frame(spark, rows), prior, h, s, "2024-01-01 12:00:00").collect()
    w1, w2 = math.exp(-1), math.exp(-1) * math.exp(-2)
    logit = lambda p: math.log(p / (1 - p))
    assert abs(got.logodds - (logit(0.2) + w1 * logit(0.6) - w2 * logit(0.97))) < 1e-9 and abs(got.n_eff - w1 - w2) < 1e-9 and got.n == 2
    (beta,) = beliefs.fuse_beta(obs_frame(spark, rows), prior, h, s, "2024-01-01 12:00:00").collect()
    signed = w1 * logit(0.6) / logit(0.97) - w2
    assert abs(beta.alpha - (0.4 + 2 * max(signed, 0))) < 1e-9 and abs(beta.n_eff - abs(signed)) < 1e-9


def test_dominant_class_ties(spark):
    rows = [observation(1, "10:00:00", "flood"), observation(2, "10:00:00", "closure"), observation(3, "10:00:00", "heat", edge=2), observation(4, "10:00:00", "aqi", edge=2), observation(5, "10:00:00", "heat", edge=3), observation(6, "10:00:00", "heat", edge=3), observation(7, "10:00:00", "flood", edge=3)]
    got = {r.edge_id: (r.hazard_class, r.dropped) for r in beliefs.dominant_class(obs_frame(spark, rows), config.hazards(spark)).collect()}
    assert got == {1: ("flood", 1), 2: ("aqi", 1), 3: ("heat", 1)}


def test_live_reports_after_clearing(spark):
    rows = [observation(1, "10:00:00"), observation(2, "11:00:00", polarity=-1), observation(3, "11:30:00"), observation(4, "06:00:00", edge=2), observation(5, "11:59:00", "accident"), observation(6, "12:30:00")]
    got = {r.id for r in observations.live_reports(obs_frame(spark, rows), config.hazards(spark), "2024-01-01 12:00:00").collect()}
    assert got == {3, 5}


def lattice(spark, n=6):
    edges = []
    for r in range(n):
        for c in range(n):
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < n and c + dc < n:
                    a, b = r * n + c, (r + dr) * n + c + dc
                    w = 1.0 + (a * 7 + b * 3) % 5
                    for x, y in ((a, b), (b, a)):
                        edges.append((len(edges), x, y, w, 10 + x // n / 100, 80 + x % n / 100, 10 + y // n / 100, 80 + y % n / 100))
    return spark.createDataFrame(edges, "edge_id long, from_node long, to_node long, cost double, lat1 double, lon1 double, lat2 double, lon2 double")


def test_shortest_costs_and_routes(spark):
    edges = lattice(spark)
    plain = {}
    for e in edges.collect():
        plain.setdefault(e.from_node, []).append((e.to_node, e.cost))
    best, todo = {0: 0.0}, [0]
    while todo:
        u = todo.pop(0)
        for v, w in plain[u]:
            if best[u] + w < best.get(v, 1e9):
                best[v] = best[u] + w
                todo.append(v)
    costs = graph.shortest_costs(edges, spark.createDataFrame([(0,)], "node long"), written)
    assert {r.node: r.cost for r in costs.collect()} == best
    pairs = spark.createDataFrame([(0, 35), (0, 0)], "source long, target long")
    step = {(u, v): w for u, rows in plain.items() for v, w in rows}
    for r in graph.routes(costs, edges, pairs, written).collect():
        assert r.path[0] == 0 and r.path[-1] == r.target and abs(sum(step[a, b] for a, b in zip(r.path, r.path[1:], strict=False)) - best[r.target]) < 1e-9


def test_nearest_edge_is_exact(spark):
    r = random.Random(1)
    edges = lattice(spark)
    points = spark.createDataFrame([(i, 10 + r.random() * 0.3 - 0.1, 80 + r.random() * 0.3 - 0.1) for i in range(40)], "id long, lat double, lon double")
    every = points.crossJoin(edges).withColumn("d", geo.point_segment_m(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]))
    want = {x.id: x.b[1] for x in every.groupBy("id").agg(F.min(F.struct("d", "edge_id")).alias("b")).collect()}
    got = {x.id: x.edge_id for x in spatial.nearest_edge(points, edges, written).collect()}
    assert got == want


def test_point_in_polygon_with_hole(spark):
    square = lambda k, o, s: [(1, k, i, o + dy * s, o + dx * s) for i, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]
    rings = spark.createDataFrame(square(0, 0.0, 1.0) + square(1, 0.4, 0.2), "region_id long, ring int, seq int, lat double, lon double")
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.5, 0.5), (3, 1.5, 0.5), (4, 0.3, 0.9)], "id long, lat double, lon double")
    assert {r.id for r in spatial.points_in_polygons(points, rings).collect()} == {1, 4}


def test_components_of_paths_and_cliques(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(50)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    r.shuffle(edges)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), written).collect()}
    assert got == {x: top(x) for x in got} and len(got) >= 301 + 50


def test_merge_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id long, v string, received_at long")
    b = spark.createDataFrame([(2, "z", 0), (3, "w", 5), (3, "late", 9)], "id long, v string, received_at long")
    once = observations.gset_merge(a, b)
    assert {(r.id, r.v) for r in once.collect()} == {(1, "x"), (2, "y"), (3, "w")}
    assert {(r.id, r.v) for r in observations.gset_merge(once, b).collect()} == {(1, "x"), (2, "y"), (3, "w")}


def test_scores(spark):
    df = spark.createDataFrame([(i, p, y) for i, (p, y) in enumerate([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])], "id long, score double, y int")
    assert scoring.auroc(df).first()["auroc"] == 0.75
    assert scoring.auroc(df.filter("y = 1")).first()["auroc"] is None
    b = scoring.brier_murphy(df).first()
    assert abs(b.brier - (0.01 + 0.16 + 0.4225 + 0.04) / 4) < 1e-12
    ties = spark.createDataFrame([(i, 0.5, i % 2) for i in range(10)], "id long, score double, y int")
    assert scoring.auroc(ties).first()["auroc"] == 0.5
    few = spark.createDataFrame([(i, i / 10, 1, "g") for i in range(5)], "id long, score double, y int, grp string")
    assert scoring.conformal_thresholds(few, 0.1).first()["tau"] is None and scoring.conformal_thresholds(few, 0.5).first()["tau"] == 0.2


def test_flow_and_fill(spark):
    bowl = [(r, c, float((r - 2) ** 2 + (c - 2) ** 2 + r * 0.01)) for r in range(5) for c in range(5)]
    grid = spark.createDataFrame(bowl, "row long, col long, elev double")
    acc = {(r.row, r.col): r.n for r in terrain.flow_accumulation(grid, written).collect()}
    assert acc[2, 2] == 25
    filled = {(r.row, r.col): r.fill for r in terrain.depression_fill(grid, written).collect()}
    rim = min(e for r, c, e in bowl if r in (0, 4) or c in (0, 4))
    assert filled[2, 2] == rim and all(filled[r, c] >= e for r, c, e in bowl)


def test_event_links_and_panel(spark):
    day = lambda rows: spark.createDataFrame(rows, "event_id long, district long, first_day string, last_day string").withColumns({k: F.col(k).cast("date") for k in ("first_day", "last_day")})
    a, b = day([(1, 1, "2020-01-30", "2020-02-02"), (2, 1, "2020-05-01", "2020-05-01")]), day([(9, 1, "2020-02-08", "2020-02-09"), (8, 1, "2020-02-09", "2020-02-09"), (7, 2, "2020-02-01", "2020-02-01")])
    assert {(r.a_id, r.b_id) for r in events.link_catalogues(a, b).collect()} == {(1, 9)}  # a gap of six days links, of seven does not


def test_field_log_and_state_holds(spark):
    levels = spark.createDataFrame([(0, 2), (3600 * 5, 0), (3600 * 7, 0), (3600 * 13, 0)], "t long, level int")
    assert [r.state for r in rain.state_holds(levels).orderBy("t").collect()] == [2, 2, 1, 0]
    log = spark.createDataFrame([("s_1", "passable", "knee", None, None, "2024-01-01 00:00:00"), ("adhoc", "unknown", None, 12.123456, 80.0, "2024-01-01 00:00:00"), ("adhoc", "unknown", None, 40.0, 80.0, "2024-01-01 00:00:00"), ("s_1", "unknown", None, None, None, "2023-12-01 00:00:00")], "site_id string, state string, depth_band string, lat double, lon double, observed_at string")
    got = fieldlog.validate_field_log(log.withColumn("observed_at", F.col("observed_at").cast("timestamp")), "2024-01-02 00:00:00").collect()
    assert [r.reason for r in got] == ["depth needs not_passable", None, "outside the region", "too old"] and got[1].lat == 12.1235


def test_readers(spark, tmp_path):
    (tmp_path / "p.kml").write_text("""<kml><Document><Placemark><name>A</name><ExtendedData><SchemaData><SimpleData name="risk">High</SimpleData></SchemaData></ExtendedData><Point><coordinates>80.1,13.0,0</coordinates></Point></Placemark>
    <Placemark><name>B</name><Polygon><outerBoundaryIs><LinearRing><coordinates>80,13 80.2,13 80.2,13.2 80,13.2</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>""")
    a, b = files.read_kml_placemarks(spark, str(tmp_path / "p.kml")).orderBy("name").collect()
    assert (a.lat, a.lon, round(b.lat, 9), len(b.points)) == (13.0, 80.1, 13.1, 4)
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"id": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"id": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}]}))
    got = files.read_geojson_features(spark, str(tmp_path / "g.json")).groupBy("properties.id", "part", "ring").count().collect()
    assert len(got) == 4 and {r["count"] for r in got} == {3}
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "nodes": [1, 2], "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}], "tags": {"highway": "primary"}}, {"type": "way", "id": 6, "nodes": [1], "geometry": [], "tags": {"highway": "x"}}]}))
    assert [(r.way, r.seq, r.node, r.lat) for r in files.read_overpass_ways(spark, str(tmp_path / "o.json")).orderBy("seq").collect()] == [(5, 1, 1, 1.0), (5, 2, 2, 3.0)]
    (tmp_path / "places.txt").write_text('["T Nagar", 13.04, 80.23, "suburb", "Thyagaraya", "TN"]\n["bad"]\nnot json\n["x", "y", 1, "k"]\n')
    assert [(r.name, r.alt) for r in files.read_places(spark, str(tmp_path / "places.txt")).collect()] == [("T Nagar", ["Thyagaraya", "TN"])]
    (tmp_path / "b.csv").write_text("﻿Nmae,b\n=x,1\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv_bom(spark, str(tmp_path / "b.csv"), {"Nmae": "name"}).select("name", "b").collect()] == [("=x", "1")]
    files.write_csv_safe(spark.createDataFrame([("=x", "plain"), ("-1", "a")], "a string, b string"), str(tmp_path / "safe"))
    assert {tuple(r) for r in files.read_csv_safe(spark, str(tmp_path / "safe")).collect()} == {("=x", "plain"), ("-1", "a")}
    (tmp_path / "f.json").write_text(json.dumps([{"latitude": 1.0, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [0.5, None]}}]))
    assert [r.mm for r in files.read_hourly_forecast(spark, str(tmp_path / "f.json")).orderBy("t").collect()] == [0.5, None]
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"><time>2024-01-01T00:00:05Z</time></trkpt><trkpt lat="1.5" lon="2"><time>2024-01-01T00:00:01Z</time></trkpt><trkpt lat="3" lon="2"><time>2024-01-01T00:00:05Z</time></trkpt></trkseg></trk></gpx>')
    assert [r.lat for r in files.read_gpx(spark, str(tmp_path / "t.gpx")).orderBy("t").collect()] == [1.5, 1.0]
    (tmp_path / "r.xml").write_text('<rss xmlns:georss="g" xmlns:gdacs="d"><channel><item><title>a</title><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><georss:point>13.1 80.2</georss:point><gdacs:country>India</gdacs:country></item><item><title>b</title><gdacs:country>Peru</gdacs:country></item><item><title>c</title></item></channel></rss>')
    assert [(r.title, r.lat) for r in files.read_alert_rss(spark, str(tmp_path / "r.xml"), "india").orderBy("title").collect()] == [("a", 13.1), ("c", None)]


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [("r", 3600 * t, 20.0 if t == 2 else 0.0, 0.0, None) for t in range(20)]
    df = spark.createDataFrame(rows, "region string, t long, acc_mm double, peak_mm_h double, manual double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.event_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r.state for r in spark.table("states").orderBy("t").collect()]
    assert got == [2 if 2 <= t <= 8 else 1 if 8 < t <= 14 else 0 for t in range(20)]
