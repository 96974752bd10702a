"""Name similarity, matches without ids, place search, the grid on the sphere, polygon covers and moving clusters against plain loops."""

import difflib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.functions.geo import grid_cell, grid_cover
from hazardspark.operators import matching, search, spatial, studies
from hazardspark.plans import queries
from hazardspark.plans.q_search import mined_records
from hazardspark.plans.registry import Tables
from hazardspark.tables import written
from tests.test_plain import metres


@pytest.mark.parametrize("letters", ["ab", "abcdef ", "abcdefghijklmnopqrstuvwxyzé "])
def test_ratio_is_the_standard_one(letters):
    draw = random.Random(1)
    for trial in range(400):
        top = 500 if trial % 40 == 0 else 40
        a, b = ("".join(draw.choice(letters) for _ in range(draw.randint(0, top))) for _ in range(2))
        if trial % 3 == 0 and a:
            at = draw.randrange(len(a))
            b = a[:at] + draw.choice(letters) + a[at + draw.randint(0, 4) :]
        want = difflib.SequenceMatcher(None, a, b).ratio()
        got = 2 * matching.matched_letters(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert got == want, (a, b)


def key(text):
    t = "".join(x if x.isalnum() or unicodedata.category(x).startswith("M") else " " for x in (text or "").lower())
    return " ".join(t.split())


def test_lexical_scores(spark):
    pairs = [("Ganesapuram", ["Ganesapuram Subway", "x"]), ("the main road", ["Main Road"]), ("", ["a"]), (None, ["a"]), ("Anna Nagar rd", ["Annanagar", "ANNA-NAGAR"]), ("lake", []), ("lake", ["pond", None]), ("lake", ["pond", None])]

    def score(q, names):
        short = lambda k: " ".join(w for w in k.split() if w not in matching.GENERIC)
        best = 0.0
        for n in names:
            for a, b in ((key(q), key(n)), (short(key(q)), short(key(n)))):
                if a and b:
                    s = difflib.SequenceMatcher(None, a, b).ratio()
                    best = max(best, 1.0 if a == b else max(s, 0.9) if f" {b} " in f" {a} " or f" {a} " in f" {b} " else s)
        return best

    got = matching.lexical_scores(spark.createDataFrame(pairs, "q string, names array<string>"), "q", "names").collect()
    assert sorted((str(r.q), str(r.names), round(r.score, 9)) for r in got) == sorted((str(q), str(n), round(score(q, n), 9)) for q, n in pairs)


def test_lexical_query(spark, sf_dir):
    rows = {r.p_partkey: r.score for r in queries()["f22_lexical_score"](spark, sf_dir).collect()}
    assert len(rows) == Tables(spark, sf_dir).part.count() - 1 and 0 <= min(rows.values()) < max(rows.values()) <= 1


def one_by_one(gold, mined):
    used, pairs = set(), []
    inside = lambda a, b: bool(a and b) and (a in b or b in a)
    for g in sorted(gold, key=lambda r: (r.at, r.id)):
        for m in sorted((m for m in mined if m.item == g.item and m.condition == g.condition), key=lambda r: (r.at, r.id)):
            same = m.place_id == g.place_id if g.place_id is not None else m.place_id is None and inside(key(g.place_text), key(m.place_text))
            if m.id not in used and same:
                used.add(m.id)
                pairs.append((g.id, m.id))
                break
    return pairs


def test_matches_without_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gold, mined = (df.collect() for df in mined_records(t))
    want = one_by_one(gold, mined)
    got = [tuple(r) for r in queries()["x3_match_by_text"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    texts = {r.id: r for r in [*gold, *mined]}
    assert sum(texts[a].place_id is None for a, _ in want) > 20
    for r in queries()["x4_miner_scores_by_text"](spark, sf_dir).collect():
        tp = sum(texts[a].condition == r.condition for a, _ in want)
        n = [sum(x.condition == r.condition for x in side) for side in (gold, mined)]
        assert r.tp == tp and abs(r.f1 - 2 * tp / sum(n)) < 1e-6


def test_long_chains_of_refused_records(spark):
    """All want the first mined record, so each but the earliest goes on down its list."""
    rows = [(g, m, 30 - g, m) for g in range(30) for m in range(30) if m <= g]
    df = spark.createDataFrame(rows, "gold_id long, mined_id long, gold_at long, mined_at long")
    used, want = set(), []
    for g in sorted(range(30), key=lambda g: 30 - g):
        m = next((m for m in range(g + 1) if m not in used), None)
        if m is not None:
            used.add(m)
            want.append((g, m))
    assert sorted(tuple(r) for r in matching.one_to_one(df, written).collect()) == sorted(want)


def test_place_search(spark):
    draw = random.Random(6)
    words = ["anna", "nagar", "lake", "ann", "road", "nh 44", "NH-444", "nh44", "st. mary", "é rue", "a", "44", "4"]
    places = [(k, [" ".join(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 2))], draw.choice(["city", "town", "street", "village", "stop", None]), 13 + draw.random(), 80 + draw.random(), draw.randrange(9)) for k in range(150)]
    asked = [(k, q, 13.5 if k % 2 else None, 80.5 if k % 2 else None) for k, q in enumerate(["anna", "Anna  Nagar!", "nagar an", "nh44", "NH 44", "nh 44 road", "44", "4", "a", "", "ro", "lake lake", "St Mary", "rue é", "zzz", "nh 4", "e", "an ro la"])]
    clean = lambda s: re.sub(r"\s+", " ", "".join(x if x.isalnum() or x.isspace() or unicodedata.category(x).startswith("M") else " " for x in s.lower())).strip()

    def rank(name, q):
        tight = clean(name).replace(" ", "")
        number = re.search(re.escape(q.replace(" ", "")) + r"(?!\d)", tight) if re.search(r"\d", q) else None
        name = clean(name)
        if name == q:
            return -1
        if name.startswith(q):
            return 0
        if all(w in name for w in q.split(" ")):
            return 1 if not re.search(r"\d", q) or number or " " not in q else None
        return 1 if number else None

    want = []
    for i, q, lat, lon in asked:
        q = clean(q)
        rows = []
        for p, names, kind, plat, plon, size in places if len(q) >= 2 else []:
            r = min((x for x in (rank(n, q) for n in names) if x is not None), default=None)
            if r is not None:
                d = None if lat is None else math.hypot((plon - lon) * 111320 * math.cos(math.radians(lat)), (plat - lat) * 110574)
                rows.append((r, search.TIERS.get(kind, 5), d or 0.0, -size, names[0], p))
        want += [(i, x[5], k, x[0], x[1]) for k, x in enumerate(sorted(rows)[:8], 1)]
    got = search.search_places(spark.createDataFrame(asked, "query_id long, q string, lat double, lon double"), spark.createDataFrame(places, "place_id long, names array<string>, kind string, lat double, lon double, size long"))
    assert sorted((r.query_id, r.place_id, r["rank"], r.name_rank, r.tier) for r in got.collect()) == sorted(want) and len(want) > 80


PLACES = [(0.0, 10.0), (34.0, -118.0), (70.0, 25.0), (-45.0, 179.99), (89.7, 0.0), (10.0, -180.0), (-89.99, 77.0)]


@pytest.mark.parametrize("radius", [900.0, 150_000.0])
def test_pairs_anywhere_on_the_sphere(spark, radius):
    draw = random.Random(int(radius))
    spread = radius / 111_000 * 1.5
    near = lambda n: [(100 * k + j, max(-90.0, min(90.0, lat + draw.uniform(-spread, spread))), (lon + draw.uniform(-1, 1) * spread / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180) for k, (lat, lon) in enumerate(PLACES) for j in range(n)]
    points, places = near(25), near(12)
    want = {}
    for i, *p in points:
        d, k = min(((metres(p, q), j) for j, *q in places), default=(math.inf, 0))
        want[i] = k if d <= radius else None
    a, b = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "station long, lat double, lon double")
    got = {r.id: r.station for r in spatial.nearest_point(a, b, radius, "station").collect()}
    assert got == want and sum(v is None for v in want.values()) > 3 and len(set(want.values())) > 20
    pairs = {(r.link, r.other) for r in studies.link_neighbours(a.withColumnRenamed("id", "link"), radius).collect()}
    assert pairs == {(i, j) for i, *p in points for j, *q in points if i != j and metres(p, q) <= radius}


def test_cover_holds_every_cell_of_a_circle(spark):
    rows = [(lat, lon) for lat, lon in PLACES]
    df = spark.createDataFrame(rows, "lat double, lon double")
    own = df.select(F.array_contains(grid_cover(F.col("lat"), F.col("lon"), 5000.0, 0.05), grid_cell(F.col("lat"), F.col("lon"), 0.05)).alias("x"), F.size(grid_cover(F.col("lat"), F.col("lon"), 5000.0, 0.05)).alias("n"), F.size(F.array_distinct(grid_cover(F.col("lat"), F.col("lon"), 5000.0, 0.05))).alias("m")).collect()
    assert all(r.x and r.n == r.m for r in own)


def test_points_far_from_all_edges_have_a_row(spark):
    edges = spark.createDataFrame([(1, 10.0, 179.95, 10.0, 179.99), (2, 10.5, 20.0, 10.5, 20.1)], "edge_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    points = spark.createDataFrame([(1, 10.0, -179.99), (2, 10.6, 20.05), (3, -60.0, 100.0), (4, 12.0, 21.0)], "id long, lat double, lon double")
    got = {r.id: (r.edge_id, r.distance_m) for r in spatial.nearest_edge(points, edges, written).collect()}
    assert {i: e for i, (e, _) in got.items()} == {1: 1, 2: 2, 3: None, 4: 2} and got[3][1] is None and 2000 < got[1][1] < 2300


@pytest.mark.parametrize(("size", "most"), [(0.05, 32), (0.5, 4)])
def test_polygon_cover_gives_the_rows_of_the_even_odd_rule(spark, size, most):
    draw = random.Random(8)
    rings = []
    for region in range(5):
        for ring in range(2):
            n, r = (90, 0.4) if ring == 0 else (20, 0.1)
            cy, cx = 0.2 * region, 0.3 * (region % 3)
            rings += [(region, ring, k, cy + r * draw.uniform(0.5, 1) * math.sin(2 * math.pi * k / n), cx + r * draw.uniform(0.5, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    rings += [(9, 0, k, y, x) for k, (y, x) in enumerate([(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 0.0)])]  # sides on borders of cells
    points = [(i, draw.uniform(-0.6, 1.4), draw.uniform(-0.6, 1.2)) for i in range(1500)]
    want = set()
    for i, y, x in points:
        for region in {r[0] for r in rings}:
            odd = False
            for ring in (0, 1):
                own = [(r[3], r[4]) for r in rings if r[:2] == (region, ring)]
                for (y1, x1), (y2, x2) in zip(own, own[1:] + own[:1]):
                    odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            if odd:
                want.add((i, region))
    a, b = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(rings, "region_id long, ring int, seq int, lat double, lon double")
    assert {tuple(r) for r in spatial.points_in_polygons(a, b, size, most).collect()} == want and len(want) > 300
    assert spatial.polygon_cover(b, size, most).agg(F.max(F.size("sides"))).first()[0] <= 6 * most


def plain_clusters(zones, radius):
    clusters, of = [], {}
    for i, lat, lon, area in sorted(zones, key=lambda z: (-z[3], z[0])):
        best = None
        for c in clusters:
            d = metres((lat, lon), (c["lat"], c["lon"]))
            if d <= (radius if best is None else best[0]):
                best = (d, c)
        if best is None:
            clusters.append({"id": i, "lat": lat, "lon": lon, "area": area, "n": 1})
            of[i] = i
        else:
            c = best[1]
            total = c["area"] + area
            if total > 0:
                c["lat"], c["lon"] = (c["lat"] * c["area"] + lat * area) / total, (c["lon"] * c["area"] + lon * area) / total
            c["area"], c["n"] = total, c["n"] + 1
            of[i] = c["id"]
    return of, {c["id"]: c for c in clusters}


@pytest.mark.parametrize("lat", [60.0])
def test_running_clusters(spark, lat):
    draw = random.Random(11)
    zones = [(i, lat + draw.uniform(0, 0.5), 80 + draw.uniform(0, 0.8), float(draw.choice([0, 1, 1, 2, 5, 9, draw.uniform(0, 10)]))) for i in range(260)]
    zones += [(300 + i, lat + 0.25 + draw.uniform(0, 0.004), 80.4 + draw.uniform(0, 0.004), draw.uniform(0, 3)) for i in range(120)]  # a dense place
    zones += [(500, zones[0][1], zones[0][2], zones[0][3])]
    df = spark.createDataFrame([*zones, (900, None, 80.0, 1.0)], "zone_id long, lat double, lon double, area double")
    got, centres = studies.running_clusters(df, [500.0, 3000.0], written)
    got, centres = got.collect(), centres.collect()
    for radius in (500.0, 3000.0):
        of, clusters = plain_clusters(zones, radius)
        assert {r.zone_id: r.cluster for r in got if r.radius == radius} == of
        for r in centres:
            if r.radius == radius:
                c = clusters.pop(r.cluster)
                assert abs(r.lat - c["lat"]) < 1e-9 and abs(r.lon - c["lon"]) < 1e-9 and abs(r.area - c["area"]) < 1e-6 and r.members == c["n"]
        assert not clusters


def test_running_clusters_query(spark, sf_dir):
    zones = [tuple(r) for r in Tables(spark, sf_dir).zones.select("zone_id", "lat", "lon", "area").collect()]
    got = queries()["m28_running_clusters"](spark, sf_dir).collect()
    for radius in (1000.0, 3000.0, 6000.0):
        assert {r.zone_id: r.cluster for r in got if r.radius == radius} == plain_clusters(zones, radius)[0]


@pytest.mark.parametrize(("spread", "unit"), [(0.05, 4096), (0.05, 30), (3.0, 50)])
def test_nearest_vectors_by_pivots(spark, spread, unit):
    from hazardspark.operators import textchecks

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 500)] + spread * rng.normal(size=(500, 12))
    rows = [(i, [float(v) for v in x[i]]) for i in range(500)] + [(600 + i, [float(v) for v in x[0]]) for i in range(40)] + [(700, None), (701, [0.0] * 12)]
    places = spark.createDataFrame(rows, "place_id long, embedding array<double>")
    queries = places.filter("place_id % 20 = 0").selectExpr("place_id AS query", "embedding AS asked")
    got, stats = textchecks.vector_top_k_by_pivots(places, queries, 7, written, pivots=10, unit=unit)
    want = textchecks.vector_top_k(places, queries, 7)
    assert sorted((r.query, r.id, r["rank"]) for r in got.collect()) == sorted((r.query, r.id, r["rank"]) for r in want.collect())
    stats = stats.first()
    assert stats.pairs == 541 * 28 or stats.pairs > 10_000
    assert stats.compared <= stats.pairs and (spread > 1 or stats.compared < 0.5 * stats.pairs)
