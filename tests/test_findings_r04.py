"""Cases of the findings of round 4."""

import math
import random
from datetime import date, timedelta

from pyspark.sql.functions import col as c
from pyspark.sql.functions import expr

from hazardspark.operators import beliefs, events, graph, matching, paths, places, search, spatial, studies, terrain, textchecks
from hazardspark.operators.components import connected_components
from hazardspark.tables import written


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_polygons_are_not_dealt_out_again(spark):
    square = [(9, 0, 0, 0.0, 0.0), (9, 0, 1, 0.0, 1.0), (9, 0, 2, 1.0, 1.0), (9, 0, 3, 1.0, 0.0)]
    rings = spark.createDataFrame(square, "region_id long, ring int, seq int, lat double, lon double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "district long, lat double, lon double")
    row = "event_id long, {} long, first_day date, last_day date"
    a = spark.createDataFrame([(1, 1, date(2024, 1, 30), date(2024, 2, 20)), (2, 2, date(2024, 1, 30), date(2024, 2, 20)), (3, 1, date(2024, 5, 1), date(2024, 5, 1))], row.format("district"))
    areas = spark.createDataFrame([(7, 9, date(2024, 1, 1), date(2024, 3, 1)), (8, 9, date(2024, 4, 25), date(2024, 4, 25)), (8, 9, date(2024, 4, 24), date(2024, 4, 24))], row.format("region_id"))
    got = events.link_by_polygon(a, areas, points, rings)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, 1), (3, 8, 1)]
    assert "Aggregate" not in plan(got).split("a_lo")[0]  # above the join of the two catalogues


def catalogue(spark, rows):
    return spark.createDataFrame(rows, "event_id long, district long, first_day date, last_day date")


def test_clusters_by_days_equal_clusters_of_links(spark):
    draw = random.Random(4)
    for n in (40, 120):
        sides = []
        for _ in range(2):
            days = [date(2024, 1, 1) + timedelta(draw.randrange(1500)) for _ in range(n)]
            rows = [(k, draw.randrange(3), d, d + timedelta(draw.choice([0, 0, 2, 9, 40]))) for k, d in enumerate(days)]
            rows += [(1, 2, date(2024, 3, 1), date(2024, 3, 9)), (2, None, date(2024, 3, 1), date(2024, 3, 9)), (n, 1, None, date(2024, 3, 9))]
            sides.append(catalogue(spark, rows))
        find = lambda e: connected_components(e, written)
        want = events.calendar_clusters(*sides, events.link_catalogues(*sides), find)
        got = events.calendar_clusters_by_days(*sides, find, written)
        key = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert key(got) == key(want)


def test_clusters_by_days_do_not_make_the_links(spark):
    rows = [(k, 1, date(2024, 1, 1), date(2024, 1, 1)) for k in range(6000)]  # 36 million links
    made = []
    got = events.calendar_clusters_by_days(catalogue(spark, rows), catalogue(spark, rows), lambda e: made.append(e.count()) or connected_components(e, written), written).collect()
    assert made == [0] and [(r.n_a, r.n_b) for r in got] == [(6000, 6000)]


def test_config_of_edges_is_no_union(spark):
    prior = spark.createDataFrame([(1, 0.3), (2, 0.3), (3, 0.1), (4, 0.3), (5, 0.1)], "edge_id long, prior_p double")
    seen = spark.createDataFrame([(1, "flood"), (3, "debris"), (3, "debris"), (3, "flood"), (4, "unheard of")], "edge_id long, hazard_class string")
    hazards = spark.createDataFrame([("flood", 1.0), ("debris", 0.5)], "hazard_class string, severity double")
    got = beliefs.hazard_config(seen, prior, hazards)
    assert sorted((r.edge_id, r.hazard_class, r.n, r.observed) for r in got.collect()) == [(1, "flood", 1, True), (2, "flood", 0, False), (3, "debris", 2, True)]
    assert "Union" not in plan(got)


def test_searches_in_blocks_equal_searches_by_rounds(spark, monkeypatch):
    draw = random.Random(5)
    edges = [(v, draw.randrange(40), draw.randrange(40), draw.choice([1.0, 1.5, 2.0, None])) for v in ("a", "b") for _ in range(130)]
    edges = spark.createDataFrame(edges, "kind string, from_node long, to_node long, cost double")
    sources = spark.createDataFrame([(k,) for k in (0, 3, 7, 99)], "node long")  # 99 is on no edge
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())
    costs = written(graph.shortest_costs(edges, sources, written, by=("kind",)), "test-costs")
    pairs = costs.select("source", c("node").alias("target")).filter("source < target OR source = 99").distinct()
    want = rows(costs.select("kind", "source", "node", "cost")), rows(graph.routes(costs, edges, pairs, written, by=("kind",)).select("kind", "source", "target", "path").filter("source < 99"))
    hops = rows(graph.reachable(edges, sources, written))
    for most, block in ((1 << 22, 1 << 24), (1 << 22, 50), (5, 50)):  # all sources in a block, one in a block, by rounds
        monkeypatch.setattr(paths, "MOST_EDGES", most)
        monkeypatch.setattr(paths, "BLOCK", block)
        found = paths.paths_of(edges, pairs, written, by=("kind",))
        assert rows(paths.costs_from(edges, sources, written, by=("kind",))) == want[0]
        assert rows(found.filter("source < 99")) == want[1]
        assert rows(paths.hops_from(edges, sources, written)) == hops


def test_paths_over_edges_without_cost(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0), (2, 3, 0.0), (3, 2, 0.0)], "from_node long, to_node long, cost double")
    got = paths.paths_from(edges, spark.createDataFrame([(0,)], "node long"), written).collect()
    assert {r.target: r.path for r in got} == {0: [0], 1: [0, 1], 2: [0, 1, 2], 3: [0, 1, 2, 3]}


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(max(0.0, h)))


def test_places_with_latitudes_beyond_a_pole(spark):
    draw = random.Random(6)
    some = lambda n: [(k, draw.choice([13, 89.97, 90, 120, 180, 269.98, 293]) + draw.uniform(-0.05, 0.05), 80 + draw.uniform(-0.1, 0.1)) for k in range(n)]
    points, places = some(200), some(200)
    a = spark.createDataFrame(points, "id long, lat double, lon double")
    b = spark.createDataFrame(places, "place long, plat double, plon double")
    near = {(p[0], q[0]) for p in points for q in places if metres(p, q) <= 2000}
    assert {(r.id, r.place) for r in spatial.points_near(a, b, 2000.0).collect()} == near
    boxed = {(i, j) for i, j in near if abs(points[i][1] - places[j][1]) < 0.02 and abs(points[i][2] - places[j][2]) < 0.02}
    assert 0 < len(boxed) < len(near) and {(r.id, r.place) for r in spatial.points_near(a, b, 2000.0, box=0.02).collect()} == boxed
    best = {i: min((metres(points[i], places[j]), j) for k, j in boxed if k == i)[1] for i in {i for i, _ in boxed}}
    got = spatial.nearest_point(a, b.withColumnsRenamed({"plat": "lat", "plon": "lon"}), 2000.0, "place", box=0.02)
    assert {r.id: r.place for r in got.collect()} == {p[0]: best.get(p[0]) for p in points}
    edges = a.selectExpr("id AS edge_id", "lat AS lat1", "lat AS lat2", "lon AS lon1", "lon AS lon2")
    zones = b.selectExpr("plat AS lat", "plon AS lon", "0.5D AS p")
    count = {p[0]: sum(i == p[0] for i, _ in boxed) for p in points}
    assert {r.edge_id: r.n_zones for r in beliefs.zone_prior(edges, zones, 2000.0, box=0.02).collect()} == count


def test_records_match_as_their_candidates_do(spark):
    draw = random.Random(7)
    texts = ["North Gate", "gate", "the north gate road", "No. 4", "4", "", None, "lake"]
    for n in (30, 200):
        one = lambda k: (k, draw.choice([1, 1, 2, None]), draw.choice(["x", "y", "y", None]), draw.choice([draw.randrange(20), None]), draw.choice([1, 2, None, None, None]), draw.choice(texts))
        gold, mined = (spark.createDataFrame([one(k) for k in range(s, s + n)], "id long, item long, condition string, at long, place_id long, place_text string") for s in (0, 1000))
        want = matching.one_to_one(matching.match_candidates(mined, gold), written)
        got = matching.match_records(mined, gold, written)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_records_of_one_item_match_in_one_pass(spark):
    rows = lambda s: spark.range(s, s + 20000).selectExpr("id", "1L AS item", "'x' AS condition", "id AS at", "CAST(NULL AS BIGINT) AS place_id", "'gate' AS place_text")
    made = []
    got = matching.match_records(rows(50000), rows(0), lambda df, name: made.append(name) or written(df, name)).collect()  # 400 million candidates
    assert made == ["match-records", "match-links"] and {(r.gold_id, r.mined_id) for r in got} == {(k, k + 50000) for k in range(20000)}


def test_places_that_ask_the_same_are_one_question(spark):
    asked = spark.createDataFrame([(k, "atown", s, 1) for k in range(3) for s in ("Bihar",)] + [(3, "atown", None, 1), (4, None, "Bihar", 1), (5, "btown", "Goa", 2)], "id long, name string, state string, r long")
    found = spark.createDataFrame([(1, 10, "A Town", "bihar", None, "PPL", 5), (1, 11, "x", "Bihar", "atown", "PPL", 3), (1, 12, "x", "Jharkhand", "A TOWN", "PPLA", None), (2, 13, "b", None, None, None, 1)], "r long, candidate long, name string, admin1 string, admin2 string, feature_code string, population long")
    take = lambda relaxed: {r.id: r.candidate for r in places.choose_geocode(asked, found, relaxed, on="r").collect()}
    assert take(False) == {0: 11, 1: 11, 2: 11, 3: None, 4: 10, 5: None}
    assert take(True) == {0: 12, 1: 12, 2: 12, 3: None, 4: None, 5: None}


def test_lowest_ways_out_in_a_few_rounds(spark):
    draw = random.Random(8)
    for n, m in ((60, 140), (200, 199)):
        if m < n:  # a chain from the border inwards, with much the same links
            pairs = [("border" if k == 0 else f"{k}:0", f"{k + 1}:0", float(draw.choice([1, 2, 3]))) for k in range(m)]
        else:
            names = ["border", *(f"{k}:{k}" for k in range(n))]
            pairs = [(*draw.sample(names, 2), float(draw.randrange(30))) for _ in range(m)]
        out = {"border": -math.inf}
        while True:
            new = dict(out)
            for a, b, w in pairs:
                for x, y in ((a, b), (b, a)):
                    if x in out:
                        new[y] = min(new.get(y, math.inf), max(out[x], w))
            if new == out:
                break
            out = new
        links = spark.createDataFrame([(x, y, w) for a, b, w in pairs for x, y in ((a, b), (b, a))], "a string, b string, w double").groupBy("a", "b").agg({"w": "min"}).withColumnRenamed("min(w)", "w")
        got = {r.basin: r.out for r in terrain._ways_out(links, written, 8).collect()}
        assert got == out and len(got) > 30


def test_vectors_are_held_against_each_other_in_slices(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(k, [float(draw.choice([-1, 0, 1])) for _ in range(4)]) for k in range(300)] + [(300, None)]
    places = spark.createDataFrame(rows, "place_id long, embedding array<double>")
    queries = places.selectExpr("place_id AS query", "embedding AS asked").filter("place_id % 7 = 0")
    unit = {k: [x / math.hypot(*v) for x in v] for k, v in rows if v and any(v)}
    want = {(q, i, r + 1) for q, a in unit.items() if q % 7 == 0 for r, (_, i) in enumerate(sorted((-round(sum(x * y for x, y in zip(a, b)), 12), i) for i, b in unit.items())[:5])}
    monkeypatch.setattr(textchecks, "PAIRS_AT_ONCE", 500)
    assert {(r.query, r.id, r["rank"]) for r in textchecks.vector_top_k(places, queries, 5).collect()} == want


def test_medians_are_exact_without_all_values(spark):
    rows = spark.range(40001).selectExpr("id % 2 AS mode", "CAST((id * 7919) % 40001 AS DOUBLE) AS m", "CASE WHEN id % 3 > 0 THEN CAST(id % 5 AS DOUBLE) END AS s")
    want = {(r.mode, x): r[x] for r in rows.groupBy("mode").agg(expr("percentile(m, 0.5D) AS m"), expr("percentile(s, 0.5D) AS s")).collect() for x in ("m", "s")}
    most = {}

    def counted(df, name):
        out = written(df, name)
        most[name] = out.count()
        return out

    got = {(r.mode, r["column"]): r["median"] for r in studies.exact_medians(rows, "mode", ["m", "s"], counted).collect()}
    assert got == want and most["median-counts"] < 1000


def test_late_and_far_reports_are_ingested(spark, sf_dir, tmp_path):
    from hazardspark.plans import queries

    # customers up to beyond a pole, and events of half a year in files that are not in order
    spark.range(300000).selectExpr("id AS c_custkey", "'x' AS c_name", "1 AS c_nationkey", "0D AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("ts", expr("ts + make_dt_interval(CAST(event_id * 37 % 180 AS INT))")).repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    ids = [r.id for r in queries()["st1_ingest"](spark, str(tmp_path)).collect()]
    assert sorted(ids) == sorted(r.event_id for r in events.collect())


def test_queries_of_one_text_rank_its_names_once(spark):
    draw = random.Random(11)
    names = ["north gate", "gate", "north lake", "NH-44", "lake road"]
    rows = [(k, [draw.choice(names), draw.choice(names)], draw.choice(["city", "town", "stop"]), 13 + draw.random(), 80 + draw.random(), k % 3) for k in range(200)]
    some = spark.createDataFrame(rows, "place_id long, names array<string>, kind string, lat double, lon double, size long")
    asked = [(k, draw.choice(["gate", "north", "nh 44", "lake", "la", "zz"]), *draw.choice([(None, None), (13 + draw.random(), 80 + draw.random()), (13.5, None)])) for k in range(80)]
    got = {}
    for r in search.search_places(spark.createDataFrame(asked, "query_id long, q string, lat double, lon double"), some).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.place_id))

    def rank(name, q):
        name = name.lower().replace("-", " ")
        number = "44" in q and q.replace(" ", "") in name.replace(" ", "")
        every = all(w in name for w in q.split())
        return -1 if name == q else 0 if name.startswith(q) else 1 if every and ("44" not in q or number) or number else None

    for k, q, lat, lon in asked:
        found = []
        for i, both, kind, y, x, size in rows:
            ranks = [r for r in (rank(n, q) for n in both) if r is not None]
            if ranks:
                d = 0.0 if lat is None or lon is None else math.hypot((x - lon) * 111320 * math.cos(math.radians(lat)), (y - lat) * 110574)
                found.append((min(ranks), {"city": 0, "town": 1, "stop": 5}[kind], d, -size, both[0], i))
        assert [i for _, i in sorted(got.get(k, []))] == [f[-1] for f in sorted(found)[:8]]
