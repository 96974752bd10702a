"""Queries without a SQL twin against plain versions of them, on the smallest tables."""

import heapq
import math
import random

import numpy as np
import pytest

from hazardspark.operators import beliefs, models, rain, scoring, spatial, terrain
from hazardspark.plans import oracle_sql, queries
from hazardspark.plans.registry import Tables
from hazardspark.tables import written

#: Each query without SQL, and the test that holds it against a plain version.
PLAIN = {
    "f5_pessimistic_beta": "test_pessimistic_beta", "g4_sample_od_pairs": "test_reach_costs_and_routes", "g5_shortest_costs_all": "test_reach_costs_and_routes", "g6_routes": "test_reach_costs_and_routes",
    "g3_reachable_all": "tests/test_whole_graph.py", "u5_calendar_clusters_all": "tests/test_whole_tables.py", "m13_logistic_leg": "test_logistic_leg", "m15_train_gbt": "test_models_of_scored_rows",
    "m15_gbt_grid": "test_gbt_grid_finds_a_planted_rule", "m18_isotonic": "test_isotonic", "m18_isotonic_out_of_fold": "test_isotonic", "m25_depression_fill": "test_depression_fill", "m28_greedy_clusters": "test_greedy_clusters",
    "f22_lexical_score": "tests/test_names_and_places.py", "x3_match_by_text": "tests/test_names_and_places.py", "x4_miner_scores_by_text": "tests/test_names_and_places.py", "m28_running_clusters": "tests/test_names_and_places.py",
    "g13_searched_modes": "tests/test_resampling_and_streams.py", "g14_searched_reports": "tests/test_resampling_and_streams.py",
    "m29_transfer_eval": "test_transfer_gains_over_one_feature", "t7_farthest_points": "test_farthest_points",
}


def test_every_query_has_sql_or_a_plain_version():
    assert set(queries()) - set(oracle_sql()) == set(PLAIN)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_pessimistic_beta(spark, sf_dir):
    """The mean without caution, else where the Beta distribution, by fine sums, reaches the normal's share, but never below the mean."""
    t = Tables(spark, sf_dir)
    fused = {r.edge_id: (r.alpha, r.beta) for r in beliefs.fuse_beta(t.obs_edge, t.edge_prior, t.hazards, t.sources, "2024-01-20 00:00:00").collect()}
    z = {r.user_class: r.z for r in t.users.collect()}
    got = queries()["f5_pessimistic_beta"](spark, sf_dir).collect()
    assert len(got) == len(fused) * len(z)
    for r in random.Random(1).sample(got, 60):
        a, b = fused[r.edge_id]
        mean = a / (a + b)
        if z[r.user_class] == 0:
            assert abs(r.p_tilde - mean) < 2e-6
            continue
        # on the scale t = ln(x / (1 - x)) the density is x^a (1 - x)^b / B, without poles
        top = math.log(r.p_tilde / (1 - r.p_tilde))
        t = np.linspace(top - 40 / min(a, 1), top, 400_001)
        mass = np.exp(-a * np.logaddexp(0, -t) - b * np.logaddexp(0, t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        reached = float(((mass[1:] + mass[:-1]) / 2).sum() * (t[1] - t[0]))
        q = 0.5 * (1 + math.erf(z[r.user_class] / 2**0.5))
        assert r.p_tilde >= mean - 1e-6
        assert abs(reached - q) < 2e-3 if r.p_tilde > mean + 2e-6 else reached >= q - 2e-3


def test_reach_costs_and_routes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = {}
    for e in t.lattice_edges.collect():
        out.setdefault(e.from_node, []).append((e.to_node, e.free_flow_seconds))
    sources = [r.node for r in t.lattice_nodes.collect() if r.node % 20 == 0]
    want = {}
    for s in sources:
        best, todo = {s: 0.0}, [(0.0, s)]
        while todo:
            cost, u = heapq.heappop(todo)
            if cost > best[u]:
                continue
            for v, step in out.get(u, ()):
                if cost + step < best.get(v, math.inf) - 1e-12:
                    best[v] = cost + step
                    heapq.heappush(todo, (best[v], v))
        want |= {(s, n): c for n, c in best.items()}
    got = {(r.source, r.node): r.cost for r in queries()["g5_shortest_costs_all"](spark, sf_dir).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    paths = {(r.source, r.target): r.path for r in queries()["g6_routes"](spark, sf_dir).collect()}
    assert set(paths) == set(want)
    for (s, n), path in paths.items():
        assert path[0] == s and path[-1] == n
        cost = sum(min(c for v, c in out[a] if v == b) for a, b in zip(path, path[1:]))
        assert abs(cost - want[s, n]) < 1e-3
    pairs = [(r.source, r.target) for r in queries()["g4_sample_od_pairs"](spark, sf_dir).collect()]
    assert len(set(pairs)) == 20 and all(p in want and p[0] != p[1] for p in pairs)
    assert pairs == [(r.source, r.target) for r in queries()["g4_sample_od_pairs"](spark, sf_dir).collect()]


def scored(spark, sf_dir):
    return Tables(spark, sf_dir).scored.collect()


def test_models_of_scored_rows(spark, sf_dir):
    (row,) = queries()["m15_train_gbt"](spark, sf_dir).collect()
    base = np.mean([r.y for r in scored(spark, sf_dir) if r.id % 4 == 0])
    assert 0.5 * base < row.ap <= 1 and 0 <= row.auc <= 1


def pooled(points):
    """Isotonic fit of (score, y) pairs: pool adjacent violators over distinct scores, linear between them, flat outside."""
    by = {}
    for x, y in points:
        by.setdefault(x, []).append(y)
    blocks = []
    for x in sorted(by):
        blocks.append([float(sum(by[x])), len(by[x]), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    xs = [x for b in blocks for x in b[2]]
    return lambda v: float(np.interp(v, xs, [b[0] / b[1] for b in blocks for _ in b[2]]))


def test_isotonic(spark, sf_dir):
    rows = scored(spark, sf_dir)
    fit = pooled([(r.score, r.y) for r in rows if r.id % 2 == 0])
    got = {r.id: r.calibrated for r in queries()["m18_isotonic"](spark, sf_dir).collect()}
    assert set(got) == {r.id for r in rows if r.id % 2 == 1} and all(abs(got[r.id] - fit(r.score)) < 1e-5 for r in rows if r.id in got)
    got = {r.id: r.calibrated for r in queries()["m18_isotonic_out_of_fold"](spark, sf_dir).collect()}
    fits = [pooled([(r.score, r.y) for r in rows if r.id % 4 != k]) for k in range(4)]
    assert len(got) == len(rows) and all(abs(got[r.id] - fits[r.id % 4](r.score)) < 1e-5 for r in rows)


def test_logistic_leg(spark, sf_dir):
    """Each language's rows by a ridge-penalised fit of the others, found by Newton steps on standardised features."""
    rows = scored(spark, sf_dir)
    got = {r.id: r.p for r in queries()["m13_logistic_leg"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for grp in {r.grp for r in rows}:
        rest, own = [r for r in rows if r.grp != grp], [r for r in rows if r.grp == grp]
        x, y = np.array([[r.score, r.score_b] for r in rest]), np.array([r.y for r in rest], float)
        sd = x.std(axis=0, ddof=1)
        design, w = np.column_stack([np.ones(len(x)), x / sd]), np.zeros(3)
        ridge = np.diag([0, 0.01, 0.01])
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ w))
            grad = design.T @ (p - y) / len(y) + ridge @ w
            w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / len(y) + ridge, grad)
        for r in own:
            p = 1 / (1 + math.exp(-(w[0] + w[1] * r.score / sd[0] + w[2] * r.score_b / sd[1])))
            assert abs(got[r.id] - p) < 5e-3


def planted(spark, n=900):
    draw = random.Random(8)
    rows = []
    for i in range(n):
        a, b, c = draw.random(), draw.random(), draw.random()
        rows.append((i, int((a > 0.5) != (b > 0.5)), a, b, c, 1.0, f"b{i % 12}", ("train", "val", "test")[i // 12 % 3]))
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double, w double, block string, part string")


def test_gbt_grid_finds_a_planted_rule(spark, sf_dir):
    (row,) = models.train_gbt_grid(planted(spark), ["a", "b", "c"], [(1, 2), (3, 6)], written).collect()
    assert (row.depth, row.rounds) == (3, 6) and row.ap > 0.9 and row.auc > 0.9 and 0 < row.alert_recall < 0.1
    (row,) = queries()["m15_gbt_grid"](spark, sf_dir).collect()
    assert 0 <= row.ap <= 1 and 0 <= row.alert_recall <= 1


def test_transfer_gains_over_one_feature(spark, sf_dir):
    rows = planted(spark)
    (row,) = models.transfer_eval(rows, rows["id"] % 2 == 0, ["a", "b", "c"], 30, written).collect()
    assert row.model_ap > 0.9 and row.single_ap < 0.7 and row.low > 0.2 and row.low <= row.gain + 0.1 and row.high >= row.low
    (row,) = queries()["m29_transfer_eval"](spark, sf_dir).collect()
    assert abs(row.gain - (row.model_ap - row.single_ap)) < 2e-6


def test_depression_fill(spark, sf_dir):
    """The lowest of the highest points on any way out, by a queue from the border."""
    cells = {(r.row, r.col): r.elev for r in Tables(spark, sf_dir).grid.collect()}
    near = lambda k: [(k[0] + i, k[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (k[0] + i, k[1] + j) in cells]
    fill, todo = {}, [(e, k) for k, e in cells.items() if len(near(k)) < 8]
    heapq.heapify(todo)
    while todo:
        level, k = heapq.heappop(todo)
        if k not in fill:
            fill[k] = level
            for m in near(k):
                if m not in fill:
                    heapq.heappush(todo, (max(level, cells[m]), m))
    assert {(r.row, r.col): r.fill for r in queries()["m25_depression_fill"](spark, sf_dir).collect()} == fill


def flood(cells):
    near = lambda k: [(k[0] + i, k[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (k[0] + i, k[1] + j) in cells]
    fill, todo = {}, [(e, k) for k, e in cells.items() if len(near(k)) < 8]
    heapq.heapify(todo)
    while todo:
        level, k = heapq.heappop(todo)
        if k not in fill:
            fill[k] = level
            for m in near(k):
                if m not in fill:
                    heapq.heappush(todo, (max(level, cells[m]), m))
    return fill


@pytest.mark.parametrize("tile", [7, 256])
def test_depression_fill_by_tiles(spark, tile):
    """A long winding valley, noise, flats and a hole in the grid, over tiles of several sizes."""
    draw = random.Random(tile)
    cells = {(r, c): float(draw.randrange(8)) for r in range(40) for c in range(40)}
    cells |= {(r, c): 20.0 + draw.randrange(3) for r in range(0, 40, 4) for c in range(1 if r % 8 else 0, 40 if r % 8 else 39)}  # walls with a gap at one end
    cells |= {(r, c): 30.0 for r in range(40) for c in (0, 39)}
    for k in [(20, 20), (20, 21)]:
        del cells[k]
    grid = spark.createDataFrame([(r, c, e) for (r, c), e in cells.items()], "row long, col long, elev double")
    assert {(r.row, r.col): r.fill for r in terrain.depression_fill(grid, written, tile=tile).collect()} == flood(cells)


def test_greedy_clusters(spark, sf_dir):
    zones = sorted(Tables(spark, sf_dir).zones.collect(), key=lambda z: (-z.area, z.zone_id))
    owner = {}
    for z in zones:
        if z.zone_id not in owner:
            owner |= {o.zone_id: z.zone_id for o in zones if o.zone_id not in owner and metres((z.lat, z.lon), (o.lat, o.lon)) <= 3000}
    assert {r.zone_id: r.cluster for r in queries()["m28_greedy_clusters"](spark, sf_dir).collect()} == owner


def test_farthest_points(spark, sf_dir):
    nodes = {r.node: (r.lat, r.lon) for r in Tables(spark, sf_dir).lattice_nodes.collect()}
    picked = [min(nodes)]
    while len(picked) < 5:
        picked.append(max(nodes, key=lambda n: (round(min(metres(nodes[n], nodes[p]) for p in picked), 4), -n)))
    assert [r.id for r in queries()["t7_farthest_points"](spark, sf_dir).orderBy("place").collect()] == picked


def test_ranks_of_distinct_and_of_equal_scores(spark):
    """All scores different, and one score for most rows: exact ranks, and no window over all rows in the plan."""
    draw = random.Random(2)
    rows = [(i, draw.random() if i % 3 == 0 else 0.25, draw.randrange(2), f"g{i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double, y int, grp string")
    order = {i: k + 1 for k, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    out = scoring.ranked(df, "score", "id")
    assert {r.id: r["rank"] for r in out.collect()} == order
    assert "windowspecdefinition(score" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.grp: r.auroc for r in scoring.auroc(df, by=["grp"]).collect()}
    for g in ("g0", "g1"):
        own = [r for r in rows if r[3] == g]
        pos, neg = np.array([r[1] for r in own if r[2]]), np.array([r[1] for r in own if not r[2]])
        want = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
        assert abs(got[g] - want) < 1e-9


def test_rain_by_place(spark):
    rows = [(p, 3600 * k, 2 if (k == 0) == (p == "a") and k < 1 else 0) for p in "ab" for k in range(9)]
    df = spark.createDataFrame(rows, "place string, t long, level int")
    states = {(r.place, r.t // 3600): r.state for r in rain.state_holds(df, by=["place"]).collect()}
    assert all(states["a", k] == (2 if k <= 6 else 1) and states["b", k] == 0 for k in range(9))


def test_long_text_has_linear_shingles(spark):
    from pyspark.sql import functions as F

    from hazardspark.operators.textchecks import shingles, words

    text = spark.createDataFrame([(" ".join(f"w{k % 977}" for k in range(60_000)),), ("a b",), ("",)], "text string")
    sizes = [r.n for r in text.select(F.size(shingles(words(F.col("text")), 6)).alias("n")).collect()]
    assert sizes == [59_995, 0, 0]


def test_nearest_masked_and_slope_at_borders(spark):
    grid = spark.createDataFrame([(r, c, float(10 * c)) for r in range(4) for c in range(6)], "row long, col long, elev double")
    got = {(r.row, r.col): (r.cells, r.value) for r in terrain.nearest_masked(grid, "elev >= 50", 3).collect()}
    assert got[0, 5] == (0.0, 50.0) and got[1, 2] == (3.0, 50.0) and got[3, 1] == (None, None)
    slope = {(r.row, r.col): r.slope for r in terrain.slope(grid, 10.0).collect()}
    assert slope[0, 0] is None and abs(slope[1, 2] - 45) < 1e-9


def test_cycle_of_a_planted_signal(spark):
    """Departures every 90 s (some left out) explain 45 s as well; the longer one is chosen, on its peak."""
    from hazardspark.operators import signals

    draw = random.Random(6)
    rows = [(1, 90.0 * k + draw.uniform(0, 4)) for k in range(120) if draw.random() < 0.5] + [(2, draw.uniform(0, 9000)) for _ in range(200)] + [(3, 90.0 * k) for k in range(5)]
    found = signals.cycle_candidates(spark.createDataFrame(rows, "site long, t double"), "site", "t")
    got = {r.site: r for r in signals.choose_cycle(found, "site").collect()}
    assert abs(got[1].cycle - 90) <= 0.25 and got[1].resultant > 0.9 and min(got[1].offset_s, 90 - got[1].offset_s) < 8
    assert got[2].cycle is None and got[3].cycle is None


def test_area_tiers(spark):
    points = spark.createDataFrame([(1, 13.0, 80.0), (2, 14.0, 80.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([(10, "quarter", 13.001, 80.0), (11, "suburb", 13.009, 80.0), (12, "suburb", 14.015, 80.0), (13, "quarter", 14.016, 80.0)], "place_id long, kind string, lat double, lon double")
    got = {r.id: r.place_id for r in spatial.nearest_area(points, places, ["suburb"]).collect()}
    assert got == {1: 11, 2: 12}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from hazardspark import tables

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session)
