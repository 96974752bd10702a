"""Draws that resample, routes under several costs, and streams that stop and start again."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.operators import graph, routes, scoring
from hazardspark.plans import q_routes, queries
from hazardspark.plans.q_streams import in_parts
from hazardspark.plans.registry import Tables
from hazardspark.streaming import streams
from hazardspark.tables import written


def test_draws_are_independent_and_with_replacement(spark):
    n, reps = 40, 400
    blocks = spark.range(n).withColumnRenamed("id", "b")
    drawn = scoring.bootstrap_weights(blocks, reps).collect()
    times = np.zeros((reps, n))
    for r in drawn:
        times[r.rep, r.b] = r.times
    assert (times.sum(1) == n).all()
    distinct = (times > 0).sum(1)
    assert abs(distinct.mean() - n * (1 - (1 - 1 / n) ** n)) < 0.3 and distinct.max() < n
    assert len({tuple(row) for row in times}) == reps and abs(np.corrcoef(times[:-1].ravel(), times[1:].ravel())[0, 1]) < 0.03
    assert (times.mean(0) > 0.8).all() and (times.mean(0) < 1.2).all()
    other = {(r.rep, r.b): r.times for r in scoring.bootstrap_weights(blocks, reps, seed=2).collect()}
    assert other != {(r.rep, r.b): r.times for r in drawn}


def test_spread_agrees_with_plain_resampling(spark):
    rng = np.random.default_rng(3)
    num, den = rng.normal(5, 2, 60), rng.uniform(1, 3, 60)
    blocks = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(num, den))], "b long, num double, den double")
    got = np.array([r.value for r in scoring.block_bootstrap(blocks, 600).collect()])
    plain = np.array([num[d].sum() / den[d].sum() for d in rng.integers(0, 60, (4000, 60))])
    assert abs(got.mean() - plain.mean()) < 4 * plain.std() / 600**0.5 and 0.85 < got.std() / plain.std() < 1.15


def test_joint_bootstrap_against_weighted_rows(spark):
    rng = np.random.default_rng(5)
    y, block = rng.integers(0, 2, 300), rng.integers(0, 12, 300)
    a, b = np.round(rng.random(300) + 0.3 * y, 1), rng.random(300)
    rows = spark.createDataFrame([(int(p), int(q), float(u), float(v)) for p, q, u, v in zip(y, block, a, b)], "y int, b long, a double, o double")
    blocks = spark.range(12).withColumnRenamed("id", "b")
    times = {(r.rep, r.b): r.times for r in scoring.bootstrap_weights(blocks, 20).collect()}
    got = {(r.rep, r.scorer): r for r in scoring.joint_block_bootstrap(rows, blocks, ["a", "o"], 20).collect()}
    assert set(got) == {(rep, s) for rep in (None, *range(20)) for s in ("a", "o")}
    for (rep, name), r in got.items():
        s = {"a": a, "o": b}[name]
        w = np.array([1 if rep is None else times.get((rep, k), 0) for k in block], float)
        top = s >= np.quantile(s, 0.9)
        pos, neg = (w * y).sum(), (w * (1 - y)).sum()
        wins = sum(w[i] * w[j] * ((s[i] > s[j]) + 0.5 * (s[i] == s[j])) for i in np.flatnonzero(y) for j in np.flatnonzero(1 - y))
        ap = sum((w * y)[s == v].sum() * (w * y)[s >= v].sum() / max(w[s >= v].sum(), 1e-12) for v in set(s.tolist())) / pos
        assert abs(r.auc - wins / (pos * neg)) < 1e-9 and abs(r.ap - ap) < 1e-9 and abs(r.capture - (w * y * top).sum() / pos) < 1e-9


def dijkstra(edges, source):
    out = {}
    for u, v, cost in edges:
        out.setdefault(u, []).append((v, cost))
    best, todo = {source: 0.0}, [(0.0, source)]
    while todo:
        d, u = heapq.heappop(todo)
        if d > best[u]:
            continue
        for v, cost in out.get(u, ()):
            if d + cost < best.get(v, math.inf) - 1e-12:
                best[v] = d + cost
                heapq.heappush(todo, (best[v], v))
    return best


@pytest.mark.parametrize("compact", [1, 2, 8])
def test_several_costs_at_once(spark, compact):
    rng = np.random.default_rng(2)
    edges = [(v, e, int(a), int(b), None if rng.random() < 0.1 else float(c)) for v in ("x", "y", "z") for e, (a, b, c) in enumerate(zip(rng.integers(0, 40, 160), rng.integers(0, 40, 160), rng.uniform(1, 9, 160)))]
    df = spark.createDataFrame(edges, "variant string, edge_id long, from_node long, to_node long, cost double")
    sources = spark.createDataFrame([(0,), (7,), (7,), (999,)], "node long")
    costs = graph.shortest_costs(df, sources, written, by=("variant",), compact=compact)
    got = {(r.variant, r.source, r.node): r.cost for r in costs.collect()}
    want = {}
    for v in "xyz":
        for s in (0, 7, 999):
            want |= {(v, s, n): c for n, c in dijkstra([(a, b, c) for w, _, a, b, c in edges if w == v and c is not None], s).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pairs = spark.createDataFrame([(s, n) for s in (0, 7) for n in range(40) if n != s], "source long, target long")
    legs = graph.path_edges(graph.routes(costs, df, pairs, written, by=("variant",)), df, ("variant",)).collect()
    total = {}
    for leg in legs:
        total[leg.variant, leg.source, leg.target] = total.get((leg.variant, leg.source, leg.target), 0.0) + leg.cost
    assert set(total) == {k for k in want if k[1] in (0, 7) and k[2] != k[1]} and all(abs(total[k] - want[k]) < 1e-6 for k in total)


def test_held_out_reports_of_searched_routes(spark, sf_dir, monkeypatch):
    t = Tables(spark, sf_dir)
    rows = q_routes.crowd_edges(t).collect()
    found = q_routes.searched(t, q_routes.crowd_edges(t), "variant", "prior 0.3")
    monkeypatch.setattr(q_routes, "searched", lambda *a: found)
    legs = found.collect()
    official = {r.edge_id for r in t.obs_edge.filter("source_class = 'official_feed'").select("edge_id").collect()}
    by = {}
    for leg in legs:
        by.setdefault((leg.variant, leg.source, leg.target), []).append(leg)
    priced = {v: [(r.from_node, r.to_node, r.cost) for r in rows if r.variant == v and r.cost is not None] for v in {r.variant for r in rows}}
    for (v, s, n), own in by.items():
        assert abs(sum(leg.cost for leg in own) - dijkstra(priced[v], s)[n]) < 1e-6
    for r in queries()["g14_searched_reports"](spark, sf_dir).collect():
        a, b = ({k[1:]: len([1 for leg in own if leg.edge_id in official]) for k, own in by.items() if k[0] == f"{name} {r.lam}"} for name in ("crowd", "prior"))
        diff = [a[k] - b[k] for k in a if k in b]
        differs = [{leg.edge_id for leg in by[f"crowd {r.lam}", *k]} != {leg.edge_id for leg in by[f"prior {r.lam}", *k]} for k in a]
        assert r.pairs == len(diff) == 30 and abs(r.difference - np.mean(diff)) < 1e-6 and r.low <= r.difference <= r.high and abs(r.changed - np.mean(differs)) < 1e-6
        assert abs(r.with_crowd - np.mean(list(a.values()))) < 1e-6


def test_searched_modes(spark, sf_dir, monkeypatch):
    t = Tables(spark, sf_dir)
    found = q_routes.mode_legs(t)
    monkeypatch.setattr(q_routes, "mode_legs", lambda t: found)
    legs = found.collect()
    got = {r["mode"]: r for r in queries()["g13_searched_modes"](spark, sf_dir).collect()}
    sets = {}
    for leg in legs:
        sets.setdefault((leg["mode"], leg.source, leg.target), set()).add(leg.edge_id)
    car = {k[1:]: v for k, v in sets.items() if k[0] == "car"}
    assert set(got) == {"car", "foot", "bicycle", "emergency"} and got["car"].differing is None and got["car"].found == len(car)
    for mode in ("foot", "bicycle", "emergency"):
        own = {k[1:]: v for k, v in sets.items() if k[0] == mode}
        assert abs(got[mode].differing - np.mean([own[k] != car[k] for k in own if k in car])) < 1e-6
        seconds = {}
        for leg in legs:
            if leg["mode"] == mode:
                seconds[leg.source, leg.target] = seconds.get((leg.source, leg.target), 0) + leg.seconds
        assert abs(got[mode].minutes - np.median(list(seconds.values())) / 60) < 1e-6
    rows = q_routes.mode_edges(t).filter("mode = 'foot'").select("from_node", "to_node", "cost").collect()
    walked = {}
    for leg in legs:
        if leg["mode"] == "foot":
            walked[leg.source, leg.target] = walked.get((leg.source, leg.target), 0) + leg.seconds
    for (s, n), total in list(walked.items())[:8]:
        assert abs(total - dijkstra([tuple(r) for r in rows], s)[n]) < 1e-6


def test_timers_fire_across_restarts(spark):
    """Region a falls silent and comes back three days later, b stays silent, c goes on; the stream is stopped after each part."""
    h = 3600
    h0 = 480_000 * h
    rows = [("a", 0, 20.0), ("a", 2 * h, 1.0), ("b", 1 * h, 9.0), ("a", 75 * h, 1.0), ("c", 0, 1.0)] + [("c", k * 6 * h, 1.0) for k in range(1, 20)]
    df = spark.createDataFrame([(r, h0 + t, mm, 0.0, None) for r, t, mm in rows], "region string, t long, acc_mm double, peak_mm_h double, manual double")
    out = in_parts(df, "t", lambda s: streams.event_states(s, 1, "1 hour"), "timers", 5).collect()
    got = sorted((r.region, (r.t - h0) // h, r.state) for r in out)
    want = [("a", 0, 2), ("a", 2, 2), ("a", 14, 1), ("a", 75, 0), ("a", 87, 1), ("b", 1, 1), ("b", 13, 1)] + [("c", k * 6, 0) for k in range(20)]
    assert got == sorted(want)
    assert len({r.batch for r in out}) >= 3


def test_sums_of_edges_over_eras(spark):
    tau = 3600.0
    rows = [(1, float(t), w) for t, w in ((0, 1.0), (1800, -0.5), (3600 * 301, 2.0), (3600 * 301 + 900, 1.0))] + [(2, 3600.0 * 299.9, 1.0), (2, 3600.0 * 300.1, 1.0)]
    sums = spark.createDataFrame(rows, "edge_id long, t double, w double").withColumn("tau", F.lit(tau)).withColumn("era", F.floor(F.col("t") / (streams.ERA * tau)))
    sums = sums.groupBy("edge_id", "era", "tau").agg(F.max("t").alias("at"), F.sum(F.col("w") * F.exp((F.col("t") - F.col("era") * streams.ERA * tau) / tau)).alias("s"))
    got = {r.edge_id: r.evidence for r in streams.current_beliefs(sums).collect()}
    for edge in (1, 2):
        own = [(t, w) for e, t, w in rows if e == edge]
        newest = max(t for t, _ in own)
        assert abs(got[edge] - sum(w * math.exp(-(newest - t) / tau) for t, w in own)) < 1e-9
