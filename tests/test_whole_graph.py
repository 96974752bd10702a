"""Graph queries over whole graphs: no hop or cost bound, and an error instead of a cut at the round limit."""

import pytest

from hazardspark.operators import graph
from hazardspark.plans.registry import QUERIES, Tables
from hazardspark.tables import written


def test_round_limit_is_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "from_node long, to_node long, cost double")
    source = spark.createDataFrame([(0,)], "node long")
    assert graph.reachable(edges, source, written).count() == 7 and graph.reachable(edges, source, written, hops=2).count() == 3
    costs = graph.shortest_costs(edges, source, written)
    pairs = spark.createDataFrame([(0, 6)], "source long, target long")
    assert [r.path for r in graph.routes(costs, edges, pairs, written).collect()] == [list(range(7))]
    for cut in (lambda: graph.reachable(edges, source, written, rounds=3), lambda: graph.shortest_costs(edges, source, written, rounds=1), lambda: graph.routes(costs, edges, pairs, written, rounds=3)):
        with pytest.raises(RuntimeError):
            cut()


def test_reachable_all_by_brute_force(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = {}
    for e in t.lattice_edges.collect():
        out.setdefault(e.from_node, []).append(e.to_node)
    expected = set()
    for s in (r.node for r in t.lattice_nodes.collect() if r.node % 20 == 0):
        seen, todo = {s: 0}, [s]
        for u in todo:
            for v in out.get(u, ()):
                if v not in seen:
                    seen[v] = seen[u] + 1
                    todo.append(v)
        expected |= {(s, n, h) for n, h in seen.items()}
    assert max(h for _, _, h in expected) > 6
    assert {tuple(r) for r in QUERIES["g3_reachable_all"](spark, sf_dir).collect()} == expected
