"""Routes searched under several costs at once, and held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark import config
from hazardspark.operators import beliefs, graph, paths, routes, studies
from hazardspark.plans.q_belief import AT
from hazardspark.plans.q_models import SHARED_TAU_S
from hazardspark.plans.registry import Tables, query
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)
PAIRS, SEED = 30, 20260914
CROWD_TTL_S = 30 * 86400.0  # reports of the last thirty days count alike
#: Weights of risk under which held-out reports are counted.
LAMBDAS = (0.3, 5.0, 20.0)


def searched(t: Tables, edges: DataFrame, by: str, base: str) -> DataFrame:
    """Legs (by, source, target, seq, edge_id, cost) of PAIRS sampled pairs: sources and then targets by a seeded hash, targets among the
    nodes that the base variant reaches."""
    sources = written(t.lattice_nodes.select("node").orderBy(F.xxhash64(F.lit(SEED), "node"), "node").limit(PAIRS), "od-sources")
    edges = written(edges, "variants")
    reached = paths.costs_from(edges.filter(c(by) == base), sources, written)
    pairs = written(studies.sample_pairs(reached, PAIRS, SEED), "od-pairs")
    found = paths.paths_of(edges, pairs, written, by=(by,))
    return written(graph.path_edges(found, edges, (by,)), "variant-legs")


def mode_edges(t: Tables) -> DataFrame:
    out = None
    for mode, profile in config.PROFILES.items():
        one = graph.profile_edges(t.lattice_edges, profile).select(F.lit(mode).alias("mode"), "edge_id", "from_node", "to_node", "length_m", c("seconds").alias("cost"))
        out = one if out is None else out.unionByName(one)
    return out


def mode_legs(t: Tables) -> DataFrame:
    edges = mode_edges(t)
    legs = searched(t, edges, "mode", "car")
    lengths = t.lattice_edges.select("edge_id", "length_m")
    return legs.join(lengths, "edge_id").withColumnRenamed("cost", "seconds")


@query("g13_searched_modes")
def _(t: Tables):
    out = routes.compare_searched_modes(mode_legs(t), "car")
    return out.select("mode", "found", *[r6(c(x)).alias(x) for x in ("km", "minutes", "kmh", "differing")])


def crowd_edges(t: Tables) -> DataFrame:
    """Edges priced by the prior alone and by prior and the crowd's reports of thirty days, for each weight of risk: variant 'prior 0.3', 'crowd 0.3' and so on."""
    configs = [(f"{name} {lam}", evidence, None, lam) for lam in LAMBDAS for name, evidence in (("prior", "nothing"), ("crowd", "ttl"))]
    configs = t.spark.createDataFrame(configs, "cfg string, variant string, block double, lam double")
    variants = t.spark.createDataFrame([("ttl",)], "variant string")
    crowd = t.obs_edge.filter("source_class = 'crowd'")
    known = beliefs.hazard_config(t.obs_edge, t.edge_prior, t.hazards)
    priced = studies.config_costs(t.lattice_edges, known, crowd, t.hazards, t.sources, AT, variants, configs, SHARED_TAU_S, CROWD_TTL_S)
    return priced.select(c("cfg").alias("variant"), "edge_id", c("cost_s").alias("cost")).join(t.lattice_edges.select("edge_id", "from_node", "to_node"), "edge_id")


@query("g14_searched_reports")
def _(t: Tables):
    """Official reports that routes meet if costs know the crowd's reports, less those they meet without."""
    legs = searched(t, crowd_edges(t), "variant", f"prior {LAMBDAS[0]}")
    official = t.obs_edge.filter("source_class = 'official_feed'")
    counts = written(routes.held_out_counts(legs, official), "held-out")
    changed = {lam: routes.route_changes(legs.filter(c("variant").isin(f"prior {lam}", f"crowd {lam}")), f"prior {lam}") for lam in LAMBDAS}
    out = None
    for lam in LAMBDAS:
        one = routes.paired_difference(counts, f"crowd {lam}", f"prior {lam}", 200).crossJoin(changed[lam].agg(F.avg(c("differs").cast("double")).alias("changed")))  # one row each
        one = one.select(F.lit(lam).alias("lam"), "pairs", c("mean_a").alias("with_crowd"), c("mean_b").alias("prior_only"), "difference", "low", "high", "changed")
        out = one if out is None else out.unionByName(one)
    return out.select("lam", "pairs", *[r6(c(x)).alias(x) for x in ("with_crowd", "prior_only", "difference", "low", "high", "changed")])
