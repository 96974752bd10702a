"""Queries over whole tables against plain versions of them."""

import math
from datetime import timedelta

from hazardspark.plans import queries


def test_catalogues_hold_all_orders(spark, sf_dir):
    rows = [(r.o_orderkey, r.o_custkey % 25, r.d, r.d + timedelta(r.o_orderkey % 9)) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate as date) d").collect()]
    pad = timedelta(3)
    a, b = ([r for r in rows if r[0] % 2 == k] for k in (0, 1))
    pairs = {(x[0], y[0], x[1]) for x in a for y in b if x[1] == y[1] and x[2] - pad <= y[3] + pad and y[2] - pad <= x[3] + pad}
    run = queries()
    assert {tuple(r) for r in run["j8_link_catalogues_all"](spark, sf_dir).select("a_id", "b_id", "district").collect()} == pairs
    clusters = run["u5_calendar_clusters_all"](spark, sf_dir).collect()
    assert sum(r.n_a for r in clusters) == len(a) and sum(r.n_b for r in clusters) == len({p[1] for p in pairs})
    assert sum(r.n for r in run["a10_event_counts_all"](spark, sf_dir).collect()) == len(a)
    assert {r.district for r in run["a11_district_registry_all"](spark, sf_dir).collect()} == {x[1] for x in a}
    assert len(run["j15_match_or_note_all"](spark, sf_dir).collect()) == len(a)
    covered = {(x[1], x[2] + timedelta(k)) for x in a for k in range((x[3] - x[2]).days + 1)}
    panel = run["a27_label_panel_all"](spark, sf_dir).collect()
    assert all(r.y == ((r.district, r.day) in covered) for r in panel)


def test_gauges_and_reports_of_all_rows(spark, sf_dir):
    run = queries()
    third = {tuple(r) for r in run["j10_nearest_gauge"](spark, sf_dir).collect()}
    whole = {tuple(r) for r in run["j10_nearest_gauge_all"](spark, sf_dir).collect()}
    assert {r for r in whole if r[0] % 3 == 0} == third and {r[0] % 3 for r in whole} == {0, 1, 2}
    found = {r.id: r.depth_mm for r in run["s1_observations_ndjson_all"](spark, sf_dir).collect()}
    assert found == {str(r.event_id): round(r.value, 6) if r.event_id % 3 == 0 else None for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value").collect()}


def test_cycles_in_quarter_seconds(spark, sf_dir):
    sites = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'click'").selectExpr("user_id % 10 AS site", "unix_timestamp(ts) % 86400 AS t").collect():
        sites.setdefault(r.site, []).append(r.t)
    got = {(r.site, r.cycle): r.resultant for r in queries()["m26_cycle_candidates_all"](spark, sf_dir).collect()}
    assert set(got) == {(s, 40 + k / 4) for s in sites for k in range(561)}
    for (site, cycle), found in got.items():
        phases = [2 * math.pi * x / cycle for x in sites[site]]
        assert abs(found - math.hypot(sum(map(math.cos, phases)), sum(map(math.sin, phases))) / len(phases)) < 2e-6
