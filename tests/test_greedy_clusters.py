"""Greedy clusters against one zone after another, across the old borders at multiples of 0.25 degrees."""

import math
import random

from hazardspark.operators.studies import greedy_clusters
from hazardspark.tables import written


def metres(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_clusters_cross_borders_and_equal_the_plain_order(spark):
    draw = random.Random(3)
    zones = [(k, float(draw.randrange(40)), 13 + draw.uniform(-0.1, 0.1), 80 + draw.uniform(-0.1, 0.1)) for k in range(150)]
    zones += [(500, 90.0, 14.2499, 81.0), (501, 1.0, 14.2501, 81.0)]
    owner = {}
    for z in sorted(zones, key=lambda z: (-z[1], z[0])):
        if z[0] not in owner:
            owner |= {o[0]: z[0] for o in zones if o[0] not in owner and metres(z, o) <= 3000}
    assert owner[501] == 500 and len(set(owner.values())) > 10
    rows = spark.createDataFrame(zones, "zone_id long, area double, lat double, lon double")
    got = greedy_clusters(rows, 3000.0, written).collect()
    assert len(got) == len(zones) and {r.zone_id: r.cluster for r in got} == owner
