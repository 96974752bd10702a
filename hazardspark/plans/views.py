"""Views of the shapes the operators work on, derived from the base tables by SQL that Spark and DuckDB evaluate alike."""

from hazardspark import config

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _row(n: str) -> str:
    return f"CAST(floor({n} / 40e0) AS BIGINT)"


def _lat(n: str) -> str:
    return f"(12.75e0 + {_row(n)} * 0.0125e0)"


def _lon(n: str) -> str:
    return f"(79.95e0 + ({n} % 40) * 0.01e0)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2e0 * 6371000e0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2))))"


def drawn(reps: int, seed: int = 1) -> str:
    """Tables nb (number of blocks of bl) and dr (rep, b, times): draws of blocks by keyed hashes, as `bootstrap_weights` has them."""
    return f"""nb AS (SELECT count(*) AS n FROM bl), dr AS (SELECT rep, CAST(concat('0x', substr(md5(concat('{seed}:', CAST(rep AS VARCHAR), ':', CAST(CAST(k.b AS BIGINT) AS VARCHAR))), 1, 15)) AS BIGINT) % n AS b, count(*) AS times
        FROM bl k CROSS JOIN nb CROSS JOIN (SELECT unnest(range({reps})) AS rep) r GROUP BY 1, 2)"""


def _num(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x!r} AS DOUBLE)"


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else _num(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


_KMH = "CASE highway WHEN 'trunk' THEN 60e0 WHEN 'primary' THEN 45e0 WHEN 'secondary' THEN 40e0 WHEN 'tertiary' THEN 30e0 ELSE 20e0 END"

VIEWS = {
    "hazards": _values([(k, *v) for k, v in config.HAZARDS.items()], "hazard_class, tau, severity, h_max_mm, epsilon"),
    "sources": _values(list(config.SOURCES.items()), "source_class, alpha"),
    "users": _values([(k, v[0], v[1], v[2]) for k, v in config.USERS.items()], "user_class, z, lam, profile"),
    "zone_p": _values(list(config.ZONE_PROBABILITY.items()), "category, p"),
    "lattice_nodes": f"SELECT c_custkey AS node, {_row('c_custkey')} AS row, c_custkey % 40 AS col, {_lat('c_custkey')} AS lat, {_lon('c_custkey')} AS lon, c_mktsegment, c_nationkey FROM {{customer}}",
    "lattice_pairs": """SELECT a.node AS n, b.node AS m, 0 AS dir FROM {lattice_nodes} a JOIN {lattice_nodes} b ON b.node = a.node + 1 WHERE a.col < 39
        UNION ALL SELECT a.node, b.node, 2 FROM {lattice_nodes} a JOIN {lattice_nodes} b ON b.node = a.node + 40""",
    "lattice_edges": f"""SELECT edge_id, from_node, to_node, highway, street_name, length_m, lat1, lon1, lat2, lon2, {_KMH} AS free_flow_kmh, length_m / ({_KMH} / 3.6e0) AS free_flow_seconds
        FROM (SELECT 4 * p.n + p.dir + d.back AS edge_id, a.node AS from_node, b.node AS to_node,
              CASE o.c_mktsegment WHEN 'AUTOMOBILE' THEN 'primary' WHEN 'BUILDING' THEN 'secondary' WHEN 'FURNITURE' THEN 'tertiary' WHEN 'MACHINERY' THEN 'trunk' ELSE 'residential' END AS highway,
              concat('S', CAST(o.c_nationkey AS VARCHAR(10))) AS street_name, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS length_m,
              a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
              FROM {{lattice_pairs}} p JOIN (SELECT 0 AS back UNION ALL SELECT 1 AS back) d ON d.back = 0 OR p.n % 11 <> 0
              JOIN {{lattice_nodes}} o ON o.node = p.n
              JOIN {{lattice_nodes}} a ON a.node = CASE WHEN d.back = 0 THEN p.n ELSE p.m END
              JOIN {{lattice_nodes}} b ON b.node = CASE WHEN d.back = 0 THEN p.m ELSE p.n END) x""",
    "obs": f"""SELECT id, hazard_class, polarity, node, observed_at, received_at, source_class, source_id, depth_mm,
        {_lat('node')} + ((id * 31) % 41 - 20) / 10000e0 AS lat, {_lon('node')} + ((id * 17) % 41 - 20) / 10000e0 AS lon
        FROM (SELECT event_id AS id,
              CASE event_type WHEN 'error' THEN 'flood' WHEN 'click' THEN 'waterlogging' WHEN 'view' THEN 'accident' WHEN 'purchase' THEN 'closure' ELSE 'debris' END AS hazard_class,
              CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS polarity,
              CASE WHEN event_id % 5 = 0 THEN event_id % 7 ELSE (event_id * 7919) % c.n END AS node,
              ts AS observed_at, ts + INTERVAL '1' MINUTE * (event_id % 180) AS received_at,
              CASE user_id % 5 WHEN 0 THEN 'municipal_sensor' WHEN 1 THEN 'official_feed' WHEN 2 THEN 'verified_responder' WHEN 3 THEN 'crowd' ELSE 'app_traversal' END AS source_class,
              concat('u', CAST(user_id AS VARCHAR(20))) AS source_id, CASE WHEN event_id % 3 = 0 THEN value END AS depth_mm
              FROM {{events}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c) x""",
    "obs_edge": "SELECT o.*, e.edge_id, CAST((o.id * 13) % 320 AS DOUBLE) AS distance_m FROM {obs} o JOIN {lattice_edges} e ON e.edge_id = 4 * o.node + o.id % 4",
    "edge_prior": "SELECT edge_id, ((edge_id * 37) % 97 + 2) / 250e0 AS prior_p FROM {lattice_edges}",
    "way_points": f"""SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey AS node,
        {_lat('l_partkey')} AS lat, {_lon('l_partkey')} AS lon,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'trunk' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'tertiary' ELSE 'residential' END AS highway,
        CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN '-1' ELSE 'no' END AS oneway
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "zones": f"""SELECT zone_id, category, area, {_lat('node')} + ((zone_id * 31) % 41 - 20) / 10000e0 AS lat, {_lon('node')} + ((zone_id * 17) % 41 - 20) / 10000e0 AS lon
        FROM (SELECT s_suppkey AS zone_id, (s_suppkey * 37) % c.n AS node,
              CASE s_suppkey % 5 WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'High' ELSE 'Very High' END AS category, abs(s_acctbal) AS area
              FROM {{supplier}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c) x""",
    "regions": f"""SELECT n_nationkey AS region_id, ring, seq, {_lat('n_nationkey * 47')} + r * sin(radians(60e0 * seq + 10e0)) AS lat, {_lon('n_nationkey * 47')} + r * cos(radians(60e0 * seq + 10e0)) AS lon
        FROM {{nation}} JOIN (SELECT 0 AS ring, 0.03e0 AS r UNION ALL SELECT 1 AS ring, 0.012e0 AS r) k ON ring = 0 OR n_nationkey % 5 = 0
        CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) q""",
    "readings": "SELECT o_custkey % 60 AS gauge, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN -1e0 ELSE (o_totalprice / 100e0) % 120e0 END AS mm FROM {orders}",
    "gauge_daily": "SELECT gauge, day, max(mm) AS mm FROM {readings} WHERE mm >= 0 GROUP BY gauge, day",
    "events_a": "SELECT o_orderkey AS event_id, o_custkey % 25 AS district, o_custkey % 7 AS state, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate + INTERVAL '1' DAY * (o_orderkey % 9) AS DATE) AS last_day FROM {orders} WHERE o_orderkey % 40 = 0",
    "events_b": "SELECT o_orderkey AS event_id, o_custkey % 25 AS district, o_custkey % 7 AS state, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate + INTERVAL '1' DAY * (o_orderkey % 9) AS DATE) AS last_day FROM {orders} WHERE o_orderkey % 40 = 1",
    "catalogue_a": "SELECT o_orderkey AS event_id, o_custkey % 25 AS district, o_custkey % 7 AS state, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate + INTERVAL '1' DAY * (o_orderkey % 9) AS DATE) AS last_day FROM {orders} WHERE o_orderkey % 2 = 0",
    "catalogue_b": "SELECT o_orderkey AS event_id, o_custkey % 25 AS district, o_custkey % 7 AS state, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate + INTERVAL '1' DAY * (o_orderkey % 9) AS DATE) AS last_day FROM {orders} WHERE o_orderkey % 2 = 1",
    "rain_slices": "SELECT slot, avg(value / 20e0) AS mean_mm_h, max(value / 20e0) AS peak_mm_h, count(*) AS n FROM (SELECT CAST(floor(EPOCH(ts) / 1800e0) AS BIGINT) * 1800 AS slot, value FROM {events}) x GROUP BY slot",
    "routes": "SELECT w.way AS route, w.seq, w.node AS edge_id FROM {way_points} w JOIN {lattice_edges} e ON e.edge_id = w.node",
    "field_log": """SELECT event_id AS entry_id, CASE WHEN user_id % 9 = 0 THEN 'adhoc' ELSE concat('site_', CAST(user_id % 40 AS VARCHAR(10))) END AS site_id,
        CASE event_id % 4 WHEN 0 THEN 'passable' WHEN 1 THEN 'not_passable' WHEN 2 THEN 'not_passable' ELSE 'unknown' END AS state,
        CASE WHEN event_id % 77 = 0 THEN 'knee' WHEN event_id % 4 = 1 THEN 'ankle' END AS depth_band,
        CASE WHEN user_id % 9 = 0 AND event_id % 5 > 0 THEN 12.75e0 + (event_id % 97) * 0.0123456e0 END AS lat, CASE WHEN user_id % 9 = 0 AND event_id % 5 > 0 THEN 79.95e0 + (event_id % 89) * 0.0123456e0 END AS lon,
        concat('v', CAST(user_id AS VARCHAR(20))) AS volunteer, ts AS observed_at, ts + INTERVAL '1' MINUTE * (event_id % 180) AS received_at FROM {events}""",
    "server_log": "SELECT entry_id, site_id, state, depth_band, volunteer, observed_at FROM {field_log} WHERE entry_id % 3 <> 0",
    "phone_log": "SELECT entry_id, site_id, CASE WHEN entry_id % 50 = 0 THEN 'unknown' ELSE state END AS state, depth_band, volunteer, observed_at, CASE WHEN entry_id % 26 = 0 THEN 'rejected' WHEN entry_id % 4 = 0 THEN 'queued' ELSE 'synced' END AS sync_status FROM {field_log} WHERE entry_id % 2 = 0",
    "scored": "SELECT l.doc_id AS id, l.quality AS y, (d.n_chars % 1000) / 1000e0 AS score, (d.n_chars % 777) / 777e0 AS score_b, d.lang AS grp, d.source AS block, 1e0 + l.doc_id % 3 AS w FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id",
    "link_loss": "SELECT user_id AS link, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE WHEN event_id % 13 <> 0 THEN 40e0 + value / 20e0 END AS loss FROM {events}",
    "traces": "SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) * 3e0 - 100e0 + (event_id % 5) AS s FROM {events}",
    "gazetteer": "SELECT e.vec_id AS place_id, p.p_name AS name, e.label AS kind, e.embedding FROM {embeddings} e JOIN {part} p ON p.p_partkey = e.vec_id",
    "named_places": f"""SELECT place_id, name, concat('NH ', CAST(p.p_size AS VARCHAR(9)), ' ', p.p_type, '-road') AS other, CASE kind WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'street' WHEN 3 THEN 'suburb' WHEN 4 THEN 'quarter' WHEN 5 THEN 'village' ELSE 'stop' END AS kind,
        {_lat('place_id')} AS lat, {_lon('place_id')} AS lon, place_id % 50 AS size FROM {{gazetteer}} JOIN {{part}} p ON p.p_partkey = place_id""",
    "place_queries": f"""SELECT p_partkey AS query_id, CASE p_partkey % 120 WHEN 0 THEN p_name WHEN 20 THEN substr(p_name, 1, 5) WHEN 40 THEN concat('NH-', CAST(p_size AS VARCHAR(9))) WHEN 60 THEN concat('nh', CAST(p_size AS VARCHAR(9)), ' road') WHEN 80 THEN substr(p_name, 2, 6) ELSE concat(substr(p_name, 1, 2), '  ', CAST(p_size % 10 AS VARCHAR(9))) END AS q,
        CASE WHEN p_partkey % 40 = 0 THEN {_lat('p_partkey')} END AS lat, CASE WHEN p_partkey % 40 = 0 THEN {_lon('p_partkey')} END AS lon FROM {{part}} WHERE p_partkey % 20 = 0""",
    "approach": "SELECT user_id AS pass, CAST(step AS DOUBLE) AS t, -140e0 + 3e0 * step - least(90e0, greatest(0e0, (step - 15) * 3e0)) * CASE WHEN user_id % 3 = 0 THEN 0e0 ELSE 1e0 END + (event_id % 7) / 10e0 AS s FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM {events}) x",
    "grid": "SELECT CAST(floor(p_partkey / 50e0) AS BIGINT) AS row, p_partkey % 50 AS col, ((p_partkey * 37) % 997) / 10e0 AS elev FROM {part}",
    "panel": "SELECT gauge AS district, day, coalesce(max(mm), 0e0) AS mm, CASE WHEN max(mm) >= 100 THEN 1 ELSE 0 END AS y FROM {gauge_daily} GROUP BY gauge, day",
}
