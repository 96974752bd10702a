"""Place search, name similarity, matches without ids, stops of passes and clusters with moving centres, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.operators import matching, search, signals, studies
from hazardspark.plans.registry import Tables, query
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)

_NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _NORM.format(x=x).replace("{", "\x01").replace("}", "\x02")


@query("t3_search_places", f"""WITH q AS (SELECT query_id, {_norm('q')} AS q, lat AS qlat, lon AS qlon FROM {{place_queries}}),
    n AS (SELECT place_id, {_norm('name')} AS name FROM {{named_places}} UNION ALL SELECT place_id, {_norm('other')} FROM {{named_places}}),
    x AS (SELECT query_id, place_id, name, q, qlat, qlon, regexp_matches(q, '[0-9]') AS digits, regexp_matches(replace(name, ' ', ''), concat(replace(q, ' ', ''), '([^0-9]|$)')) AS number,
            len(list_filter(string_split(q, ' '), lambda w: NOT contains(name, w))) = 0 AS every, NOT contains(q, ' ') AS one FROM q JOIN n ON length(q) >= 2),
    k AS (SELECT query_id, place_id, any_value(qlat) AS qlat, any_value(qlon) AS qlon, min(CASE WHEN name = q THEN -1 WHEN starts_with(name, q) THEN 0 WHEN every AND (NOT digits OR number OR one) THEN 1 WHEN NOT every AND digits AND number THEN 1 END) AS name_rank FROM x GROUP BY query_id, place_id),
    f AS (SELECT query_id, name AS place, k.place_id, name_rank, size, CASE kind WHEN 'city' THEN 0 WHEN 'town' THEN 1 WHEN 'street' THEN 2 WHEN 'suburb' THEN 3 WHEN 'quarter' THEN 3 WHEN 'village' THEN 4 ELSE 5 END AS tier,
            sqrt(pow((lon - qlon) * 111320 * cos(radians(qlat)), 2) + pow((lat - qlat) * 110574, 2)) AS d FROM k JOIN {{named_places}} p ON p.place_id = k.place_id WHERE name_rank IS NOT NULL)
    SELECT query_id, place, place_id, row_number() OVER w AS rank, name_rank, tier, round(d, 3) AS distance_m FROM f WINDOW w AS (PARTITION BY query_id ORDER BY name_rank, tier, coalesce(d, 0), size DESC, place, place_id) QUALIFY row_number() OVER w <= 8""")
def _(t: Tables):
    places = t.named_places.select("place_id", F.array("name", "other").alias("names"), "kind", "lat", "lon", "size")
    return search.search_places(t.place_queries, places).withColumn("distance_m", F.round("distance_m", 3))


@query("w16_stops_in_pass", """WITH m AS (SELECT pass, t, median(s) OVER w AS sm, count(*) OVER (PARTITION BY pass) AS n FROM {approach} WINDOW w AS (PARTITION BY pass ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    v AS (SELECT pass, t, sm, CASE WHEN last_value(t) OVER w > first_value(t) OVER w THEN (last_value(sm) OVER w - first_value(sm) OVER w) / (last_value(t) OVER w - first_value(t) OVER w) ELSE 0 END < 1 AS slow FROM m WHERE n >= 5 WINDOW w AS (PARTITION BY pass ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    r AS (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY pass ORDER BY t) AS run FROM v),
    g AS (SELECT pass, run, min(t) AS a, max(t) AS b, median(sm) AS place FROM r WHERE slow GROUP BY pass, run HAVING max(t) - min(t) >= 3 AND median(sm) BETWEEN -120 AND 5)
    SELECT pass, max(a) AS "start", arg_max(b, a) AS "end", round(arg_max(place, a), 6) AS "where" FROM g GROUP BY pass""")
def _(t: Tables):
    return signals.stops_in_pass(t.approach).select("pass", "start", "end", r6(c("where")).alias("where"))


def name_pairs(t: Tables) -> DataFrame:
    """Each part's name and size class against the names of the next part: one pair a row."""
    text = F.concat_ws(" ", "p_name", "p_type", F.element_at(F.array(*map(F.lit, ["road", "junction", "", "subway"])), (c("p_partkey") % 4 + 1).cast("int")))
    a = t.part.select("p_partkey", text.alias("query"))
    b = t.part.select((c("p_partkey") - 1).alias("p_partkey"), F.array("p_name", F.concat_ws(" ", "p_type", "p_name")).alias("names"))
    return a.join(b, "p_partkey")


@query("f22_lexical_score")
def _(t: Tables):
    return matching.lexical_scores(name_pairs(t), "query", "names").select("p_partkey", r6(c("score")).alias("score"))


def mined_records(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Gold and mined records: reports by node (the item) and class, of which two in three name no place but a text."""
    text = F.element_at(F.array(*map(F.lit, ["North Gate", "gate", "the north gate road", "Lake", "big lake", "", "No. 4", "4"])), (c("id") * 31 % 8 + 1).cast("int"))
    rows = t.obs.select("id", (c("node") % 97).alias("item"), c("hazard_class").alias("condition"), c("id").alias("at"), F.when(c("id") % 3 == 0, c("id") % 5).alias("place_id"), text.alias("place_text"), "source_class")
    return rows.filter("id % 7 > 2"), rows.filter("id % 5 < 3")


@query("x3_match_by_text")
def _(t: Tables):
    gold, mined = mined_records(t)
    return matching.match_records(mined, gold, written)


@query("x4_miner_scores_by_text")
def _(t: Tables):
    gold, mined = mined_records(t)
    pairs = written(matching.match_records(mined, gold, written), "matches")
    both = pairs.join(gold.select(c("id").alias("gold_id"), "condition"), "gold_id").select("condition", F.lit(True).alias("in_gold"), F.lit(True).alias("in_mined"))
    alone = lambda df, key, g, m: df.join(pairs.select(c(key).alias("id")), "id", "left_anti").select("condition", F.lit(g).alias("in_gold"), F.lit(m).alias("in_mined"))
    rows = both.unionByName(alone(gold, "gold_id", True, False)).unionByName(alone(mined, "mined_id", False, True))
    return studies.mined_scores(rows, "condition").select("condition", "tp", *[r6(c(x)).alias(x) for x in ("precision", "recall", "f1")])


@query("m28_running_clusters")
def _(t: Tables):
    zones, clusters = studies.running_clusters(t.zones, [1000.0, 3000.0, 6000.0], written)
    centre = clusters.select("radius", "cluster", r6(c("lat")).alias("lat"), r6(c("lon")).alias("lon"), F.round("area", 2).alias("area"), "members")
    return zones.join(centre, ["radius", "cluster"]).select("radius", "zone_id", "cluster", "lat", "lon", "area", "members")
