"""Text checks, places and records as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazardspark.operators import places, textchecks
from hazardspark.plans.registry import Tables, query
from hazardspark.tables import written

c, r6 = F.col, lambda x: F.round(x, 6)


@query("x1_ground_quotes", """WITH e AS (SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN item_id + 100000 ELSE item_id END AS item, CASE item_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN substr(text, 1, 20) WHEN 2 THEN 'never said in there' ELSE substr(text, 3, 30) END AS quote, CASE WHEN item_id % 3 = 0 THEN 'nowhere' ELSE substr(text, 1, 4) END AS place FROM {benchmark})
    SELECT e.id, CASE WHEN b.text IS NULL THEN 'no source' WHEN length(quote) < 12 THEN 'short quote' WHEN NOT contains(b.text, quote) THEN 'not in source'
    WHEN NOT len(list_filter(regexp_split_to_array(regexp_replace(b.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(s, quote) AND contains(s, place))) > 0 THEN 'place elsewhere' END AS reason FROM e LEFT JOIN {benchmark} b ON b.item_id = e.item""")
def _(t: Tables):
    k = c("item_id")
    quote = F.when(k % 4 == 0, "short").when(k % 4 == 1, F.substring("text", 1, 20)).when(k % 4 == 2, "never said in there").otherwise(F.substring("text", 3, 30))
    rows = t.benchmark.select(k.alias("id"), F.when(k % 5 == 0, k + 100000).otherwise(k).alias("item"), quote.alias("quote"), F.when(k % 3 == 0, "nowhere").otherwise(F.substring("text", 1, 4)).alias("place"))
    return textchecks.ground_quotes(rows, t.benchmark.select(k.alias("item"), "text"))


def _word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p\x01L\x02\\p\x01N\x02]+'), lambda w: w <> '')"


@query("x8_ngram_overlap", f"""WITH d AS (SELECT doc_id AS doc, {_word_list('text')} AS ws FROM {{documents}}), s AS (SELECT item_id AS source, {_word_list('text')} AS ws FROM {{benchmark}}),
    dg AS (SELECT doc, unnest(range(len(ws) - 5)) AS pos, ws FROM d WHERE len(ws) >= 6), sg AS (SELECT source, unnest(range(len(ws) - 5)) AS pos, ws FROM s WHERE len(ws) >= 6),
    h AS (SELECT DISTINCT doc, source, dg.pos FROM dg JOIN sg ON array_to_string(dg.ws[dg.pos + 1:dg.pos + 6], ' ') = array_to_string(sg.ws[sg.pos + 1:sg.pos + 6], ' ')),
    r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc, source ORDER BY pos) AS run FROM h) SELECT doc, source, min(pos) AS first, count(*) + 5 AS words FROM r GROUP BY doc, source, run""")
def _(t: Tables):
    rows = textchecks.ngram_runs(t.documents.select(c("doc_id").alias("doc"), "text"), t.benchmark.select(c("item_id").alias("source"), "text"))
    return rows.select("doc", "source", c("first").cast("long").alias("first"), "words")


@query("x14_distinct_n", f"""WITH d AS (SELECT lang, {_word_list('text')} AS ws FROM {{documents}}), g AS (SELECT lang, array_to_string(ws[p + 1:p + 3], ' ') AS g FROM (SELECT lang, ws, unnest(range(len(ws) - 2)) AS p FROM d WHERE len(ws) >= 3) q) SELECT lang, round(count(DISTINCT g) / count(*), 6) AS distinct_n, count(*) AS grams FROM g GROUP BY lang""")
def _(t: Tables):
    return textchecks.distinct_n(t.documents, "lang", 3).select("lang", r6(c("distinct_n")).alias("distinct_n"), "grams")


@query("x13_label_eval", "WITH d AS (SELECT source, lang, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS p FROM {documents}) SELECT source, round(avg(CASE WHEN p = lang THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN p IS NULL THEN 1e0 ELSE 0e0 END), 6) AS unparseable, count(*) AS n FROM d GROUP BY ROLLUP (source)")
def _(t: Tables):
    p = F.when(c("doc_id") % 13 == 0, None).when(c("doc_id") % 5 == 0, "en").otherwise(c("lang"))
    return textchecks.label_eval(t.documents.withColumn("p", p), "lang", "p", "source").select("source", r6(c("accuracy")).alias("accuracy"), r6(c("unparseable")).alias("unparseable"), "n")


@query("w14_latest_decision", "SELECT node, id FROM (SELECT node, id, row_number() OVER (PARTITION BY node ORDER BY received_at DESC, id DESC) AS r FROM {obs}) x WHERE r = 1")
def _(t: Tables):
    return textchecks.latest_decision(t.obs, ["node"], [F.desc("received_at"), F.desc("id")]).select("node", "id")


@query("w15_duplicate_of", """SELECT a.id, (SELECT arg_min(b.id, EPOCH(b.observed_at)) FROM {obs} b WHERE b.node = a.node AND b.hazard_class = a.hazard_class AND b.source_class = a.source_class AND EPOCH(b.observed_at) BETWEEN EPOCH(a.observed_at) - 7200 AND EPOCH(a.observed_at) - 1) AS duplicate_of FROM {obs} a""")
def _(t: Tables):
    items = t.obs.select("id", F.unix_timestamp("observed_at").alias("t"), c("node").alias("place"), c("hazard_class").alias("condition"), c("source_class").alias("source"))
    return textchecks.duplicate_of(items, 7200)


_RANKS = "ra AS (SELECT kind AS query, place_id AS id, row_number() OVER (PARTITION BY kind ORDER BY name, place_id) AS rank FROM {gazetteer}), rb AS (SELECT kind AS query, place_id AS id, row_number() OVER (PARTITION BY kind ORDER BY (place_id * 7919) % 1009, place_id) AS rank FROM {gazetteer} WHERE place_id % 3 > 0)"


@query("t2_fused_top_k", f"WITH {_RANKS}, s AS (SELECT coalesce(ra.query, rb.query) AS query, coalesce(ra.id, rb.id) AS id, round(coalesce(1e0 / (60 + ra.rank), 0e0) + coalesce(1e0 / (60 + rb.rank), 0e0), 12) AS score FROM ra FULL JOIN rb ON ra.query = rb.query AND ra.id = rb.id) SELECT query, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) x WHERE place <= 5")
def _(t: Tables):
    number = lambda *o: F.row_number().over(Window.partitionBy("kind").orderBy(*o)).alias("rank")
    a = t.gazetteer.select(c("kind").alias("query"), c("place_id").alias("id"), number("name", "place_id"))
    b = t.gazetteer.filter("place_id % 3 > 0").select(c("kind").alias("query"), c("place_id").alias("id"), number((c("place_id") * 7919) % 1009, "place_id"))
    return textchecks.fused_top_k(a, b, 5).select("query", "id", "place")


@query("t3_rank_places", """SELECT place_id, rank FROM (SELECT place_id, kind, name, CASE WHEN lower(name) = 'small ring' THEN 0 WHEN starts_with(lower(name), 'small ring') THEN 1 WHEN list_contains(string_split(lower(name), ' '), 'small') AND list_contains(string_split(lower(name), ' '), 'ring') THEN 2 END AS rank FROM {gazetteer}) x WHERE rank IS NOT NULL ORDER BY rank, kind, length(name), name, place_id LIMIT 10""")
def _(t: Tables):
    return places.rank_places(t.gazetteer, "small ring", 10).select("place_id", "rank")


@query("x11_vector_candidates", """WITH q AS (SELECT place_id AS query, embedding AS asked FROM {gazetteer} WHERE place_id % 20 = 0), p AS (SELECT q.query, g.place_id AS id, list_dot_product(g.embedding::DOUBLE[], q.asked::DOUBLE[]) / sqrt(list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[]) * list_dot_product(q.asked::DOUBLE[], q.asked::DOUBLE[])) AS cos FROM {gazetteer} g CROSS JOIN q)
    SELECT query, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, id) AS rank FROM p) x WHERE rank <= 20""")
def _(t: Tables):
    asked = t.gazetteer.filter("place_id % 20 = 0").select(c("place_id").alias("query"), c("embedding").alias("asked"))
    return textchecks.vector_top_k(t.gazetteer, asked, 20).select("query", "id", "rank")


@query("x11_vector_candidates_pivots", """WITH q AS (SELECT place_id AS query, embedding AS asked FROM {gazetteer} WHERE place_id % 20 = 0), p AS (SELECT q.query, g.place_id AS id, list_dot_product(g.embedding::DOUBLE[], q.asked::DOUBLE[]) / sqrt(list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[]) * list_dot_product(q.asked::DOUBLE[], q.asked::DOUBLE[])) AS cos FROM {gazetteer} g CROSS JOIN q)
    SELECT query, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, id) AS rank FROM p) x WHERE rank <= 20""")
def _(t: Tables):
    asked = t.gazetteer.filter("place_id % 20 = 0").select(c("place_id").alias("query"), c("embedding").alias("asked"))
    return textchecks.vector_top_k_by_pivots(t.gazetteer, asked, 20, written)[0].select("query", "id", "rank")


@query("x6_ungrounded_numbers", "SELECT event_id, len(list_distinct(list_filter(regexp_extract_all('passed ' || value || ' of ' || event_id % 9, '[0-9]+(\\.[0-9]+)?'), lambda x: x <> CAST(event_id % 9 AS VARCHAR)))) AS n FROM {events}")
def _(t: Tables):
    text = F.concat(F.lit("passed "), c("value").cast("string"), F.lit(" of "), (c("event_id") % 9).cast("string"))
    return t.events.select("event_id", F.size(textchecks.ungrounded_numbers(text, F.array((c("event_id") % 9).cast("string")))).cast("long").alias("n"))


@query("x7_split_leakage", """WITH t AS (SELECT conv_id, conv_id % 5 = 0 AS val, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM {conversations} WHERE role = 'user') SELECT DISTINCT a.conv_id FROM t a WHERE a.val AND EXISTS (SELECT 1 FROM t b WHERE NOT b.val AND b.q = a.q)""")
def _(t: Tables):
    from hazardspark.functions.rules import norm_text

    asked = t.conversations.filter("role = 'user'").select("conv_id", norm_text(c("text")).alias("q"))
    return asked.filter("conv_id % 5 = 0").join(asked.filter("conv_id % 5 <> 0").select("q"), "q", "left_semi").select("conv_id").distinct()


_PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}]', ' ', 'g'), ' +', ' ', 'g'))".replace("{", "\x01").replace("}", "\x02")


@query("x7_leaking_questions", f"""WITH t AS (SELECT doc_id, doc_id % 5 = 0 AS val, {_PLAIN} AS q FROM {{documents}} WHERE text IS NOT NULL), s AS (SELECT q, count(*) FILTER (WHERE val) AS in_val, count(*) FILTER (WHERE NOT val) AS in_train, min(doc_id) FILTER (WHERE NOT val) AS source FROM t GROUP BY q)
    SELECT t.doc_id, s.source, s.in_val, s.in_train FROM t JOIN s ON s.q = t.q WHERE t.val AND in_train > 0""")
def _(t: Tables):
    return textchecks.split_leakage(t.documents.filter("text IS NOT NULL").select("doc_id", "text", (c("doc_id") % 5 == 0).alias("val")), "doc_id", "text", "val")


@query("u4_set_diff", "SELECT c_custkey AS node FROM {customer} EXCEPT SELECT node FROM {obs}")
def _(t: Tables):
    return t.customer.select(c("c_custkey").alias("node")).subtract(t.obs.select("node"))


@query("j18_semi_anti", "SELECT item_id FROM {benchmark} WHERE item_id NOT IN (SELECT vec_id FROM {embeddings} WHERE vec_id % 2 = 0)")
def _(t: Tables):
    known = t.embeddings.filter("vec_id % 2 = 0").select(c("vec_id").alias("item_id"))
    return t.benchmark.join(known, "item_id", "left_anti").select("item_id")


@query("s3_parquet_columns", "SELECT l_orderkey, sum(l_quantity) AS q FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' GROUP BY l_orderkey")
def _(t: Tables):
    rows = t.lineitem.filter(c("l_shipdate") >= F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
