"""The thin queries of the operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm.chat import format_chats, read_chats
from hazardspark.llm.cotraining import score_quality
from hazardspark.llm.crossparse import held_out, identify, sample_texts
from hazardspark.llm.decontam import find_matches, n_hit
from hazardspark.llm.exact_dedup import exact_groups
from hazardspark.llm.line_dedup import dedup_lines
from hazardspark.llm.negatives import mine_negatives, quantised
from hazardspark.llm.packing import pack
from hazardspark.llm.ranked_search import ranked_search
from hazardspark.llm.secrets import scan_secrets
from hazardspark.llm.sharding import assign_shards
from hazardspark.llm.simhash import near_groups
from hazardspark.llm.token_files import read_token_files, token_file_path, write_token_files


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "page_score", "score", "keep")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), sample_texts(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = n_hit(F.col("matches"))
    return docs.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = token_file_path(spark)
    write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer or _tokenizer("word_bpe_49k.json"))
    docs = read_token_files(spark, path)
    return docs.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def packed_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    pieces = pack(docs, tokenizer or _tokenizer("byte_bpe_50k.json"))
    length = F.expr("octet_length(ids) div 4").cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packed_digests(_table(spark, sf_dir, "documents"), tokenizer)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    chats = read_chats(format_chats(turns.unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example", "live")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(vectors.withColumn("label", noisy))
    return mine_negatives(rows, rows.filter(F.col("id") % 100 == 0))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (op1_simhash, op2_quality, op3_language_id, op4_exact_dedup, op5_decontamination, op6_line_dedup, op7_token_files, op8_packing, op9_chat_formatting, op10_sharding)
    return {f.__name__: f for f in (*found, op11_secret_scans, op12_hard_negatives, op13_ranked_search)}


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _hits_sql(kind: int, pattern: str) -> str:
    """Matches of a pattern in every text t.text: row r, kind, start and value, from the pieces between the matches."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, start, v FROM (
  SELECT r, v, pos, sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT r, unnest(string_split_regex(text, '{pattern}')) AS gap, unnest(regexp_extract_all(text, '{pattern}')) AS v, generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS pos FROM t) x
  WINDOW w AS (PARTITION BY r ORDER BY pos)) y WHERE v IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    key = _either_case("password|passwd|secret|token|api_?key")
    sep = r"""["']?\x20*[:=]\x20*["']?"""
    key_sql = f"({key}){sep}".replace("'", "''")
    alive = r"len(list_distinct(string_split(s, ''))) >= 8 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '" + "|".join(map(_either_case, "example sample dummy changeme placeholder your xxxx".split())) + "|0123456789|123456789|" + _either_case("abcdefgh") + "')"
    esc = r"regexp_replace(text, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|image\|>|\|audio\|>|\|document\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')"
    return {
        "op11_secret_scans": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
h AS ({_hits_sql(0, f"(?:{key}){sep}[A-Za-z0-9+/_.=-]+")} UNION ALL {_hits_sql(1, "AKIA[A-Z0-9]{14,}")} UNION ALL {_hits_sql(2, "[0-9a-f]{16,}")} UNION ALL {_hits_sql(3, "[A-Za-z0-9+/_=-]{20,}")}),
f AS (SELECT r, kind, CAST(start AS BIGINT) AS a, CAST(start + length(v) AS BIGINT) AS b, CASE WHEN kind = 0 THEN regexp_replace(v, '^{key_sql}', '') ELSE v END AS s0, ['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(v) AS BIGINT) AS said FROM h),
e AS (SELECT *, regexp_replace(s0, '\.+$', '') AS s FROM f WHERE kind <> 0 OR length(s0) >= 12),
c AS (SELECT * FROM e WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM e o WHERE o.r = e.r AND o.kind < 3 AND o.a < e.b AND e.a < o.b)),
p AS (SELECT s, count(*) AS owners FROM (SELECT DISTINCT s, owner FROM c JOIN t USING (r)) x GROUP BY s),
k AS (SELECT r, kind, a, said, owners >= 3 AS example, owners = 1 AND {alive} AS live FROM c JOIN p USING (s)),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        string_agg(said, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live) AS spans,
        count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example AND kind < 3) AS n_example, string_agg(said, ',' ORDER BY a, kind) FILTER (WHERE live) AS live
      FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live, '') AS live
FROM t LEFT JOIN g USING (r)""",
        "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, id, label, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM v),
s AS (SELECT a.r AS ar, b.r AS br, a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM c a JOIN c b ON a.d = b.d AND a.r <> b.r WHERE a.id % 100 = 0 GROUP BY ALL),
p AS (SELECT ar, anchor_id, br, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.ar, p.br ORDER BY score DESC, s.id, s.br) QUALIFY row_number() OVER w <= 5""",
        "op13_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents WHERE text IS NOT NULL),
j AS (SELECT dense_rank() OVER (ORDER BY item_id, text) AS i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'))) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL) x),
g AS (SELECT count(*) AS n_docs, coalesce(sum(len(ws)), 0) AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) x GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, n_docs),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM j JOIN tf USING (term) JOIN w USING (term) JOIN d USING (r), g GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER k AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW k AS (PARTITION BY i ORDER BY score DESC, doc_id, r) QUALIFY row_number() OVER k <= 10""",
        "op9_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || '<|im_end|>') + 2 + length({esc}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
        "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t""",
        "op5_decontamination": rf"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item, k, array_to_string(ws[p + 1:p + k], ' ') AS words FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(len(ws) - least(10, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0) x),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
p AS (SELECT r, k, p, array_to_string(ws[p + 1:p + k], ' ') AS words FROM (SELECT r, ws, k, unnest(range(len(ws) - k + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM w) s WHERE len(ws) >= k) x),
h AS (SELECT DISTINCT r, p.k, p, item FROM p JOIN w ON w.k = p.k AND w.words = p.words),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, k, p FROM h) x) y GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) x GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN i ON i.r = d.r""",
        "op6_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.first_id <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    }
