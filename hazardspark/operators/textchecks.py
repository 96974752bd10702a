"""Checks of mined text: grounding, shared runs of words, matches and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.tables import spread


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined. The tokens are bound once by the outer transform, so the cost is linear in them."""
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    found = F.transform(F.array(tokens), lambda ws: F.when(F.size(ws) >= n, runs(ws)).otherwise(F.array().cast("array<string>")))
    return F.element_at(found, 1)


def ground_quotes(events: DataFrame, sources: DataFrame) -> DataFrame:
    """events (id, item, quote, place) with reason: null where the quote has 12 characters or more, is in its source, and the place is in
    the same sentence."""
    rows = events.join(sources, "item", "left")
    sentence = F.exists(F.split("text", r"(?<=[.!?])\s+"), lambda s: s.contains(F.col("quote")) & s.contains(F.col("place")))
    reason = F.when(F.col("text").isNull(), "no source").when(F.char_length("quote") < 12, "short quote").when(~F.contains("text", "quote"), "not in source").when(~sentence, "place elsewhere")
    return rows.select("id", reason.alias("reason"))


def _hashed_grams(texts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, pos, h1, h2): all runs of n words of `text`, as two independent 64-bit hashes. Words are hashed one by one in the JVM and a run's
    hash is that of its n words' hashes, so no run is built as text and 16 bytes of it are shuffled."""
    ws = F.transform(words(F.col("text")), lambda w: F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(1), w).alias("b")))
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(*(F.xxhash64(*(w[i + k][c] for k in range(n))).alias(f"h_{c}") for c in "ab")))
    found = F.transform(F.array(ws), lambda w: F.when(F.size(w) >= n, runs(w)))[0]
    rows = spread(texts.select(key, "text")).select(key, F.posexplode(found).alias("pos", "g"))
    return rows.select(key, "pos", F.col("g.h_a").alias("h1"), F.col("g.h_b").alias("h2"))


def ngram_runs(draft: DataFrame, sources: DataFrame, n: int = 6) -> DataFrame:
    """Runs of the draft's words shared with a source for n words or more: (doc, source, first, words). Runs of n words meet by 128 bits of
    hash, and starts that follow each other are merged. draft: doc, text; sources: source, text."""
    theirs = _hashed_grams(sources, "source", n).select("source", "h1", "h2").distinct()
    hits = _hashed_grams(draft, "doc", n).join(theirs, ["h1", "h2"]).select("doc", "source", "pos").distinct()
    w = Window.partitionBy("doc", "source").orderBy("pos")
    runs = hits.withColumn("run", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("doc", "source", "run").agg(F.min("pos").alias("first"), (F.count("*") + n - 1).alias("words")).drop("run")


def distinct_n(texts: DataFrame, by: str, n: int) -> DataFrame:
    """(by, distinct_n, grams): the share of different runs of n words among all of them. Runs are told apart by 128 bits of hash."""
    grams = _hashed_grams(texts, by, n).groupBy(by, "h1", "h2").agg(F.count("*").alias("k"))
    return grams.groupBy(by).agg((F.count("*") / F.sum("k")).alias("distinct_n"), F.sum("k").alias("grams"))


def label_eval(df: DataFrame, gold: str, predicted: str, by: str) -> DataFrame:
    """Accuracy and share of unparseable (null) predictions, by a column and over all (null)."""
    right = F.coalesce(F.col(gold) == F.col(predicted), F.lit(False)).cast("double")
    return df.rollup(by).agg(F.avg(right).alias("accuracy"), F.avg(F.col(predicted).isNull().cast("double")).alias("unparseable"), F.count("*").alias("n"))


def latest_decision(log: DataFrame, key: list[str], order: list) -> DataFrame:
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def duplicate_of(items: DataFrame, window_s: int) -> DataFrame:
    """(id, duplicate_of): the earliest item before it (of one time, the smallest id) of the same place, condition and source within the
    window. items: id, t, place, condition, source."""
    w = Window.partitionBy("place", "condition", "source").orderBy("t").rangeBetween(-window_s, -1)
    return items.select("id", F.min_by("id", F.struct("t", "id")).over(w).alias("duplicate_of"))


def fused_top_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion: a and b (query, id, rank) -> the k best of sum 1 / (60 + rank), ties by id."""
    both = a.select("query", "id", F.col("rank").alias("ra")).join(b.select("query", "id", F.col("rank").alias("rb")), ["query", "id"], "full")
    score = F.coalesce(1 / (60 + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (60 + F.col("rb")), F.lit(0.0))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return both.select("query", "id", F.round(score, 12).alias("score")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_top_k(places: DataFrame, queries: DataFrame, k: int, block_bytes: int = 4 << 20) -> DataFrame:
    """(query, id, rank) of the k nearest places by cosine (to 12 decimals, ties by id). queries: query, asked.

    Queries are taken in blocks of about block_bytes, by hash, each the only data that is sent out; places (place_id, embedding) stay
    where they are, and a task keeps the k best of its own rows for each query of the block, PAIRS_AT_ONCE cosines at a time. A null or zero vector is near to none.
    """
    width = (queries.agg(F.max(F.size("asked"))).first()[0] or 1) * 8
    blocks = max(1, -(-queries.count() * width // block_bytes))
    best = [_block_top_k(places, queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect(), k) for b in range(blocks)]  # block_bytes each
    tops = best[0]
    for b in best[1:]:
        tops = tops.unionByName(b)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "id"))
    return tops.withColumn("rank", place).filter(F.col("rank") <= k)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, np.nan)


#: Cosines that a task holds at once.
PAIRS_AT_ONCE = 1 << 20


def _block_top_k(places: DataFrame, block: list, k: int) -> DataFrame:
    block = [r for r in block if r["asked"] is not None]
    asked = _unit([r["asked"] for r in block]) if block else np.zeros((0, 0))
    names = np.array([r["query"] for r in block], np.int64)

    def tops(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(names), -np.inf)  # each query's k-th best so far

        def first_k() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((ids, -cos, row))
            r = row[order]
            order = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
            return row[order], ids[order], cos[order]

        step = max(1, PAIRS_AT_ONCE // max(1, len(names)))
        for b in it:
            b = b.filter(b["embedding"].is_valid())
            for lo in range(0, b.num_rows if len(names) else 0, step):
                some = b.slice(lo, step)
                near = np.round(asked @ _unit(some["embedding"].to_pylist()).T, 12)
                q, j = np.nonzero(near >= floor[:, None])  # not those without a cosine
                row, ids, cos = np.concatenate([row, q]), np.concatenate([ids, some["place_id"].to_numpy()[j]]), np.concatenate([cos, near[q, j]])
                if len(row) > 2 * k * len(names):
                    row, ids, cos = first_k()
                    full = np.flatnonzero(np.bincount(row, minlength=len(names)) == k)
                    floor[full] = cos[np.searchsorted(row, full, "right") - 1]
        row, ids, cos = first_k()
        columns = [names[row], ids, cos]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query", "id", "cos"])

    return places.select(F.col("place_id").cast("long"), "embedding").mapInArrow(tops, "query long, id long, cos double")


def _finite(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which of the given ones have a direction."""
    x = _unit(vectors)
    ok = np.isfinite(x).all(axis=1)
    return x[ok], ok


def vector_top_k_by_pivots(places: DataFrame, queries: DataFrame, k: int, written: Callable[[DataFrame, str], DataFrame], pivots: int = 32, unit: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(query, id, rank) as `vector_top_k` has them, and one row with how many pairs were compared out of all.

    Places lie with the nearest (by angle) of some pivots, which are places drawn by hash; each pivot knows its farthest place. A query is
    first held against its own pivot's places, which bounds its k-th angle t. Only pivots whose ball can hold a place within t are met
    then, and of their places only those whose angle to the pivot differs from the query's by t at most (triangle inequality), so no
    place that belongs to the first k is missed. Places and queries of a pivot are cut by hash into units of about `unit`, so a hot pivot
    is no single task. What is saved depends on the data: clustered vectors much, random ones of many dimensions next to nothing.
    """
    drawn = places.filter("embedding IS NOT NULL").orderBy(F.xxhash64("place_id"), "place_id").limit(pivots).collect()
    centre, _ = _finite([r["embedding"] for r in drawn]) if drawn else (np.zeros((0, 1)), None)
    if not len(centre):
        none = places.sparkSession.createDataFrame([], "query long, id long, cos double, rank int")
        return none, places.sparkSession.createDataFrame([(0, 0)], "compared long, pairs long")

    def dealt(key: str, vector: str, all_angles: bool):
        def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                b = b.filter(b[vector].is_valid())
                if not b.num_rows:
                    continue
                x, ok = _finite(b[vector].to_pylist())
                angle = np.arccos(np.clip(x @ centre.T, -1, 1))
                own = angle.argmin(axis=1)
                seen = [row.tolist() for row in (angle if all_angles else np.take_along_axis(angle, own[:, None], 1))]
                yield pa.RecordBatch.from_arrays([b[key].filter(pa.array(ok)), pa.array(own, pa.int32()), pa.array(seen, pa.list_(pa.float64())), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "pivot", "angles", "v"])

        return deal

    shape = "id long, pivot int, angles array<double>, v array<double>"
    rows = written(places.select(F.col("place_id").cast("long").alias("place_id"), "embedding").mapInArrow(dealt("place_id", "embedding", False), shape), "pivot-places")
    asked = written(queries.select(F.col("query").cast("long").alias("query"), "asked").mapInArrow(dealt("query", "asked", True), shape), "pivot-queries")
    balls = rows.groupBy("pivot").agg(F.max(F.col("angles")[0]).alias("reach"), F.ceil(F.count("*") / unit).cast("int").alias("m"))  # a row for each pivot

    def best(found: pa.Table, ask: pa.Table) -> pa.Table:
        out = {"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "cos": np.zeros(0), "compared": np.zeros(0, np.int64)}
        if found.num_rows and ask.num_rows:
            vectors = lambda t: np.array(t["v"].to_pylist())
            near = np.array([a[0] for a in found["angles"].to_pylist()])
            close = np.abs(ask["angle"].to_numpy()[:, None] - near[None, :]) <= ask["most"].to_numpy()[:, None] + 1e-6
            cos = np.where(close, np.round(vectors(ask) @ vectors(found).T, 12), -np.inf)
            ids = np.tile(found["id"].to_numpy(), (ask.num_rows, 1))
            order = np.lexsort((ids, -cos), axis=1)[:, :k]
            top = np.take_along_axis(cos, order, 1).ravel()
            keep = np.isfinite(top)
            name = ask["id"].to_numpy()
            out["query"] = np.concatenate([np.repeat(name, order.shape[1])[keep], name])
            out["id"] = pa.array(np.concatenate([np.take_along_axis(ids, order, 1).ravel()[keep], name]), mask=np.arange(keep.sum() + len(name)) >= keep.sum())
            out["cos"] = np.concatenate([top[keep], np.zeros(len(name))])
            out["compared"] = np.concatenate([np.zeros(keep.sum(), np.int64), close.sum(axis=1)])  # a row without id counts what the query met
        return pa.table({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in out.items()})

    def met(ask: DataFrame) -> DataFrame:
        """ask (id, v, pivot, angle, most): the first k of each query in each unit."""
        shares = ask.groupBy("pivot").agg(F.ceil(F.count("*") / unit).cast("int").alias("mq")).join(balls.select("pivot", "m"), "pivot")
        part = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        a = ask.join(shares, "pivot").withColumns({"j": part("mq")}).withColumn("i", every("m")).select("pivot", "i", "j", "id", "v", "angle", "most")
        p = rows.join(shares, "pivot").withColumn("i", part("m")).withColumn("j", every("mq")).select(F.col("pivot").alias("p"), F.col("i").alias("pi"), F.col("j").alias("pj"), "id", "angles", "v")
        both = p.groupBy("p", "pi", "pj").cogroup(a.groupBy("pivot", "i", "j"))
        return written(both.applyInArrow(best, "query long, id long, cos double, compared long"), "pivot-tops")

    place = Window.partitionBy("query").orderBy(F.desc("cos"), "id")
    at = lambda p: F.element_at("angles", p + 1)
    first = met(asked.select("id", "v", "pivot", at(F.col("pivot")).alias("angle"), F.lit(4.0).alias("most")))
    bound = first.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == k).select(F.col("query").alias("id"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cos")))).alias("t"))
    rest = asked.withColumnRenamed("pivot", "own").join(bound, "id", "left").withColumn("most", F.coalesce("t", F.lit(4.0)))
    rest = rest.join(F.broadcast(balls.select("pivot", "reach")), (F.col("pivot") != F.col("own")) & (at(F.col("pivot")) - F.col("reach") <= F.col("most") + 1e-6))  # pivots: set number
    second = met(rest.select("id", "v", "pivot", at(F.col("pivot")).alias("angle"), "most"))
    tops = first.unionByName(second)
    ranked = tops.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    counts = tops.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    pairs = rows.agg(F.count("*").alias("n")).crossJoin(asked.agg(F.count("*").alias("m"))).select((F.col("n") * F.col("m")).alias("pairs"))  # one row each
    return ranked.select("query", "id", "cos", "rank"), counts.crossJoin(pairs)


def ungrounded_numbers(text: Column, facts: Column) -> Column:
    """Numbers of a text that are not among the facts (an array of strings)."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), facts)


def snap_quotes(events: DataFrame, sources: DataFrame, least: int = 4) -> DataFrame:
    """(id, sentence): the first sentence of the source that holds the place and every word of the quote; null where the quote has fewer
    than `least` words, or there is none. events: id, item, quote, place; sources: item, text."""
    spaced = lambda text: F.array_join(words(text), " ")
    rows = events.join(sources, "item", "left").withColumns({"__asked": words(F.col("quote")), "__place": spaced(F.col("place"))})
    fits = lambda s: F.contains(spaced(s), F.col("__place")) & (F.size(F.array_except("__asked", words(s))) == 0)
    found = F.trim(F.get(F.filter(F.split("text", r"(?<=[.!?])\s+"), fits), F.lit(0)))
    return rows.select("id", F.when(F.size("__asked") >= least, found).alias("sentence"))


#: Words and phrases of the record rules.
INTENTS = [
    "why_route", "time_distance", "alternatives", "avoided_streets", "route_hazard", "is_safe", "should_go", "confidence", "data_gaps", "travel_mode",
    "event_state", "accidents", "limits", "departure_time", "offline", "how_it_works", "help", "summary", "out_of_scope",
]
FALLBACK, REFUSAL, HEDGE = "I cannot answer that from the route data", "I cannot confirm the condition of any road", "use your own judgement"
BANNED = r"(?i)\b(safe|safely|safest|unsafe|dry|clear|open|passable|fine|ok|okay|guaranteed)\b|go ahead|green light"


def record_problems(split: Column, locale: Column, question: Column, intent: Column, sheet: Column, answer: Column, headline: Column, names: Column) -> Column:
    """Problems of a question-and-answer record with one answer, as an array in a fixed order. sheet: the facts as text; names: street
    names of the sheet (array), which are taken out of the answer before its words and numbers are read."""
    bare = F.aggregate(names, answer, lambda s, n: F.replace(s, n, F.lit(" ")))
    low = F.coalesce(F.regexp_extract(sheet, r"confidence: (\w+)", 1).isin("low", "stale"), F.lit(False))
    english = locale == "en"
    known = F.regexp_extract_all(sheet, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    found = F.array(
        F.when(~split.isin("train", "val"), "split"),
        F.when(~locale.isin("en", "ta"), "locale"),
        F.when(~intent.isin(*INTENTS), "intent"),
        F.when((F.trim(question) == "") | (F.char_length(question) > 200), "question"),
        F.when(F.trim(answer) == "", "empty"),
        F.when(answer.startswith(FALLBACK), "fallback"),
        F.when(english & bare.rlike(BANNED), "banned"),
        F.when(english & (F.size(ungrounded_numbers(bare, known)) > 0), "number"),
        F.when(english & (intent == "is_safe") & ~answer.contains(REFUSAL), "refusal"),
        F.when(english & low & ~answer.contains(HEDGE), "hedge"),
        F.when(~answer.startswith(headline), "headline"),
    )
    return F.filter(found, lambda x: x.isNotNull())


#: Capitalised words that are no names; marks of a hedge; phrases, patterns and stems that claim safety.
NO_NAMES = ["Route", "It", "This", "That", "There", "No", "Not", "Use", "Your", "You", "We", "I", "The", "A", "An", "Hazard", "Data", "Confidence", "Always", "Its", "For", "On", "At", "Is", "Are"]
HEDGES = [
    "unverified", "unconfirmed", "limited", "no recent data", "not confirmed", "not a guarantee", "use your own judgement", "use your own judgment", "may not", "uncertain", "out of date", "don't have",
    "do not have", "no data", "not certain", "unclear", "low confidence", "stale", "தரவு குறைவு", "தகவல் குறைவு", "உங்கள் சொந்த முடிவை", "உறுதி இல்லை",
]
CLAIMS = [
    "is safe", "is clear", "is passable", "safe to drive", "safe to travel", "safe to use", "clear to drive", "clear to travel", "nothing to worry", "no issues", "no problem", "all clear", "should be fine",
    "perfectly fine", "completely safe", "totally safe", "guaranteed safe", "safe route", "safe option", "road is open and safe", "you can safely",
]
#: Patterns of claims, matched in lower case wherever they stand, also negated or hedged: a rejected sentence costs little.
CLAIM_PATTERNS = {
    "safe": r"\b(?:safe|safely|safest|safer|unsafe)\b",
    "dry": r"\b(?:dry|dried|dries|drying|drained|receded|recedes|subsided|clear|clears|cleared|clearing)\b",
    "open": r"\b(?:passable|open|opened|reopened|re-opened|usable|unblocked|unobstructed|unaffected)\b",
    "go": r"\bgo(?:ing)? ahead\b|\bgood to go\b|\bfeel free\b|\bproceed\b|\bcarry on\b",
    "fine": r"\b(?:fine|ok|okay)\b",
    "no hazard": r"\bno (?:water|flood(?:ing|s)?|waterlogging|hazards?|risks?|danger|dangers|problems?|issues?|obstruction|blockage|worries)\b|\bnot (?:flooded|waterlogged|blocked|at risk|dangerous)\b|\b(?:free|clear) (?:of|from) \w+|\b(?:hazard|risk|flood)[- ]free\b|\bzero risk\b",
    "no worry": r"\bnothing (?:to worry|wrong|dangerous|to fear)\b|\bno need to worry\b|\brelax\b",
    "promise": r"\b(?:won'?t|wouldn'?t|will not|would not) (?:flood|have|be flooded|face|see|encounter|meet|find|get)\b",
    "state change": r"\bno longer\b|\b(?:is|are|was|has been|have been) (?:over|gone|finished|ended)\b|\bhas (?:ended|stopped|passed)\b",
    "permission": r"\b(?:can|could|may|might|able to|allowed to)(?: be)?(?: able to)?\s+(?:safely\s+)?(?:pass|passed|cross|crossed|drive|ride|go|get through|travel|proceed|take|taken|use|used|continue)\b",
    "as usual": r"\b(?:is|are) (?:running|moving)\b|\bnormally\b|\bback to normal\b|\bas usual\b|\bit works\b",
}
TAMIL_CLAIMS = [
    "பாதுகாப்", "வறண்", "காய்ந்", "செல்லலாம்", "போகலாம்", "கடக்கலாம்", "தொடரலாம்", "திறந்", "தெளிவாக", "வெள்ளமின்றி", "வடிந்", "தேங்கவில்லை", "தண்ணீர் இல்லை", "நீர் இல்லை", "வெள்ளம் இல்லை",
    "பிரச்சனை இல்லை", "ஆபத்தும் இல்லை", "ஆபத்து இல்லா", "தடையும் இல்லை", "கவலைப்பட வேண்டாம்", "சரியாக உள்ளது",
]


def without_names(text: Column, names: Column) -> Column:
    return F.aggregate(names, text, lambda s, n: F.replace(s, n, F.lit(" ")))


def claim_kinds(text: Column, names: Column) -> Column:
    """The kinds of safety claims in a text, in the order of the list: 'phrase', those of CLAIM_PATTERNS, 'tamil' (stems, anywhere in a word).
    Names of places are taken out first."""
    lower = F.lower(without_names(text, names))
    phrase = F.exists(F.array(*map(F.lit, CLAIMS)), lambda p: F.contains(lower, p))
    tamil = F.exists(F.array(*map(F.lit, TAMIL_CLAIMS)), lambda p: F.contains(lower, p))
    found = [F.when(phrase, "phrase"), *(F.when(lower.rlike(p), k) for k, p in CLAIM_PATTERNS.items()), F.when(tamil, "tamil")]
    return F.array_compact(F.array(*found))


def explanation_faults(text: Column, facts: Column, names: Column, band: Column, tolerance: float = 0.05) -> Column:
    """Faults of an explanation as an array: 'numeral' (a number that no fact is near to), 'entity' (a capitalised word that is in no
    name), 'unhedged' (low or stale confidence without a hedge), 'claim' (road said to be safe). facts: numbers; names: words that may
    be capitalised, taken out before numbers and claims are read."""
    bare = without_names(text, names)
    numbers = F.transform(F.regexp_extract_all(bare, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    loose = F.exists(numbers, lambda x: ~F.exists(facts, lambda f: F.abs(f - x) <= tolerance))
    named = F.concat(F.array(*map(F.lit, NO_NAMES)), F.flatten(F.transform(names, lambda n: F.split(n, " "))))
    odd = F.size(F.array_except(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z']*\b"), F.lit(0)), named)) > 0
    lower = F.lower(text)
    hedged = F.exists(F.array(*map(F.lit, HEDGES)), lambda h: F.contains(lower, h))
    said = F.size(claim_kinds(text, names)) > 0
    faults = F.array(F.when(loose, "numeral"), F.when(odd, "entity"), F.when(band.isin("low", "stale") & ~hedged, "unhedged"), F.when(said, "claim"))
    return F.filter(faults, lambda x: x.isNotNull())


def split_leakage(rows: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """(key, source, in_val, in_train): held-out rows whose text, by its letters alone (lower case), also stands in the training part, with
    the lowest key there and how often it stands on either side. Texts are counted by key and side before they meet."""
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}]", " "), " +", " "))
    q = rows.select(key, held, F.sha2(letters, 256).alias("q"))
    side = q.groupBy("q").agg(F.count_if(held).alias("in_val"), F.count_if(~F.col(held)).alias("in_train"), F.min(F.when(~F.col(held), F.col(key))).alias("source"))
    return q.filter(held).join(side.filter("in_train > 0"), "q").select(key, "source", "in_val", "in_train")
