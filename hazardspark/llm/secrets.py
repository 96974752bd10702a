"""Secrets in texts and how widely each candidate is spread: what many owners hold is a copied example, what one holds looks live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import written

#: The kinds of the contract, in the order in which spans with one start are listed; `bare` is this method's own.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_KEY = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Long runs of the characters of keys, without a keyword.
BARE = "[A-Za-z0-9+/_=-]{20,}"
#: What stands in examples and manuals.
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0123456789|123456789|abcdefgh"
_LEAST_ASSIGNED, _LEAST_LETTERS = 12, 8
_BLOCK = 64


def hits(text: Column, pattern: str) -> Column:
    """Array of (start, value) of all leftmost non-overlapping matches, in code points, as the pieces between the matches give it.

    Lengths are summed in blocks of 64 matches, so that growing the array does not cost the square of its length.
    """
    kind = "array<struct<start: int, value: string>>"
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def one(s, x):
        start = s["at"] + F.char_length(x["gap"])
        return F.struct((start + F.char_length(x["value"])).alias("at"), F.array_append(s["found"], F.struct(start.alias("start"), x["value"].alias("value"))).alias("found"))

    def block(s, part):
        inner = F.aggregate(part, F.struct(s["at"].alias("at"), F.expr(f"CAST(array() AS {kind})").alias("found")), one)
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.array_append(s["found"], i["found"]).alias("found")))[0]

    def whole(x):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{kind}>)").alias("found")), block)["found"])

    found = F.filter(F.transform(F.array(pieces), whole)[0], lambda h: h["value"].isNotNull())  # behind the last match is a piece without a value
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"CAST(array() AS {kind})"))


def _spans(found: Column, kind: int, value=lambda v: v, keep=lambda v: F.lit(True)) -> Column:
    """(start, kind, stop, hash, alive) of the matches that `keep` lets pass; the hash is of the value without dots at its end."""

    def span(h):
        secret = F.regexp_replace(value(h["value"]), r"\.+$", "")
        letters = F.size(F.array_distinct(F.split(secret, "")))
        alive = (letters >= _LEAST_LETTERS) & secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & ~secret.rlike(PLACEHOLDER)
        stop = h["start"] + F.char_length(h["value"])
        return F.struct(h["start"].alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.unhex(F.sha2(secret, 256)).alias("hash"), alive.alias("alive"))

    return F.transform(F.filter(found, lambda h: keep(h["value"])), span)


def _listed(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"], x["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", wide: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base (spans of these kinds as kind:start:end), spans (base, and bare
    values that look live), n_live, n_example, live (the spans, of any kind, whose value looks live).

    Candidates are the values of all spans and bare runs of 20 or more characters of keys. Their SHA-256 is counted over all documents
    by distinct repositories and owners; no value leaves its row. A value that `wide` owners or more hold is an example. One that a
    single owner holds (in however many repositories) is live if it has a digit, a letter, 8 different characters and nothing that
    stands in manuals; others are neither. A bare run that touches a base span is no candidate.

    A span is the whole match, in code points, end exclusive. Null and empty texts have no spans; a null owner or repository is one of
    its own; rows that repeat an id, null ids among them, are rows of their own; an empty table gives no rows. Only the named columns
    are read.

    Texts are read once and not moved. Counts are combined by (hash, owner, repository), then by (hash, owner), then by hash, so a value
    found everywhere meets in no task; giving spans their counts back is a join that adaptive execution splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("CAST(array() AS array<struct<start: int, kind: int, stop: int, hash: binary, alive: boolean>>)")
    by_kind = [
        _spans(F.col("assign"), 0, lambda v: F.regexp_replace(v, ASSIGN_KEY, ""), lambda v: F.char_length(F.regexp_replace(v, ASSIGN_KEY, "")) >= _LEAST_ASSIGNED),
        _spans(F.col("access"), 1),
        _spans(F.col("hex"), 2),
        _spans(F.col("bare"), 3),
    ]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))
    rows = rows.select("doc_id", "owner", "repo", *(hits(F.col("text"), p).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, BARE), strict=True)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", F.array_sort(F.concat(none, *by_kind)).alias("all"))
    rows = written(rows, "secret-spans")

    each = rows.filter("size(all) > 0").select("row", "owner", "repo", F.inline("all"))
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"left": F.max(F.when(F.col("kind") < 3, F.col("stop"))).over(before), "right": F.min(F.when(F.col("kind") < 3, F.col("start"))).over(behind)})
    apart = (F.coalesce("left", "start") <= F.col("start")) & (F.coalesce("right", "stop") >= F.col("stop"))
    each = written(each.filter((F.col("kind") < 3) | apart).drop("left", "right"), "secret-candidates")

    repos = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    spread = repos.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    known = each.join(spread, "hash").withColumns({"is_live": F.col("alive") & (F.col("owners") == 1), "is_example": F.col("owners") >= wide})
    span = F.struct("start", "kind", "stop", "is_live", "is_example")
    by_row = known.filter("kind < 3 OR is_live").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))
    out = rows.select("row", "doc_id", "all").join(by_row, "row", "left").withColumn("found", F.coalesce("found", F.expr("CAST(array() AS array<struct<start: int, kind: int, stop: int, is_live: boolean, is_example: boolean>>)")))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    live = F.filter("found", lambda x: x["is_live"])
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        _listed(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), _listed(F.col("found")).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.size(F.filter("found", lambda x: x["is_example"])).cast("long").alias("n_example"), _listed(live).alias("live"),
    )
