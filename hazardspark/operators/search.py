"""Place search for a table of queries: an inverted index of letter runs finds candidates, the name rules rank them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of kinds among equally good names; any other kind comes after them.
TIERS = {"city": 0, "town": 1, "street": 2, "suburb": 3, "neighbourhood": 3, "quarter": 3, "village": 4}


def normalised(name: Column) -> Column:
    """Lower case; anything but letters, marks, digits and spaces becomes a space; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N}\s]", " "), r"\s+", " "))


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n letters of each word of text; a shorter word itself."""
    words = F.filter(F.split(text, " "), lambda w: F.char_length(w) > 0)
    each = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(w) - (n - 1))), lambda i: w.substr(i, F.lit(n)))
    return F.array_distinct(F.flatten(F.transform(words, each)))


def name_rank(name: Column, q: Column) -> Column:
    """-1 for the name itself, 0 for a name that begins with q, 1 for one that holds every word of q; null where q does not match.

    With a digit in q, a name must also hold q without spaces, and not as a part of a longer number ("nh 44" finds NH-44 and not NH 444);
    that alone is a match too. Both are normalised."""
    tight, tight_q = F.replace(name, F.lit(" "), F.lit("")), F.replace(q, F.lit(" "), F.lit(""))
    digits = q.rlike("[0-9]")
    number = F.regexp_like(tight, F.concat(tight_q, F.lit("([^0-9]|$)")))
    every = F.forall(F.split(q, " "), lambda w: F.contains(name, w))
    one_word = ~F.contains(q, F.lit(" "))
    rank = F.when(name == q, -1).when(F.startswith(name, q), 0)
    return rank.when(every & (~digits | number | one_word), 1).when(~every & digits & number, 1)


def search_places(queries: DataFrame, places: DataFrame, limit: int = 8, gram: int = 3) -> DataFrame:
    """(query_id, place, place_id, rank, name_rank, tier): at most `limit` places for each query, best first.

    queries: query_id, q, lat, lon (null: no reference point). places: place_id, names (array), kind, lat, lon, size. Order: name rank (of
    the place's best name), tier of kind, distance where the query has a point, larger size, name, id. Queries of fewer than two
    letters find nothing.

    The index has a posting for each name and run of three letters of its words, and for names with digits also of the name without
    spaces. A text takes the postings of its rarest run (or of shorter words' runs of two or one), and only those names are ranked, so
    no text meets all places unless all hold what it asks for. Names and places are ranked once for all queries of one text; a query
    without a point then takes its text's first places, one with a point meets those of the name ranks and tiers that can be among them.
    """
    sizes = range(1, gram + 1)
    names = places.select("place_id", F.explode("names").alias("full")).withColumn("name", normalised(F.col("full"))).filter("name <> ''")
    kinds = [("w", F.col("name")), ("c", F.when(F.col("name").rlike("[0-9]"), F.replace("name", F.lit(" "), F.lit(""))))]
    tagged = lambda grams, tag: F.transform(grams, lambda g: F.concat(F.lit(tag), g))
    cut = [tagged(_grams(text, n), f"{k}{n}:") for k, text in kinds for n in sizes]
    postings = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*cut))))).alias("gram"))

    asked = queries.select("query_id", normalised(F.col("q")).alias("q"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).filter(F.char_length("q") >= 2)
    texts = asked.select("q").distinct()
    digits = F.col("q").rlike("[0-9]")
    tight = F.replace("q", F.lit(" "), F.lit(""))

    def runs(text: Column, kind: str) -> Column:
        """Of each word the runs of its own length or of `gram` letters: every name that holds the word has them all."""
        word = lambda w: F.when(F.char_length(w) >= gram, F.transform(_grams(w, gram), lambda g: F.concat(F.lit(f"{kind}{gram}:"), g))).otherwise(F.array(F.concat(F.lit(kind), F.char_length(w).cast("string"), F.lit(":"), w)))
        return F.flatten(F.transform(F.split(text, " "), word))

    wanted = texts.select("q", F.explode(F.array_distinct(F.when(digits, runs(tight, "c")).otherwise(runs(F.col("q"), "w")))).alias("gram"))
    common = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(common, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "gram")).alias("g")).filter("g.n > 0")
    pairs = rarest.select("q", F.col("g.gram").alias("gram")).join(postings, "gram").withColumn("r", name_rank(F.col("name"), F.col("q"))).filter("r IS NOT NULL")
    best = pairs.select("q", "name", "r").join(names.select("place_id", "name"), "name").groupBy("q", "place_id").agg(F.min("r").alias("name_rank"))

    tier = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), TIERS.items(), F.when(F.lit(False), 0)).otherwise(5)
    found = best.join(places.select("place_id", F.col("names")[0].alias("place"), "kind", "lat", "lon", "size"), "place_id").withColumn("tier", tier)
    group, alike = (Window.partitionBy("q").orderBy("name_rank", "tier", *more) for more in ((), (F.desc("size"), "place", "place_id")))
    found = found.withColumn("group", F.rank().over(group)).filter(F.col("group") <= limit).withColumn("alike", F.row_number().over(alike)).drop("group")
    found = asked.join(found, "q").filter(F.col("qlat").isNotNull() & F.col("qlon").isNotNull() | (F.col("alike") <= limit))
    dx, dy = (F.col("lon") - F.col("qlon")) * 111320 * F.cos(F.radians("qlat")), (F.col("lat") - F.col("qlat")) * 110574
    found = found.withColumn("distance_m", F.sqrt(dx * dx + dy * dy))
    order = Window.partitionBy("query_id").orderBy("name_rank", "tier", F.coalesce("distance_m", F.lit(0.0)), F.desc("size"), "place", "place_id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.select("query_id", "place", "place_id", "rank", "name_rank", "tier", "distance_m")
