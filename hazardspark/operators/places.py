"""Places: categories from tags, areas, names and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.functions.geo import DEGREE_M
from hazardspark.functions.rules import name_key

#: Category and kind by amenity, and kinds by religion, tourism and leisure.
AMENITIES = {
    "school": ("education", "school"), "kindergarten": ("education", "kindergarten"), "college": ("education", "college"), "university": ("education", "university"),
    "hospital": ("health", "hospital"), "clinic": ("health", "clinic"), "doctors": ("health", "doctors"), "pharmacy": ("health", "pharmacy"), "dentist": ("health", "dentist"), "health_post": ("health", "health post"),
    "police": ("police", "police"), "fire_station": ("fire", "fire station"), "bus_station": ("bus", "bus stand"),
    "restaurant": ("food", "restaurant"), "cafe": ("food", "cafe"), "fast_food": ("food", "fast food"), "food_court": ("food", "food court"),
    "bank": ("money", "bank"), "atm": ("money", "atm"), "bureau_de_change": ("money", "money exchange"), "fuel": ("fuel", "fuel"), "charging_station": ("fuel", "charging station"), "marketplace": ("shop", "market"),
    "post_office": ("utility", "post office"), "townhall": ("utility", "town hall"), "community_centre": ("utility", "community centre"), "library": ("utility", "library"), "courthouse": ("utility", "court"), "toilets": ("utility", "toilets"),
    "drinking_water": ("utility", "drinking water"), "shelter": ("utility", "shelter"), "social_facility": ("utility", "social facility"), "public_building": ("utility", "public building"), "water_point": ("utility", "water point"),
}
RELIGIONS = {"hindu": "temple", "muslim": "mosque", "christian": "church", "jain": "jain temple", "sikh": "gurdwara", "buddhist": "buddhist temple"}
TOURISM = {"attraction": "attraction", "museum": "museum", "viewpoint": "viewpoint", "zoo": "zoo", "theme_park": "theme park", "gallery": "gallery", "aquarium": "aquarium"}
LEISURE = {"park": "park", "garden": "garden", "stadium": "stadium", "sports_centre": "sports centre", "nature_reserve": "nature reserve"}


def place_class(tags: Column) -> Column:
    """(category, kind) of a place by its tags (a map); the first rule that holds wins, null where none does."""
    tag = lambda k: tags[k]
    is_in = lambda k, *v: F.coalesce(tag(k).isin(*v), F.lit(False))
    some = lambda k: F.coalesce(tag(k) != "", F.lit(False))
    plain = lambda k: F.replace(tag(k), F.lit("_"), F.lit(" "))
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    pair = lambda category, kind: F.struct(F.lit(category).alias("category"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    amenity = F.struct(F.element_at(table({k: v[0] for k, v in AMENITIES.items()}), tag("amenity")).alias("category"), F.element_at(table({k: v[1] for k, v in AMENITIES.items()}), tag("amenity")).alias("kind"))
    stop = is_in("railway", "station", "halt") | (is_in("public_transport", "station") & some("railway"))
    underground = is_in("station", "subway") | is_in("subway", "yes")
    return (
        F.when(is_in("amenity", "place_of_worship"), pair("worship", F.coalesce(F.element_at(table(RELIGIONS), tag("religion")), F.lit("place of worship"))))
        .when(is_in("amenity", *AMENITIES), amenity)
        .when(is_in("highway", "bus_stop"), pair("bus", "bus stop"))
        .when(is_in("highway", "traffic_signals"), pair("signal", "traffic signals"))
        .when(stop, pair("rail", F.when(underground, "metro station").otherwise("railway station")))
        .when(some("shop"), pair("shop", plain("shop")))
        .when(is_in("tourism", *TOURISM), pair("landmark", F.element_at(table(TOURISM), tag("tourism"))))
        .when(some("historic"), pair("landmark", plain("historic")))
        .when(is_in("leisure", *LEISURE), pair("park", F.element_at(table(LEISURE), tag("leisure"))))
        .when(is_in("emergency", "ambulance_station"), pair("health", "ambulance station"))
        .when(is_in("office", "government"), pair("utility", "government office"))
        .when(is_in("power", "substation", "plant"), pair("utility", F.concat(F.lit("power "), tag("power"))))
        .when(is_in("man_made", "water_tower", "water_works", "wastewater_plant"), pair("utility", plain("man_made")))
    )


def place_category(tags: Column) -> Column:
    return place_class(tags)["category"]


def any_tag_says(tags: Column, names: str, words: list[str]) -> Column:
    """Whether a tag whose name matches holds one of the words, in any case."""
    pattern = "|".join(words)
    return F.exists(F.map_entries(tags), lambda e: e["key"].rlike(names) & F.coalesce(F.lower(e["value"]).rlike(pattern), F.lit(False)))


def footprint_area(points: Column) -> Column:
    """Square metres inside a ring of (lat, lon) points in order, closed by its first point; the plane at the mean latitude."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.aggregate(F.zip_with(points, after, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]), F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(points)
    return F.abs(cross) / 2 * DEGREE_M * DEGREE_M * F.cos(F.radians(mean))


def place_duplicates(df: DataFrame, digits: int = 3) -> DataFrame:
    """The first row (by id) at each rounded position and name."""
    w = Window.partitionBy(F.round("lat", digits), F.round("lon", digits), "name").orderBy("id")
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def rank_places(df: DataFrame, asked: str, limit: int) -> DataFrame:
    """Exact, prefix and all-words matches in this order, then kind, shorter name, name, id."""
    name, words = F.lower("name"), asked.lower().split()
    every = F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.split(name, " "), w))
    rank = F.when(name == asked.lower(), 0).when(name.startswith(asked.lower()), 1).when(every, 2)
    ranked = df.withColumn("rank", rank).filter("rank IS NOT NULL")
    return ranked.orderBy("rank", "kind", F.char_length("name"), "name", "place_id").limit(limit)


def with_aliases_and_extras(places: DataFrame, aliases: DataFrame, extras: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Places with further spellings and further places, and what was refused (name, reason).

    places and extras: name, lat, lon, kind, alt (array); aliases: name, spelling. A spelling joins `alt` of all places of its name
    unless it is the name or there already. An extra must have a known kind and a name that no place has, in any case; refused are
    others, and aliases of names that are no places."""
    spellings = aliases.filter("spelling <> ''").groupBy("name").agg(F.array_sort(F.collect_set("spelling")).alias("more"))
    named = places.join(spellings, "name", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    full = named.withColumn("alt", F.concat("alt", F.array_except("more", F.concat("alt", F.array("name"))))).drop("more")
    key = lambda df: df.select(F.lower("name").alias("k")).distinct()
    judged = extras.withColumn("k", F.lower("name")).join(key(places).withColumn("known", F.lit(True)), "k", "left")
    reason = F.when(~F.col("kind").isin(*kinds), "unknown kind").when(F.col("known"), "already there")
    judged = judged.withColumn("reason", reason)
    kept = full.unionByName(judged.filter("reason IS NULL").select(full.columns))
    lost = spellings.join(places, "name", "left_anti").select("name", F.lit("no such place").alias("reason"))
    return kept, judged.filter("reason IS NOT NULL").select("name", "reason").unionByName(lost)


#: States that were one with another. Fixed values.
SPLIT_STATES = [("andhrapradesh", "telangana"), ("madhyapradesh", "chhattisgarh"), ("bihar", "jharkhand"), ("uttarpradesh", "uttarakhand"), ("jammuandkashmir", "ladakh")]


def state_key(state: Column) -> Column:
    return name_key(F.replace(state, F.lit("&"), F.lit("and")))


def choose_geocode(asked: DataFrame, found: DataFrame, relaxed: bool = False, on: str = "id") -> DataFrame:
    """(id, candidate): the answer of a geocoder to take for each asked place, null where none is in its state.

    asked: id, name, state and the column `on`, if it is another; found: on (what the answers were found for), candidate, name, admin1, admin2, feature_code, population. Seats of administration come before
    other places and these before the rest, then answers whose district has the asked name, then larger ones, then the lower candidate.
    Relaxed, states that were split count as one, only answers of the same name or district stand, and the district is no tier.

    Places that ask the same are one question, which meets the answers in its state only."""
    asked = asked.withColumn("__question", F.struct(on, "name", "state"))
    one = F.create_map(*[F.lit(x) for a, b in SPLIT_STATES for x in (b, a)])
    whole = lambda k: F.coalesce(F.element_at(one, k), k) if relaxed else k
    questions = asked.select("__question").distinct().select("__question", F.col(f"__question.{on}").alias("__on"), name_key(F.col("__question.name")).alias("__name"), whole(state_key(F.col("__question.state"))).alias("__state"))
    code = F.coalesce("feature_code", F.lit(""))
    answers = found.select(
        F.col(on).alias("__on"), "candidate", whole(state_key(F.coalesce("admin1", F.lit("")))).alias("__state"), name_key(F.coalesce("name", F.lit(""))).alias("__own"), name_key(F.coalesce("admin2", F.lit(""))).alias("__district"),
        F.when(code.startswith("PPLA"), 0).when(F.lit(not relaxed) & code.startswith("PPL"), 1).otherwise(2).alias("__tier"), (-F.coalesce("population", F.lit(0))).alias("__size"),
    )
    rows = questions.join(answers, ["__on", "__state"])
    same = F.col("__district") == F.col("__name")
    rows = rows.filter(same | (F.col("__own") == F.col("__name"))) if relaxed else rows
    tier = F.lit(0) if relaxed else F.when(same, 0).otherwise(1)
    best = rows.groupBy("__question").agg(F.min(F.struct("__tier", tier.alias("__same"), "__size", "candidate")).alias("__best")).select("__question", "__best.candidate")
    return asked.select("id", "__question").join(best, "__question", "left").select("id", "candidate")
