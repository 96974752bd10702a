"""Readers of observation, map, trace and catalogue files, and the writers that match them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.functions.rules import csv_plain, csv_safe

OBSERVATION = """id string, hazard_class string, polarity int, geometry struct<type: string, coordinates: array<double>>, accuracy_m double, observed_at timestamp,
received_at timestamp, source_class string, source_id string, intensity map<string, double>, raw map<string, string>, precision_state string, coarsened_at timestamp"""
BOM = "﻿"


def read_observations_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One observation a line, with lat, lon and depth_mm taken out; torn lines are in `_corrupt` with null fields."""
    rows = spark.read.schema(OBSERVATION + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumns({"lon": F.get("geometry.coordinates", 0), "lat": F.get("geometry.coordinates", 1), "depth_mm": F.col("intensity")["depth_mm"]}).drop("geometry")


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the count of torn lines."""
    return rows.filter("_corrupt IS NULL").drop("_corrupt"), rows.agg(F.count("_corrupt").alias("torn"))


def read_csv_bom(spark: SparkSession, path: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """A CSV with a header that may begin with a byte-order mark; all columns are strings, some under new names."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c: c.replace(BOM, "").strip() for c in rows.columns}
    return rows.withColumnsRenamed({c: (renamed or {}).get(n, n) for c, n in names.items()})


def read_parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_kml_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """(name, fields map, lat, lon, points): points are the vertices of the placemark, lat and lon their mean."""
    schema = """name string, ExtendedData struct<SchemaData: struct<SimpleData: array<struct<_name: string, _VALUE: string>>>>, Point struct<coordinates: string>,
    LineString struct<coordinates: string>, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    raw = F.trim(F.coalesce("Point.coordinates", "LineString.coordinates", "Polygon.outerBoundaryIs.LinearRing.coordinates"))
    points = F.transform(F.split(raw, r"\s+"), lambda p: F.struct(F.split(p, ",")[1].cast("double").alias("lat"), F.split(p, ",")[0].cast("double").alias("lon")))
    data = F.col("ExtendedData.SchemaData.SimpleData")
    mean = lambda k: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[k]) / F.size("points")
    out = rows.select("name", F.when(data.isNotNull(), F.map_from_entries(F.transform(data, lambda d: F.struct(d["_name"], d["_VALUE"])))).alias("fields"), points.alias("points"))
    return out.withColumns({"lat": mean("lat"), "lon": mean("lon")})


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, ring, part, seq, lat, lon) of every vertex of polygons and multipolygons; closing vertices are left out."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = "array<array<array<double>>>"
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", ring))).otherwise(F.from_json("f.geometry.coordinates", f"array<{ring}>"))
    rows = features.select("f.properties", F.posexplode(parts).alias("part", "rings")).select("properties", "part", F.posexplode("rings").alias("ring", "points"))
    rows = rows.select("properties", "part", "ring", F.slice("points", 1, F.size("points") - 1).alias("points")).select("properties", "part", "ring", F.posexplode("points").alias("seq", "p"))
    return rows.select("properties", "part", "ring", "seq", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))


def epoch_ms(column: str):
    return F.timestamp_millis(F.col(column).try_cast("long"))


def read_overpass_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way, seq, node, lat, lon, highway, oneway, name) of ways whose nodes and geometry match; others are left out."""
    schema = "elements array<struct<type: string, id: long, nodes: array<long>, geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>"
    ways = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    good = ways.filter((F.col("type") == "way") & (F.size("nodes") == F.size("geometry")) & F.col("tags")["highway"].isNotNull())
    points = good.select(F.col("id").alias("way"), "tags", F.posexplode(F.arrays_zip("nodes", "geometry")).alias("pos", "p"))
    tag = lambda k: F.col("tags")[k]
    return points.select("way", (F.col("pos") + 1).alias("seq"), F.col("p.nodes").alias("node"), "p.geometry.lat", "p.geometry.lon", tag("highway").alias("highway"), F.coalesce(tag("oneway"), F.lit("no")).alias("oneway"), tag("name").alias("name"))


def read_alert_rss(spark: SparkSession, path: str, country: str) -> DataFrame:
    """(title, link, published, lat, lon, country) of items for the country or with none."""
    schema = "title string, link string, pubDate string, `georss:point` string, `geo:Point` struct<`geo:lat`: double, `geo:long`: double>, `gdacs:country` string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    point = F.split(F.trim("georss:point"), r"\s+")
    out = rows.select(
        "title", "link", F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+, ", ""), F.lit("d MMM yyyy HH:mm:ss z")).alias("published"),
        F.coalesce(point[0].cast("double"), F.col("`geo:Point`.`geo:lat`")).alias("lat"), F.coalesce(point[1].cast("double"), F.col("`geo:Point`.`geo:long`")).alias("lon"), F.col("`gdacs:country`").alias("country"),
    )
    return out.filter(F.col("country").isNull() | F.contains(F.lower("country"), F.lit(country.lower())))


def read_hourly_forecast(spark: SparkSession, path: str) -> DataFrame:
    """(point, t, mm) from one reply a point, each with parallel arrays of hours and millimetres."""
    rows = spark.read.schema("hourly struct<time: array<string>, precipitation: array<double>>, latitude double, longitude double").option("multiLine", True).json(path)
    each = rows.select("latitude", "longitude", F.explode(F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.precipitation").alias("precipitation"))).alias("h"))
    return each.select(F.format_string("%.4f,%.4f", "latitude", "longitude").alias("point"), F.try_to_timestamp("h.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("t"), F.col("h.precipitation").alias("mm"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(trace, t, lat, lon) by time; of points with one time the first by position is kept."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, time string").load(path)
    points = rows.select(F.input_file_name().alias("trace"), F.to_timestamp("time").alias("t"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).filter("t IS NOT NULL")
    return points.groupBy("trace", "t").agg(F.min(F.struct("lat", "lon")).alias("p")).select("trace", "t", "p.*")


def read_csv_traces(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Traces from CSVs with a header: the first column as text, the others (time first) as numbers; rows without a time are left out."""
    rows = read_csv_bom(spark, path)
    key, *numbers = columns
    return rows.select(key, *[F.col(n).try_cast("double").alias(n) for n in numbers]).filter(F.col(numbers[0]).isNotNull())


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon, kind, alt) from lines of `[name, lat, lon, kind, alt...]`; lines that are not are left out."""
    rows = spark.read.text(path).select(F.from_json("value", "array<string>").alias("a")).filter("size(a) >= 4")
    out = rows.select(F.get("a", 0).alias("name"), F.get("a", 1).try_cast("double").alias("lat"), F.get("a", 2).try_cast("double").alias("lon"), F.get("a", 3).alias("kind"), F.slice("a", 5, F.size("a")).alias("alt"))
    return out.filter("name <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def write_append_log(df: DataFrame, path: str) -> None:
    """Appends rows under their day of receipt; a restart adds files and changes none."""
    df.withColumn("received_date", F.to_date("received_at")).write.mode("append").partitionBy("received_date").json(path)


def write_csv_safe(df: DataFrame, path: str) -> None:
    safe = {f.name: csv_safe(F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df.withColumns(safe).write.option("header", True).option("escape", '"').csv(path)


def read_csv_safe(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv_bom(spark, path)
    return rows.withColumns({c: csv_plain(F.col(c)) for c in rows.columns})


def write_edge_graph(edges: DataFrame, prior: DataFrame, path: str) -> None:
    """The graph and, beside it, priors for the same edges; edges without one have nulls."""
    edges.write.parquet(f"{path}/edges")
    edges.select("edge_id").join(prior, "edge_id", "left").write.parquet(f"{path}/prior")


def append_absent_jdbc(new: DataFrame, url: str, table: str, key: str, properties: dict[str, str]) -> None:
    """Inserts rows whose key the table does not hold; first insert wins. Only keys are read back."""
    stored = new.sparkSession.read.jdbc(url, f"(SELECT {key} FROM {table}) AS known", properties=properties)
    new.dropDuplicates([key]).join(stored, key, "left_anti").write.jdbc(url, table, mode="append", properties=properties)
