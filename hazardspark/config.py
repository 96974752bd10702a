"""Parameters of hazard classes, sources and travellers. The model's published settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: class: decay seconds, severity, depth limit in mm, probability limit
HAZARDS = {
    "flood": (7200.0, 1.0, 300.0, 0.1),
    "waterlogging": (5400.0, 0.6, 200.0, 0.15),
    "debris": (900.0, 0.5, None, None),
    "accident": (1800.0, 0.4, None, None),
    "closure": (14400.0, 0.9, None, None),
    "heat": (10800.0, 0.2, None, None),
    "aqi": (10800.0, 0.2, None, None),
}
SOURCES = {"municipal_sensor": 0.97, "official_feed": 0.92, "verified_responder": 0.90, "crowd": 0.60, "app_traversal": 0.70}
#: class: caution z, hazard weight, travel profile
USERS = {"commuter": (0.0, 0.3, "car"), "emergency": (2.0, 1.0, "emergency"), "pedestrian": (1.28, 1.2, "foot"), "cyclist": (1.0, 0.8, "bicycle")}
#: profile: speed by road class, default speed, factor on car speed by road class, cap, closed road classes, ignores one-way
PROFILES = {
    "car": ({}, None, {}, None, [], False),
    "foot": ({"primary": 4.5, "primary_link": 4.5, "trunk": 4.0, "trunk_link": 4.0}, 5.0, {}, None, ["motorway", "motorway_link"], True),
    "bicycle": ({"tertiary": 14.0, "tertiary_link": 14.0, "secondary": 12.0, "secondary_link": 12.0, "primary": 10.0, "primary_link": 10.0, "trunk": 8.0, "trunk_link": 8.0}, 15.0, {}, None, ["motorway", "motorway_link"], False),
    "emergency": ({}, None, {"tertiary": 1.15, "tertiary_link": 1.1, "secondary": 1.3, "secondary_link": 1.2, "primary": 1.4, "primary_link": 1.3, "trunk": 1.4, "trunk_link": 1.3, "motorway": 1.4, "motorway_link": 1.3}, 90.0, [], False),
}
REPORT_WINDOW, RELIABLE_AT, MAX_FLOOD_INDEX, MIN_REPORTS = 2.0, 0.85, 0.6, 2
KERNEL_M, KERNEL_CUTOFF_M = 75.0, 300.0
PRIOR_STRENGTH, EVIDENCE_SCALE, REFERENCE_RELIABILITY = 2.0, 2.0, 0.97
FORGETTING_PER_HOUR = 0.9
ZONE_PROBABILITY = {"Very Low": 0.02, "Low": 0.05, "Moderate": 0.12, "High": 0.25, "Very High": 0.45}
ZONE_RADIUS_M, ZONE_FLOOR = 600.0, 0.02
PRIOR_ONLY_AT, PRIOR_ONLY_CLASS = 0.25, "flood"


def hazards(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in HAZARDS.items()]
    return spark.createDataFrame(rows, "hazard_class string, tau double, severity double, h_max_mm double, epsilon double")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES.items()), "source_class string, alpha double")


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in USERS.items()], "user_class string, z double, lam double, profile string")
