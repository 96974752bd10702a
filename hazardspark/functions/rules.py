"""Small rules as columns: bands, labels, parsing and cleaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
INTENSITY = [(50.0, "violent"), (7.6, "heavy"), (2.5, "moderate"), (0.1, "light")]
BASINS = [(13.10, "Kosasthalaiyar"), (13.02, "Cooum"), (12.90, "Adyar")]
DEPTH_FEET = {"<2ft": (0, 61), "<2": (0, 61), "2to3ft": (61, 91), "3to5ft": (91, 152), ">5ft": (152, None)}


def bands(x: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    out = None
    for at, label in steps:
        test = x > at if strict else x >= at
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def intensity_band(mm_h: Column) -> Column:
    return F.when(mm_h.isNotNull(), bands(mm_h, INTENSITY, "none"))


def rain_level(accumulation: Column, peak: Column, active: tuple[float, float] = (15.0, 25.0), watch: tuple[float, float] = (8.0, 7.6)) -> Column:
    """Levels by accumulated mm or peak mm/h."""
    over = lambda limits: (accumulation >= limits[0]) | (peak >= limits[1])
    return F.when(over(active), "active").when(over(watch), "watch").otherwise("dry")


def level_number(level: Column) -> Column:
    return F.when(level == "active", 2).when(level == "watch", 1).otherwise(0)


def basin_label(lat: Column) -> Column:
    return F.when(lat.isNotNull(), bands(lat, BASINS, "Kovalam", strict=True))


def depth_cm(text: Column) -> tuple[Column, Column]:
    """Lower and upper bound in cm of a depth class or a range in feet (a half goes to the even centimetre)."""
    t = F.regexp_replace(F.lower(F.trim(text)), " ", "")
    low = high = None
    for k, (a, b) in DEPTH_FEET.items():
        low = F.when(t == k, F.lit(a).cast("long")) if low is None else low.when(t == k, F.lit(a).cast("long"))
        high = F.when(t == k, F.lit(b).cast("long")) if high is None else high.when(t == k, F.lit(b).cast("long"))
    span = r"^(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)$"
    part = lambda k: F.bround(F.try_to_number(F.nullif(F.regexp_extract(t, span, k), F.lit("")), F.lit("999999.999999")).cast("double") * 30.48).cast("long")
    return low.otherwise(part(1)), high.otherwise(part(2))


def report_kind(details: Column) -> Column:
    d = F.lower(details)
    return F.when(d.contains("test"), None).when(d.rlike("no water|no stagnation|not water"), "not_waterlogged").when(d.rlike(r"\d+(?:\.\d+)?\s*cm"), "depth").otherwise("report_unclear")


def human_age(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("long"))
    hours = F.regexp_replace(F.concat((F.bround(s / 360.0) / 10).cast("string"), F.lit(" h ago")), r"\.0 h", " h")  # a tie goes to the even tenth
    return F.when(s < 90, "just now").when(s < 5400, F.concat(F.bround(s / 60.0).cast("long"), F.lit(" min ago"))).when(s < 172800, hours).otherwise(F.concat(F.floor(s / 86400).cast("long"), F.lit(" days ago")))


def display_name(name: Column, ref: Column) -> Column:
    n, r = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(ref, F.lit("")))
    return F.when((n != "") & (r != "") & ~F.contains(F.lower(n), F.lower(r)), F.concat(n, F.lit(" ("), r, F.lit(")"))).when(n != "", n).otherwise(r)


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Composed characters; there is no built-in for it. Texts of ASCII pass as they are."""
    return F.pandas_udf(_nfc, "string")(text)


def norm_text(text: Column, compose: bool = False) -> Column:
    text = nfc(text) if compose else text
    quotes = F.translate(text, "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(F.lower(quotes), r"\s+", " "))


def parse_day(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("dd-MM-yyyy HH:mm")), F.try_to_timestamp(t, F.lit("dd-MM-yyyy"))).cast("date")


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def to_int(text: Column) -> Column:
    return F.trim(text).try_cast("double").cast("long")


def reading_day(ts: Column, convention: str = "B") -> Column:
    """The gauge reading whose 24 hours hold a UTC time; readings turn at 08:30 local (+05:30), 03:00 UTC. B: named by its first day, A: by its last."""
    first = (ts - F.expr("INTERVAL 3 HOURS")).cast("date")
    return first if convention == "B" else F.date_add(first, 1)


def time_bin(epoch_s: Column) -> Column:
    local = epoch_s + 19800
    day = F.pmod(F.floor(local / 86400) + 3, F.lit(7))
    hour = F.pmod(local, F.lit(86400)) / 3600
    part = F.when((hour >= 8) & (hour < 11), "am_peak").when((hour >= 17) & (hour < 20), "pm_peak").when((hour >= 11) & (hour < 17), "day").otherwise("night")
    return F.concat(F.when(day >= 5, "weekend").otherwise("weekday"), F.lit("_"), part)


def csv_safe(text: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_plain(text: Column) -> Column:
    return F.when(text.rlike(r"^'[=+@\t\r-]"), F.substring(text, 2, 1 << 30)).otherwise(text)


def uuid7(epoch_ms: Column, number: Column) -> Column:
    """A time-ordered id from milliseconds and a row number."""
    time, n = F.lpad(F.lower(F.hex(epoch_ms)), 12, "0"), F.lpad(F.lower(F.hex(number)), 15, "0")
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(n, 1, 3), F.lit("-8"), F.substring(n, 4, 3), F.lit("-0"), F.substring(n, 5, 11))


def uuid7_ms(uuid: Column) -> Column:
    return F.conv(F.substring(F.regexp_replace(uuid, "-", ""), 1, 12), 16, 10).cast("long")


def language_share(text: Column, letters: str) -> Column:
    """Share of a text's letters that are in a character class; 0 without letters."""
    every = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.char_length(F.regexp_replace(text, f"[^{letters}]", ""))
    return F.when(every > 0, own / every).otherwise(0.0)
