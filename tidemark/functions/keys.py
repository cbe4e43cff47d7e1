"""Key columns: the texts on which tables are aligned in time and space."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class TimeUnit(IntEnum):
    ALL = 0
    HOUR = 1
    DAY = 2
    MONTH = 3
    QUARTER = 4
    YEAR = 5


class SpaceUnit(IntEnum):
    ALL = 0
    BLOCK = 1
    BLOCK_GROUP = 2
    TRACT = 3
    COUNTY = 4
    STATE = 5
    ZIPCODE = 6


#: Levels whose values make up a key of each unit, outermost first.
SPACE_LEVELS = {
    SpaceUnit.BLOCK: ("state", "county", "tract", "block"),
    SpaceUnit.BLOCK_GROUP: ("state", "county", "tract", "block_group"),
    SpaceUnit.TRACT: ("state", "county", "tract"),
    SpaceUnit.COUNTY: ("state", "county"),
    SpaceUnit.STATE: ("state",),
    SpaceUnit.ZIPCODE: ("zipcode",),
}

_PATTERNS = {TimeUnit.HOUR: "yyyy-MM-dd-HH", TimeUnit.DAY: "yyyy-MM-dd", TimeUnit.MONTH: "yyyy-MM", TimeUnit.YEAR: "yyyy"}


def parse_time(text: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.try_to_timestamp(text.cast("string"))


def time_key(ts: Column, unit: TimeUnit) -> Column:
    """``2024-08-03-04``, ``2024-08-03``, ``2024-08``, ``2024-3`` (quarter) or ``2024``; null for a null time."""
    if unit == TimeUnit.QUARTER:
        return F.when(ts.isNotNull(), F.concat_ws("-", F.date_format(ts, "yyyy"), F.quarter(ts)))
    return F.date_format(ts, _PATTERNS[unit])


def shown_time(key: Column) -> Column:
    """A time key with its parts in reverse order, as it is shown."""
    return F.array_join(F.reverse(F.split(key, "-")), "-")


def time_parts(key: Column) -> Column:
    """A time key's parts as numbers."""
    return F.split(key, "-").cast("array<int>")


def space_key(*levels: Column) -> Column:
    """Levels joined by ``-``; null if one is missing."""
    known = levels[0].isNotNull()
    for level in levels[1:]:
        known &= level.isNotNull()
    return F.when(known, F.concat_ws("-", *(level.cast("string") for level in levels)))


def code_key(value: Column) -> Column:
    """A column that already holds keys: numbers without a fraction (``60604.0`` is ``60604``), other text trimmed."""
    text = F.trim(value.cast("string"))
    whole = text.try_cast("double").try_cast("bigint").cast("string")
    return F.nullif(F.coalesce(whole, text), F.lit(""))


def joint_key(time: Column, space: Column) -> Column:
    """``time,space``; null if either is."""
    return F.when(time.isNotNull() & space.isNotNull(), F.concat_ws(",", time, space))


def parse_coordinate(text: Column) -> Column:
    """``struct<lon, lat>`` from the first pair in brackets, comma or space between; swapped where it reads lat, lon.

    Null unless there are two numbers. A longitude above 0 with a latitude below 0 is a swapped pair.
    """
    inner = F.trim(F.regexp_extract(F.regexp_replace(text, "[\\n\\r]", ""), r"\(([^()]*)\)", 1))
    parts = F.split(inner, r"[\s,]+")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    swapped = (a > 0) & (b < 0)
    good = a.isNotNull() & b.isNotNull() & (F.size(parts) == 2)
    return F.when(good, F.struct(F.when(swapped, b).otherwise(a).alias("lon"), F.when(swapped, a).otherwise(b).alias("lat")))
