"""Which columns are measures and which are keys, by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A name that contains one of these is no measure.
NOT_MEASURE_PARTS = (
    "id", "primary_key", "longitude", "latitude", "ward", "date", "zipcode", "zip_code", "_zip", "street_number", "street_address", "district", "coordinate", "community_area",
    "_no", "_year", "_day", "_month", "_hour", "_number", "_code", "census_tract", "address", "x_coord", "y_coord", "bbl", "borough", "block", "_lot", "interval", "accumulative",
    "cumulative",
)
# A name that equals one of these is no measure.
NOT_MEASURE_NAMES = (
    "commarea", "commarea_n", "tract", "bbl", "census", "permit_", "beat", "zip", "year", "week_number", "ssa", "license_", "day_of_week", "police_sector", "police_beat",
    "license", "month", "hour", "day", "lat", "long", "mmwr_week", "zip4", "phone", "x", "y", "area", "wind_direction", "heading", "dig_ticket_", "uniquekey", "streetnumberto",
    "streetnumberfrom", "census_block", "stnoto", "stnofrom", "lon", "northing", "easting", "property_group", "insepctnumber", "primarykey", "beat_", "north", "south", "west",
    "east", "beat_of_occurrence", "lastinspectionnumber", "fax", "latest_dist_res", "majority_dist", "latest_dist", "f12", "f13", "bin",
)
# A key attribute that contains one of these is not used.
NOT_KEY_PARTS = ("update", "modified", "_end", "end_", "status", "_notified")

#: Longest measure name, so that ``avg_<name>_t1`` has at most 63 characters; longest key attribute.
LONGEST_MEASURE, LONGEST_KEY = 56, 48


def is_measure_name(name: str) -> bool:
    name = name.lower()
    return name not in NOT_MEASURE_NAMES and not any(part in name for part in NOT_MEASURE_PARTS)


def measure_columns(df: DataFrame, keys: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns of ``df`` with a measure's name, keys left out."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys and len(f.name) <= LONGEST_MEASURE and is_measure_name(f.name)]


def key_attributes(names: list[str], most: int = 0) -> list[str]:
    """Usable key attributes, shortest name first; ``most`` of them if it is not 0."""
    usable = sorted((n for n in names if len(n) <= LONGEST_KEY and not any(p in n.lower() for p in NOT_KEY_PARTS)), key=len)
    return usable[:most] if most else usable
