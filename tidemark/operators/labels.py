"""Which columns hold times, places and measures, told by their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import is_measure_name, measure_columns

# Patterns of whole values, by kind. The table may be replaced.
TIME_PATTERNS = {
    "DateTime": (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{3})?(?:Z|[+-](?:0\d|1[0-4]):(?:00|30))?$",),
}
PLACE_PATTERNS = {
    "geoCoordinate": (
        r"^POINT\s*\(\s*([-+]?[0-9]*\.?[0-9]+)[ ,]*\s*(\s*[-+]?[0-9]*\.?[0-9]+)\)$",
        r"^\(\s*-?\d+(\.\d+)?\s*,?\s*-?\d+(\.\d+)?\s*\)$",
        r"^,?\s*\(\s*-?\d+(\.\d+)?\s*,?\s*-?\d+(\.\d+)?\s*\)$",
        r"^\((-?\d+(\.\d+)?(.)?(°)?)[, ]+(-?\d+(\.\d+)?(.)?(°)?)\)$",
    ),
    "tract": (r"^17031.*",),
    "zipCode": (r"^\d{5}$",),
}

# Column types of portal metadata.
DATE_TYPES = ("Calendar date", "Date")
PLACE_TYPES = ("Location", "Geospatial", "Point")


def match_shares(df: DataFrame, columns: list[str] | None = None, times: dict = TIME_PATTERNS, places: dict = PLACE_PATTERNS) -> DataFrame:
    """column, axis, kind, share: how many of a column's known values match any pattern of a kind, in one pass."""
    columns = columns or df.columns
    found = []
    for c in columns:
        text = F.col(c).cast("string")
        for axis, table in (("time", times), ("place", places)):
            for kind, patterns in table.items():
                hit = F.lit(False)
                for p in patterns:
                    hit |= text.rlike(p)
                found.append((c, axis, kind, F.avg(hit.cast("double"))))
    row = df.agg(*(share.alias(f"s{i}") for i, (*_, share) in enumerate(found)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(a).alias("axis"), F.lit(k).alias("kind"), F.col(f"s{i}").alias("share")) for i, (c, a, k, _) in enumerate(found)))
    return row.select(F.inline(cells))


def label_columns(df: DataFrame, sample: int | None = 1000) -> dict[str, list]:
    """t_attrs, s_attrs (name, kind) and num_columns of a table.

    A column is labelled if more than half of its values match; times come before places, and the first kind that
    matches counts. Labelled columns are no measures. Values come from the first ``sample`` rows, or all.
    """
    rows = match_shares(df.limit(sample) if sample else df).collect()
    times, places = {}, {}
    for r in rows:
        if r.share is not None and r.share > 0.5 and r.column not in times:
            if r.axis == "time":
                times[r.column] = r.kind
            else:
                places.setdefault(r.column, r.kind)
    places = {c: k for c, k in places.items() if c not in times}
    return {"t_attrs": list(times.items()), "s_attrs": list(places.items()), "num_columns": [c for c in measure_columns(df) if c not in times and c not in places]}


def portal_tables(metadata: DataFrame) -> DataFrame:
    """Tables of a portal that have times or places: id, name, t_attrs, s_attrs, num_columns.

    ``metadata`` has id, name, names and types of the columns. Times named as updates are left out, and a start with
    an end cancel out unless other times or places remain.
    """
    columns = F.arrays_zip(F.col("names").alias("name"), F.col("types").alias("type"))
    pick = lambda types, keep: F.transform(F.filter(columns, lambda c: c["type"].isin(*types) & keep(c["name"])), lambda c: c["name"])
    times = pick(DATE_TYPES, lambda n: ~n.contains("updated") & ~n.contains("data_as_of"))
    is_start, is_end = lambda t: t.contains("start_"), lambda t: t.contains("end_")
    found = metadata.select("id", "name", times.alias("t"), pick(PLACE_TYPES, lambda n: F.lit(True)).alias("s_attrs"), pick(("Number",), lambda n: ~n.contains(":@")).alias("num_columns"))
    span = F.exists("t", is_start) & F.exists("t", is_end)
    last = lambda test: F.element_at(F.filter("t", test), -1)
    t = F.when(span, F.array_except("t", F.array(last(is_start), last(is_end)))).otherwise(F.col("t"))
    return found.select("id", "name", t.alias("t_attrs"), "s_attrs", "num_columns").filter((F.size("t_attrs") > 0) | (F.size("s_attrs") > 0))


def keep_measures(names: list[str]) -> list[str]:
    return [n for n in names if is_measure_name(n)]
