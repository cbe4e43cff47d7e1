"""Points in polygons, and which polygons touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def locate(points: DataFrame, regions: DataFrame, cell: float = 0.05, id_col: str = "point_id") -> DataFrame:
    """``points`` (id, lon, lat) with the region each lies within; outside all, or on an edge only, it is left out.

    ``regions`` has region and ring, an array of struct<lon, lat>. Points and regions' boxes meet on the cells of a
    grid, so each point is tested against the few regions of its cell; a ray to the right then decides. A region may
    have several rows: parts, or holes in them, as a point is within where an odd number of its rings surround it. Of
    several regions the first by name is kept. Points exactly on an edge are not within.
    """
    ring = F.col("ring")
    boxed = regions.withColumns({
        "lon0": F.array_min(F.transform(ring, lambda p: p["lon"])), "lon1": F.array_max(F.transform(ring, lambda p: p["lon"])),
        "lat0": F.array_min(F.transform(ring, lambda p: p["lat"])), "lat1": F.array_max(F.transform(ring, lambda p: p["lat"])),
    })
    tiles = boxed.withColumn("cx", F.explode(_cells(F.col("lon0"), F.col("lon1"), cell))).withColumn("cy", F.explode(_cells(F.col("lat0"), F.col("lat1"), cell)))
    placed = points.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumns({"cx": F.floor(F.col("lon") / cell), "cy": F.floor(F.col("lat") / cell)})
    near = placed.join(tiles, ["cx", "cy"]).filter("lon > lon0 AND lon < lon1 AND lat > lat0 AND lat < lat1")
    lon, lat = F.col("lon"), F.col("lat")
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1)).alias("b")))

    def crosses(e: Column) -> Column:
        spans = (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
        at = (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"]
        return spans & (lon < at)

    def on(e: Column) -> Column:
        turn = (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (lon - e["a"]["lon"])
        inside = lon.between(F.least(e["a"]["lon"], e["b"]["lon"]), F.greatest(e["a"]["lon"], e["b"]["lon"])) & lat.between(F.least(e["a"]["lat"], e["b"]["lat"]), F.greatest(e["a"]["lat"], e["b"]["lat"]))
        return (turn == 0) & inside

    tested = near.withColumns({"_odd": F.size(F.filter(edges, crosses)) % 2, "_on": F.exists(edges, on)})
    inside = tested.groupBy(id_col, "lon", "lat", "region").agg(F.sum("_odd").alias("_odd"), F.max("_on").alias("_on")).filter("_odd % 2 = 1 AND NOT _on")
    return inside.groupBy(id_col, "lon", "lat").agg(F.min("region").alias("region"))


def _turn(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies left of the line from a to b, 0 on it."""
    return (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])


def _between(a: Column, b: Column, p: Column) -> Column:
    low = lambda c: F.least(a[c], b[c]) <= p[c]
    high = lambda c: p[c] <= F.greatest(a[c], b[c])
    return low("lon") & high("lon") & low("lat") & high("lat")


def _sides(ring: Column) -> Column:
    """A ring's sides of some length, in its order; the last point leads back to the first."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1)).alias("b")))
    return F.filter(sides, lambda s: s["a"] != s["b"])


def _strictly_inside(p: Column, sides: Column) -> Column:
    spans = lambda s: (s["a"]["lat"] > p["lat"]) != (s["b"]["lat"] > p["lat"])
    at = lambda s: (s["b"]["lon"] - s["a"]["lon"]) * (p["lat"] - s["a"]["lat"]) / F.nullif(s["b"]["lat"] - s["a"]["lat"], F.lit(0.0)) + s["a"]["lon"]
    odd = F.size(F.filter(sides, lambda s: spans(s) & (p["lon"] < at(s)))) % 2 == 1
    return odd & ~F.exists(sides, lambda s: (_turn(s["a"], s["b"], p) == 0) & _between(s["a"], s["b"], p))


def adjacency(regions: DataFrame, cell: float = 0.5) -> DataFrame:
    """region, neighbour: regions (region, ring) whose borders meet, along a side or at a point, and whose insides do not, both ways.

    A region may have several rows, its rings; each ring goes round once, in either direction, without a hole. Sides are
    dealt to the cells of a grid and meet in each; the cells should be about as wide as a side is long. Sides meet where
    an end of one lies on the other. Regions overlap, and are not neighbours, if sides cross, if sides of one direction
    lie on each other, or if a corner or the middle of a side lies inside the other region.
    """
    area = F.aggregate(_sides(F.col("ring")), F.lit(0.0), lambda acc, s: acc + s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])
    turned = regions.filter(F.size("ring") > 2).select("region", F.when(area < 0, F.reverse("ring")).otherwise(F.col("ring")).alias("ring")).select("region", _sides(F.col("ring")).alias("sides"))
    sides = turned.select("region", F.explode("sides").alias("s"))
    x, y = (_cells(F.least(f"s.a.{c}", f"s.b.{c}"), F.greatest(f"s.a.{c}", f"s.b.{c}"), cell) for c in ("lon", "lat"))
    dealt = sides.withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))
    other = dealt.select(F.col("region").alias("neighbour"), F.col("s").alias("t"), "cx", "cy")
    met = dealt.join(other, ["cx", "cy"]).filter("region < neighbour")
    a, b, c, d = F.col("s.a"), F.col("s.b"), F.col("t.a"), F.col("t.b")
    ca, da, ac, bc = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    touch = ((ca == 0) & _between(a, b, c)) | ((da == 0) & _between(a, b, d)) | ((ac == 0) & _between(c, d, a)) | ((bc == 0) & _between(c, d, b))
    cross = (F.signum(ca) * F.signum(da) < 0) & (F.signum(ac) * F.signum(bc) < 0)
    along = (b["lon"] - a["lon"]) * (d["lon"] - c["lon"]) + (b["lat"] - a["lat"]) * (d["lat"] - c["lat"])
    overlap = lambda k: F.least(F.greatest(a[k], b[k]), F.greatest(c[k], d[k])) > F.greatest(F.least(a[k], b[k]), F.least(c[k], d[k]))
    same_way = (ca == 0) & (da == 0) & (along > 0) & (overlap("lon") | overlap("lat"))
    pairs = met.groupBy("region", "neighbour").agg(F.max(touch).alias("touch"), F.max(cross | same_way).alias("over")).filter("touch AND NOT over").select("region", "neighbour")
    # Only pairs whose borders meet are tested for a corner or the middle of a side within the other region.
    points = F.concat(F.transform("sides", lambda s: s["a"]), F.transform("sides", lambda s: F.struct(((s["a"]["lon"] + s["b"]["lon"]) / 2).alias("lon"), ((s["a"]["lat"] + s["b"]["lat"]) / 2).alias("lat"))))
    shapes = turned.select("region", "sides", points.alias("points"))
    both = pairs.union(pairs.select("neighbour", "region"))
    held = both.join(shapes.select("region", "points"), "region").join(shapes.select(F.col("region").alias("neighbour"), "sides"), "neighbour")
    over = held.filter(F.exists("points", lambda p: _strictly_inside(p, F.col("sides")))).select(F.least("region", "neighbour").alias("region"), F.greatest("region", "neighbour").alias("neighbour"))
    apart = pairs.join(over, ["region", "neighbour"], "left_anti")
    return apart.union(apart.select("neighbour", "region"))
