"""Topological relationships: do two variables peak and dip at the same keys?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import quantiles, running_totals, stored

VAR = ["agg", "var"]


def thresholds(long: DataFrame) -> DataFrame:
    """agg, var, high, low: quartiles of the values that are neither 0 nor null; none for constants."""
    x = F.when((F.col("x") != 0) & ~F.isnan("x"), F.col("x"))
    known = long.select(*VAR, x.alias("x")).filter("x IS NOT NULL")
    varying = known.groupBy(*VAR).agg((F.min("x") < F.max("x")).alias("varies")).filter("varies").select(*VAR)
    return quantiles(known.join(varying, VAR, "left_semi"), VAR, "x", {"high": 0.75, "low": 0.25})


def _signed(rows: DataFrame, long: DataFrame, more: list[str] | None = None) -> DataFrame:
    """kind, agg, var, val, sign of rows whose x is beyond the thresholds of the unmoved values."""
    sign = F.when(F.col("x") > F.col("high"), 1).when(F.col("x") < F.col("low"), -1)
    return rows.join(thresholds(long), VAR).select(*(more or []), "kind", *VAR, "val", sign.alias("sign")).filter("sign IS NOT NULL")


def features(long: DataFrame, shift: int = 0) -> DataFrame:
    """kind, agg, var, val, sign: keys above the upper quartile (1) and below the lower (-1).

    With ``shift`` the values move cyclically along the ordered keys, which keeps their sequence but breaks its tie
    to other variables.
    """
    rows = long.select("kind", *VAR, "val", "x")
    return _signed(moved(rows, shifted_keys(keys_in_order(long), [shift])) if shift else rows, long)


def keys_in_order(long: DataFrame) -> DataFrame:
    """kind, agg, val, at, n: each aggregated table's keys with their places in order, for all its variables."""
    keys = long.select("kind", "agg", "val").distinct().withColumn("_one", F.lit(1).cast("long"))
    sizes = keys.groupBy("agg").agg(F.count(F.lit(1)).alias("n"))  # a row a table
    return running_totals(keys, ["kind", "agg"], ["val"], "_one", "at").drop("_one").join(sizes, "agg")


def shifted_keys(ordered: DataFrame, shifts: list[int]) -> DataFrame:
    """turn, kind, agg, val, source: for the i-th shift the key whose value each key takes."""
    turned = ordered.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(k).alias("k")) for i, k in enumerate(shifts))))).select("kind", "agg", "val", "at", "n", "_s.turn", "_s.k")
    to = turned.select("turn", "kind", "agg", "val", F.pmod(F.col("at") + F.col("k"), F.col("n")).alias("at"))
    return to.join(ordered.select("kind", "agg", F.col("val").alias("source"), "at"), ["kind", "agg", "at"]).select("turn", "kind", "agg", "val", "source")


def moved(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """turn, kind, agg, var, val, x: the values of all variables at the keys that ``mapping`` moves them to."""
    values = rows.select("kind", "agg", F.col("val").alias("source"), "var", "x")
    return mapping.join(values, ["kind", "agg", "source"]).select("turn", "kind", *VAR, "val", "x")


def key_graph(keys: DataFrame, adjacency: DataFrame) -> DataFrame:
    """agg, val, other: which keys of a table are neighbours, in both directions.

    Places (kind spatial) are neighbours as ``adjacency`` (region, neighbour) says. Keys of time and place (kind st) are
    neighbours at one time if their places are, and at one place if no other time of the table lies between theirs.
    """
    near = adjacency.select("region", "neighbour").union(adjacency.select("neighbour", "region")).filter("region <> neighbour").distinct()
    own = keys.select("kind", "agg", "val").distinct()
    space = own.filter("kind = 'spatial'").select("agg", F.lit("").alias("t"), F.col("val").alias("s"), "val")
    split = own.filter("kind = 'st'").select("agg", F.substring_index("val", ",", 1).alias("t"), F.expr("substr(val, instr(val, ',') + 1)").alias("s"), "val")
    at = space.unionAll(split)
    beside = at.join(near, F.col("s") == F.col("region")).select("agg", "t", "val", F.col("neighbour").alias("s"))
    beside = beside.join(at.select("agg", "t", "s", F.col("val").alias("other")), ["agg", "t", "s"]).select("agg", "val", "other")
    times = split.select("agg", "t").distinct()  # a table's times, not its keys
    after = times.withColumn("later", F.lead("t").over(Window.partitionBy("agg").orderBy("t"))).filter("later IS NOT NULL")
    on = split.join(after, ["agg", "t"]).select("agg", F.col("later").alias("t"), "s", "val").join(split.select("agg", "t", "s", F.col("val").alias("other")), ["agg", "t", "s"]).select("agg", "val", "other")
    return beside.unionAll(on).unionAll(on.select("agg", F.col("other").alias("val"), F.col("val").alias("other")))


def connected(keys: DataFrame, graph: DataFrame) -> DataFrame:
    """agg, val, part: the smallest key that a key is joined with, directly or through others, in its table's graph.

    In each round a key takes the smallest part among its neighbours' and its own, and then the part of that part, so
    the number of rounds grows slowly with the length of the longest way.
    """
    parts = stored(keys.select("agg", "val").distinct().withColumn("part", F.col("val")), "parts")
    while True:
        seen = graph.join(parts.select("agg", F.col("val").alias("other"), "part"), ["agg", "other"]).select("agg", "val", "part").unionAll(parts)
        least = seen.groupBy("agg", "val").agg(F.min("part").alias("part"))
        jump = least.join(parts.select("agg", F.col("val").alias("part"), F.col("part").alias("beyond")), ["agg", "part"])
        fresh = stored(jump.select("agg", "val", F.least("part", "beyond").alias("part")), "parts")
        if not fresh.join(parts, ["agg", "val", "part"], "left_anti").limit(1).count():
            return fresh
        parts = fresh


def breadth_first_places(keys: DataFrame, graph: DataFrame, seeds: list[int | None]) -> DataFrame:
    """turn, kind, agg, val, at: a place for every key, in breadth-first order from one start in each connected part.

    For each seed the starts, the order of parts and that of keys of one level follow a hash of key and seed; for None
    they follow the keys. All tables, parts and seeds advance a level at once, by joining the last level with the graph
    until nothing new is met; places then come from the counts of parts and levels.
    """
    graph = stored(graph, "graph")
    parts = connected(keys, graph)
    rank = F.lit(None).cast("string")
    for i, s in enumerate(seeds):
        own = F.concat(F.lit("0"), "val") if s is None else F.concat(F.md5(F.concat_ws("|", F.lit(str(s)), "val")), F.col("val"))
        rank = F.when(F.col("turn") == i, own).otherwise(rank)
    nodes = stored(parts.withColumn("turn", F.explode(F.array(*map(F.lit, range(len(seeds)))))).withColumn("h", rank), "nodes")
    first = nodes.groupBy("turn", "agg", "part").agg(F.min("h").alias("start"))
    level = stored(nodes.join(first.withColumnRenamed("start", "h"), ["turn", "agg", "part", "h"]).select("turn", "agg", "val", F.lit(0).alias("level")), "level")
    levels, depth = [level], 0
    while True:
        depth += 1
        met = level.select("turn", "agg", "val").join(graph, ["agg", "val"]).select("turn", "agg", F.col("other").alias("val")).distinct()
        for known in levels[-2:]:  # a neighbour of a level is in it, or in the one before or after
            met = met.join(known, ["turn", "agg", "val"], "left_anti")
        level = stored(met.withColumn("level", F.lit(depth)), "level")
        if not level.limit(1).count():
            break
        levels.append(level)
    reached = reduce(DataFrame.unionAll, levels)
    placed = nodes.join(reached, ["turn", "agg", "val"]).join(first, ["turn", "agg", "part"])
    one = placed.withColumn("_one", F.lit(1).cast("long"))
    kinds = keys.select("kind", "agg").distinct()
    return running_totals(one, ["turn", "agg"], ["start", "level", "h"], "_one", "at").join(kinds, "agg").select("turn", "kind", "agg", "val", "at")


def shuffled_keys(keys: DataFrame, graph: DataFrame, seeds: list[int]) -> DataFrame:
    """turn, kind, agg, val, source: for each seed the key whose value each key takes, so that neighbours stay near.

    The key at a place of the plain breadth-first order takes the value of the key at this place of a seeded one.
    """
    places = stored(breadth_first_places(keys, graph, [None, *seeds]), "places")
    plain = places.filter("turn = 0").drop("turn")
    other = places.filter("turn > 0").select((F.col("turn") - 1).alias("turn"), "kind", "agg", F.col("val").alias("source"), "at")
    return plain.join(other, ["kind", "agg", "at"]).select("turn", "kind", "agg", "val", "source")


def relationships(one: DataFrame, two: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """agg1, var1, agg2, var2, score, strength of features that share a key of one kind, tables of a different name.

    score = (agreeing - opposing) / shared; strength = 2 p / (p + 1) with p the share of the first variable's features
    that are shared. Features of the first side are kept apart by the columns ``by``.
    """
    a = one.select(*by, "kind", F.col("agg").alias("agg1"), F.col("var").alias("var1"), "val", F.col("sign").alias("s1"))
    b = two.select("kind", F.col("agg").alias("agg2"), F.col("var").alias("var2"), "val", F.col("sign").alias("s2"))
    ids = [*by, "agg1", "var1", "agg2", "var2"]
    met = a.join(b, ["kind", "val"]).filter("agg1 <> agg2").groupBy(*ids).agg(F.sum(F.col("s1") * F.col("s2")).alias("net"), F.count(F.lit(1)).alias("shared"))
    sizes = a.groupBy(*by, "agg1", "var1").agg(F.count(F.lit(1)).alias("n1"))
    p = F.col("shared") / F.col("n1")
    return met.join(sizes, [*by, "agg1", "var1"]).select(*ids, (F.col("net") / F.col("shared")).alias("score"), (2 * p / (p + 1)).alias("strength"))


def feature_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """agg1, var1, agg2, var2, shared, either, jaccard of the keys at which two variables have features, tables of a different name."""
    ids = ["agg1", "var1", "agg2", "var2"]
    a = one.select("kind", F.col("agg").alias("agg1"), F.col("var").alias("var1"), "val")
    b = two.select("kind", F.col("agg").alias("agg2"), F.col("var").alias("var2"), "val")
    met = a.join(b, ["kind", "val"]).filter("agg1 <> agg2").groupBy(*ids).agg(F.count(F.lit(1)).alias("shared"))
    sizes = lambda df, i: df.groupBy(f"agg{i}", f"var{i}").agg(F.count(F.lit(1)).alias(f"n{i}"))
    either = F.col("n1") + F.col("n2") - F.col("shared")
    return met.join(sizes(a, 1), ["agg1", "var1"]).join(sizes(b, 2), ["agg2", "var2"]).select(*ids, "shared", either.alias("either"), (F.col("shared") / either).alias("jaccard"))


def significant(long: DataFrame, shifts: list[int], adjacency: DataFrame | None = None) -> DataFrame:
    """Relationships whose score no permutation of the first variable's values reaches.

    There are as many permutations as ``shifts``: times move along their order by that many keys. With ``adjacency``
    (region, neighbour) places, and keys of time and place, are shuffled in breadth-first order seeded by the shift, which
    keeps neighbours near; without it they move like times.
    """
    rows = long.select("kind", *VAR, "val", "x")
    keys = stored(rows.select("kind", "agg", "val").distinct(), "keys")
    if adjacency is None:
        mapping = shifted_keys(keys_in_order(keys), shifts)
    else:
        times, places = keys.filter("kind = 'temporal'"), keys.filter("kind <> 'temporal'")
        mapping = shifted_keys(keys_in_order(times), shifts).unionByName(shuffled_keys(places, key_graph(places, adjacency), shifts))
    plain = stored(features(long), "features")
    ids = ["agg1", "var1", "agg2", "var2"]
    others = relationships(_signed(moved(rows, mapping), long, ["turn"]), plain, ("turn",))
    best = others.groupBy(*ids).agg(F.max(F.abs("score")).alias("other"))
    return relationships(plain, plain).join(best, ids, "left").filter("other IS NULL OR other < abs(score)").drop("other")
