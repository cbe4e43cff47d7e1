"""The inverted index of keys, its counts, and what a search on it would cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.counters import Counters
from tidemark.operators.ranges import running_totals, stored


def inverted_index(keys: DataFrame) -> DataFrame:
    """kind, val and the sorted names of the aggregated tables that have the key."""
    return keys.groupBy("kind", "val").agg(F.sort_array(F.collect_set("agg")).alias("aggs"))


def index_counts(keys: DataFrame) -> DataFrame:
    """kind, val, cnt: how many aggregated tables have the key, without building the lists."""
    return keys.distinct().groupBy("kind", "val").agg(F.count(F.lit(1)).alias("cnt"))


def table_counts(keys: DataFrame) -> DataFrame:
    """agg, val, cnt: for each table, how many tables share each of its keys."""
    return keys.join(index_counts(keys), ["kind", "val"]).select("agg", "val", "cnt")


def search_costs(keys: DataFrame, threshold: int) -> DataFrame:
    """agg, n_keys, rows_to_read and max_joinable of an index search for each table."""
    totals = table_counts(keys).groupBy("agg").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("cnt").alias("rows_to_read"))
    return totals.withColumn("max_joinable", F.floor((F.col("rows_to_read") - F.col("n_keys")) / threshold).cast("long"))


def candidates(keys: DataFrame, threshold: int, own: DataFrame | None = None) -> DataFrame:
    """agg, cand, overlap: tables of the same kind, of other raw tables, that share at least ``threshold`` keys.

    ``own`` restricts the keys of the searching side, for example to a sample. Only keys meet that stand in both, so
    the work is the sum over keys of the tables that share them.
    """
    left = (own if own is not None else keys).select("kind", "val", F.col("agg").alias("agg"), F.col("tbl").alias("tbl1"))
    right = keys.select("kind", "val", F.col("agg").alias("cand"), F.col("tbl").alias("tbl2"))
    met = left.join(right, ["kind", "val"]).filter("tbl1 <> tbl2")
    return met.groupBy("agg", "cand").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= threshold)


def sampled_candidates(keys: DataFrame, threshold: int, share: float = 0.05) -> DataFrame:
    """agg, cand, estimate: overlaps scaled up from each table's most widely shared keys, ``share`` of them.

    The scale is rows to read over rows read, rounded down. Taking the commonest keys first biases the estimate
    upwards; it only steers the choice of a method.
    """
    ranked = table_counts(keys).withColumn("r", F.row_number().over(Window.partitionBy("agg").orderBy(F.desc("cnt"), "val")))
    sizes = search_costs(keys, threshold)
    picked = ranked.join(sizes, "agg").filter(F.col("r") <= F.floor(F.col("n_keys") * share))
    scale = picked.groupBy("agg").agg(F.floor(F.max("rows_to_read") / F.sum("cnt")).cast("long").alias("scale"))
    own = keys.join(picked.select("agg", "val"), ["agg", "val"], "left_semi")
    met = candidates(keys, 1, own).join(scale, "agg")
    return met.select("agg", "cand", (F.col("overlap") * F.col("scale")).alias("estimate")).filter(F.col("estimate") >= threshold)


def join_costs(keys: DataFrame, threshold: int) -> DataFrame:
    """kind, agg, cnt, cost of joining a table with the rest, for tables of at least ``threshold`` keys.

    Tables stand in falling order of size; with i before a table of n, cost = i / n * cnt + (1 - i / n) * average size
    of it and those after it, to two places.
    """
    sizes = keys.groupBy("kind", "agg").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= threshold)
    order = Window.partitionBy("kind").orderBy(F.desc("cnt"), "agg")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(Window.partitionBy("kind"))
    done = (F.row_number().over(order) - 1) / n
    return sizes.select("kind", "agg", "cnt", F.round(done * F.col("cnt") + (1 - done) * F.avg("cnt").over(after), 2).alias("cost"))


def joinable_pairs(keys: DataFrame, threshold: int, watch: Counters | None = None) -> DataFrame:
    """kind, agg1, agg2, overlap, every unordered pair once: the first is the table with fewer keys, then by name.

    ``watch`` counts the keys that two tables share (keys_met).
    """
    sizes = keys.groupBy("kind", "agg", "tbl").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    # Tables too small to reach the threshold never meet the others' keys.
    sized = keys.join(sizes.select("agg", "n"), "agg")
    a = sized.select("kind", "val", F.struct("n", "agg", "tbl").alias("a"))
    b = sized.select("kind", "val", F.struct("n", "agg", "tbl").alias("b"))
    met = a.join(b, ["kind", "val"]).filter((F.col("a") < F.col("b")) & (F.col("a.tbl") != F.col("b.tbl")))
    met = watch.on(met, "keys_met") if watch else met
    pairs = met.groupBy("kind", F.col("a.agg").alias("agg1"), F.col("b.agg").alias("agg2")).agg(F.count(F.lit(1)).alias("overlap"))
    return pairs.filter(F.col("overlap") >= threshold)


def pairs_at_least(keys: DataFrame, threshold: int, watch: Counters | None = None) -> DataFrame:
    """kind, agg1, agg2: the pairs of ``joinable_pairs``, without counting all that they share.

    Each table's keys are ordered from the rarest to the commonest. Two tables that share ``threshold`` keys share one
    among all but their ``threshold`` - 1 commonest each, so only these meet, and the keys that most tables have do not
    pair them all. Pairs that share enough there are done; the others, few by then, are counted in full. ``watch``
    counts the keys met in both steps (keys_met, keys_checked).
    """
    known = stored(keys.select("kind", "val", "agg", "tbl").distinct(), "keys")
    shared = known.join(index_counts(known.select("kind", "val", "agg")).filter("cnt > 1"), ["kind", "val"])
    sizes = known.groupBy("agg").agg(F.count(F.lit(1)).alias("n"))  # a row a table
    usable = shared.groupBy("agg").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= threshold).join(sizes, "agg")
    ranked = running_totals(shared.withColumn("_one", F.lit(1).cast("long")), ["agg"], ["cnt", "val"], "_one", "at").drop("_one", "cnt").join(usable, "agg")
    ranked = stored(ranked.withColumn("rare", F.col("at") <= F.col("m") - threshold), "ranked")

    def side(rows: DataFrame, i: str) -> DataFrame:
        return rows.select("kind", "val", F.struct("n", "agg", "tbl").alias(f"s{i}"))

    rare = ranked.filter("rare")
    met = side(rare, "1").join(side(rare, "2"), ["kind", "val"]).filter((F.col("s1") < F.col("s2")) & (F.col("s1.tbl") != F.col("s2.tbl")))
    met = watch.on(met, "keys_met") if watch else met
    found = stored(met.groupBy("kind", F.col("s1.agg").alias("agg1"), F.col("s2.agg").alias("agg2")).agg(F.count(F.lit(1)).alias("k")), "found")
    open_ = found.filter(F.col("k") < threshold).select("kind", "agg1", "agg2")
    own = ranked.select("kind", F.col("agg").alias("agg1"), "val")
    checked = open_.join(own, ["kind", "agg1"]).join(own.withColumnRenamed("agg1", "agg2"), ["kind", "agg2", "val"])
    checked = watch.on(checked, "keys_checked") if watch else checked
    late = checked.groupBy("kind", "agg1", "agg2").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= threshold)
    return found.filter(F.col("k") >= threshold).select("kind", "agg1", "agg2").unionByName(late.select("kind", "agg1", "agg2"))


def all_pairs(keys: DataFrame, threshold: int) -> DataFrame:
    """kind, agg1, agg2: every pair of tables of one kind and of different raw tables, with no look at their keys.

    Rows are aggregated tables, not data: the catalog is what is paired.
    """
    sizes = keys.groupBy("kind", "agg", "tbl").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    a, b = sizes.select("kind", F.struct("n", "agg", "tbl").alias("a")), sizes.select("kind", F.struct("n", "agg", "tbl").alias("b"))
    return a.join(b, "kind").filter((F.col("a") < F.col("b")) & (F.col("a.tbl") != F.col("b.tbl"))).select("kind", F.col("a.agg").alias("agg1"), F.col("b.agg").alias("agg2"))


def choose_method(keys: DataFrame, threshold: int) -> DataFrame:
    """For every table the costs of searching the index and of joining all, and the cheaper: agg, overhead, find_cost, all_cost, method.

    A search reads its keys' lists (weight 4.2 from 100,000 keys, else 0.1) and joins what it finds, at most
    ``max_joinable`` tables; joining all costs the smaller side of every candidate. Where neither bound decides, the
    sampled estimate does.
    """
    sizes = keys.groupBy("kind", "agg", "tbl").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    other = sizes.select("kind", F.col("agg").alias("agg2"), F.col("tbl").alias("tbl2"), F.col("n").alias("n2"))
    every = sizes.join(other, "kind").filter("tbl <> tbl2").groupBy("agg").agg(F.sum(F.least("n", "n2")).alias("all_cost"), F.count(F.lit(1)).alias("n_cands"))
    costs = sizes.join(search_costs(keys, threshold), "agg").join(every, "agg", "left").na.fill(0, ["all_cost", "n_cands"])
    guess = sampled_candidates(keys, threshold).join(sizes.select(F.col("agg").alias("cand"), F.col("n").alias("n2")), "cand").join(sizes.select("agg", "n"), "agg")
    guess = guess.groupBy("agg").agg(F.count(F.lit(1)).alias("k"), F.avg(F.least("n", "n2")).alias("each"))
    overhead = F.when(F.col("n") >= 100_000, 4.2).otherwise(0.1) * (F.col("n") + F.col("rows_to_read"))
    rated = costs.join(guess, "agg", "left").withColumn("overhead", overhead)
    rated = rated.withColumn("find_cost", F.col("overhead") + F.least("max_joinable", "n_cands") * F.col("n"))
    estimated = F.col("overhead") + F.coalesce(F.col("k") * F.col("each"), F.lit(0.0))
    method = F.when(F.col("find_cost") <= F.col("all_cost"), "INDEX_SEARCH").when(F.col("overhead") >= F.col("all_cost"), "JOIN_ALL").when(estimated <= F.col("all_cost"), "INDEX_SEARCH").otherwise("JOIN_ALL")
    return rated.select("agg", "overhead", "find_cost", F.col("all_cost").cast("double").alias("all_cost"), method.alias("method"))
