"""Merkle fixity audits of WARC records.

Records are laid out in order of id; each has its offset range and a SHA-256. ``FANOUT`` neighbouring records of the
first copy make a range of ids, which is a lowest node of the trees of both copies; ``FANOUT`` nodes hash into one that
covers their joint range, up to one root. A node holds the ranges of its children from its own start on, so that a
record that is lost or added changes the nodes above it and no others. Two copies with equal roots are equal; otherwise
only the children of nodes that differ are compared, level by level, and at last the records of the ranges that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

FANOUT = 64


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text; nulls are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(record_id), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Length: "), F.octet_length(text(body)).cast("string"), F.lit("\r\n\r\n"), text(body), F.lit("\r\n\r\n"),
    )


@dataclass
class Trees:
    """The trees of two copies, told apart by ``side`` (0 and 1).

    ``leaves``: side, record_id, digest, length, copies, node, start, end. ``levels``: side, node, digest, size; roots last.
    """

    leaves: DataFrame
    levels: list[DataFrame]


def _leaf(records: DataFrame, side: int) -> DataFrame:
    hashed = records.select("record_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"))
    return hashed.groupBy("record_id", "digest", "length").agg(F.count(F.lit(1)).alias("copies")).withColumn("side", F.lit(side))


def build_trees(first: DataFrame, second: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> Trees:
    """Trees over two copies (record_id, record), ordered by id, then digest.

    Equal rows are one leaf with a number of copies, which its range covers; a null id sorts first; an empty table has
    no nodes.
    """
    leaves = _leaf(first, 0).union(_leaf(second, 1))
    # Ranges of the order are numbered apart; what lies before each comes from one row a range.
    ranged = leaves.repartitionByRange(F.col("record_id").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "leaves")
    size = F.col("length") * F.col("copies")
    own = F.when(F.col("side") == 0, 1).otherwise(0)
    sides = ((0, "bytes0"), (1, "bytes1"))
    totals = ranged.groupBy("part").agg(F.sum(own).alias("n"), *(F.sum(F.when(F.col("side") == s, size).otherwise(0)).alias(c) for s, c in sides))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes0", "bytes1")))
    inner = Window.partitionBy("part").orderBy(F.col("record_id").asc_nulls_first(), "digest", "side", "length").rowsBetween(Window.unboundedPreceding, 0)
    upto = [F.sum(F.when(F.col("side") == s, size).otherwise(0)).over(inner) for s, _ in sides]
    placed = ranged.withColumns({"i": F.sum(own).over(inner), "upto": F.when(F.col("side") == 0, upto[0]).otherwise(upto[1])}).join(F.broadcast(totals), "part")
    end = F.col("upto") + F.when(F.col("side") == 0, F.col("bytes0_before")).otherwise(F.col("bytes1_before"))
    node = F.floor(F.greatest(F.col("n_before") + F.col("i") - 1, F.lit(0)) / fanout).cast("long")
    placed = scratch.keep(placed.select("side", "record_id", "digest", "length", "copies", node.alias("node"), (end - size).alias("start"), end.alias("end")), "placed")
    # A record enters its node with its offset range from the node's start on, so the node holds the order too. It may
    # hold any number of added records, so their hashes are added up, sixty bits at a time, instead of being listed.
    begins = placed.groupBy("side", "node").agg(F.min("start").alias("begin"))
    name = F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("null")), F.col("start") - F.col("begin"), F.col("end") - F.col("begin"), "copies", "digest")
    hashed = placed.join(begins, ["side", "node"]).select("side", "node", size.alias("size"), F.sha2(name, 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    grouped = hashed.groupBy("side", "node").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), *(w.alias(f"w{k}") for k, w in enumerate(words)))
    level = scratch.keep(grouped.select("side", "node", F.sha2(F.concat_ws(":", "n", "size", *(f"w{k}" for k in range(4))), 256).alias("digest"), "size"), "level0")
    levels = [level]
    n = (level.agg(F.max("node")).first()[0] or 0) + 1
    while n > 1:
        parts = F.array_sort(F.collect_list(F.struct("node", "size", "digest")))  # at most ``fanout``
        joined = level.groupBy("side", F.floor(F.col("node") / fanout).cast("long").alias("parent")).agg(parts.alias("c"), F.sum("size").alias("size"))
        sizes = F.transform("c", lambda c: c["size"])
        shown = F.transform("c", lambda c, k: F.concat_ws(":", (c["node"] % fanout).cast("string"), F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("long"), lambda x, y: x + y).cast("string"), c["size"].cast("string"), c["digest"]))
        level = scratch.keep(joined.select("side", F.col("parent").alias("node"), F.sha2(F.concat_ws(",", shown), 256).alias("digest"), "size"), f"level{len(levels)}")
        levels.append(level)
        n = -(-n // fanout)
    return Trees(placed, levels)


def differing_nodes(trees: Trees, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """Lowest nodes that differ, and what was compared at each level; only children of differing nodes are read."""
    visited = []
    suspects = None
    for level in reversed(trees.levels):
        if suspects is not None:
            level = level.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(suspects.withColumnRenamed("node", "parent"), "parent", "left_semi")
        sides = [level.filter(F.col("side") == s).select("node", F.struct("digest", "size").alias(f"own_{s}")) for s in (0, 1)]
        both = sides[0].join(sides[1], "node", "full_outer")
        visited.append(both)
        suspects = both.filter(~F.col("own_0").eqNullSafe(F.col("own_1"))).select("node")
    return suspects, visited


def audit(pages: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per distinct record of ``pages`` and per record that only the replica has.

    Both sides are (record_id, record). Columns: record_id, copies, start and end (in ``pages``, of added
    records in the replica), record_sha256, corrupt, and status: ``same``; ``corrupt``, where the replica has other bytes or another
    number of copies under that id; ``missing``, where it has none; ``extra``, where ``pages`` has no such id. Of
    several records of one id each is matched by its bytes first. A null record counts as no bytes; repeated rows share
    a leaf; an empty table gives only the other's rows.
    """
    scratch = Scratch(pages.sparkSession, "fixity")
    trees = build_trees(*(t.select("record_id", F.coalesce("record", F.lit("")).alias("record")) for t in (pages, replica)), scratch, fanout)
    nodes, _ = differing_nodes(trees, fanout)
    nodes = scratch.keep(nodes, "differing")
    inside = trees.leaves.join(nodes, "node", "left_semi")
    key = ["record_id", "digest", "length"]
    # The sides of one record, then of one id: added and missing records of an id meet in counts, not in pairs.
    shown = [F.max(F.when(F.col("side") == s, F.struct("copies", "start", "end"))).alias(f"own_{s}") for s in (0, 1)]
    records = inside.groupBy(*key).agg(*shown)
    unequal = ~F.col("own_0.copies").eqNullSafe(F.col("own_1.copies"))
    lonely = [F.col(f"own_{1 - s}").isNull() for s in (0, 1)]
    ids = records.filter(unequal).groupBy("record_id").agg(*(F.max(lonely[s]).alias(f"only_{s}") for s in (0, 1)))
    odd = records.filter(unequal).join(ids, records["record_id"].eqNullSafe(ids["record_id"])).drop(ids["record_id"])
    status = F.when(~lonely[0] & ~lonely[1], "corrupt").when(lonely[0], F.when(F.col("only_1"), "corrupt").otherwise("missing")).otherwise(F.when(F.col("only_0"), None).otherwise("extra"))
    told = odd.select(*key, F.coalesce("own_0", "own_1").alias("own"), status.alias("status")).filter("status IS NOT NULL")
    told = scratch.keep(told, "told")
    good = trees.leaves.filter("side = 0").join(told.select(*(F.col(c).alias(f"t_{c}") for c in key)), F.col("record_id").eqNullSafe(F.col("t_record_id")) & (F.col("digest") == F.col("t_digest")), "left_anti")
    same = good.select("record_id", "copies", "start", "end", F.col("digest").alias("record_sha256"), F.lit("same").alias("status"))
    rows = same.union(told.select("record_id", "own.copies", "own.start", "own.end", "digest", "status"))
    return rows.select("record_id", "copies", "start", "end", "record_sha256", (F.col("status") != "same").alias("corrupt"), "status")
