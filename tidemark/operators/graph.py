"""Graphs of correlated variables and tables: quality filters, communities, modularity, clustering, threshold search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.operators.ranges import stored

#: Quality signals of a correlation and whether a threshold bounds them from above (-1) or below (1).
SIGNALS = {"missing_ratio": -1, "zero_ratio": -1, "missing_ratio_o": -1, "zero_ratio_o": -1, "r_val": 1, "samples": 1}


def signal_condition(name: str, threshold) -> Column:
    """Whether a correlation passes one signal; ratios must hold for both variables."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    if name == "r_val":
        return F.abs("r_val") >= threshold
    if name == "samples":
        return F.col("samples") >= threshold
    return (F.col(f"{name}1") <= threshold) & (F.col(f"{name}2") <= threshold)


def filter_signals(corrs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Correlations that pass the six signals, in the order of ``SIGNALS``."""
    return corrs.filter(reduce(lambda a, b: a & b, (signal_condition(n, t) for n, t in zip(SIGNALS, thresholds))))


def variable_edges(corrs: DataFrame, within_table: bool = True) -> DataFrame:
    """src, dst, weight: variables as ``table--attribute``, one edge a pair, its largest |r|."""
    a, b = F.concat_ws("--", "tbl1", "var1"), F.concat_ws("--", "tbl2", "var2")
    rows = corrs if within_table else corrs.filter("tbl1 <> tbl2")
    return rows.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.abs("r").alias("w")).groupBy("src", "dst").agg(F.max("w").alias("weight"))


def table_edges(corrs: DataFrame) -> DataFrame:
    """src, dst, weight: tables, and the number of correlations between them."""
    return corrs.select(F.least("tbl1", "tbl2").alias("src"), F.greatest("tbl1", "tbl2").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def heavy_edges(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter(F.col("weight") >= threshold)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def covered_tables(corrs: DataFrame) -> DataFrame:
    """n_tables that appear on either side."""
    return corrs.select(F.col("tbl1").alias("t")).unionAll(corrs.select("tbl2")).agg(F.countDistinct("t").alias("n_tables"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """modularity of the parts (node, community) of an unweighted graph: the sum over them of L / m - (d / 2m)^2."""
    own = lambda side: communities.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    placed = edges.join(own("src"), "src").join(own("dst"), "dst")
    inner = placed.groupBy(F.col("c_src").alias("c")).agg(F.count_if(F.col("c_src") == F.col("c_dst")).alias("inside"), F.count(F.lit(1)).alias("ends"))
    ends = inner.select("c", "inside", "ends").unionAll(placed.groupBy(F.col("c_dst").alias("c")).agg(F.lit(0).cast("bigint").alias("inside"), F.count(F.lit(1)).alias("ends")))
    parts = ends.groupBy("c").agg(F.sum("inside").alias("l"), F.sum("ends").alias("d"))
    total = F.sum("d") / 2  # every edge has two ends
    moments = parts.agg(F.sum("l").alias("l"), total.alias("m"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return moments.select((F.col("l") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def average_clustering(edges: DataFrame) -> DataFrame:
    """avg_clustering: the mean over nodes of the share of their neighbours' pairs that are joined; 0 below two neighbours.

    Triangles are found from the end of smaller degree, so a hub does not spread into all pairs of its neighbours.
    """
    plain = edges.filter("src <> dst").select("src", "dst").distinct()
    deg = degrees(plain)
    ranked = plain.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src").join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst")
    up = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    out = ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"))
    wedge = out.select("lo", F.col("hi").alias("x")).join(out.select("lo", F.col("hi").alias("y")), "lo").filter("x < y")
    sides = plain.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    triangles = wedge.join(sides, ["x", "y"])
    corners = triangles.select(F.explode(F.array("lo", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    each = deg.join(corners, "node", "left").select(F.when(F.col("degree") < 2, 0.0).otherwise(F.coalesce("t", F.lit(0)) / F.nullif(pairs, F.lit(0.0))).alias("c"))
    return each.agg(F.avg("c").alias("avg_clustering"))


def louvain(edges: list[tuple[str, str, float]], seed: int = 0) -> dict[str, int]:
    """Communities of a graph of variables (a catalog, not data) by repeated local moves and contraction, with a fixed seed."""
    rng = np.random.default_rng(seed)
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    of = {n: i for i, n in enumerate(names)}
    weights: dict[tuple[int, int], float] = {}
    for a, b, w in edges:
        key = tuple(sorted((of[a], of[b])))
        weights[key] = weights.get(key, 0.0) + w
    member = list(range(len(names)))
    while True:
        n = max((x for k in weights for x in k), default=-1) + 1
        near: list[dict[int, float]] = [{} for _ in range(n)]
        degree = np.zeros(n)
        for (a, b), w in weights.items():
            near[a][b] = near[a].get(b, 0.0) + w
            if a != b:
                near[b][a] = near[b].get(a, 0.0) + w
            degree[a] += w
            degree[b] += w
        m2 = degree.sum() or 1.0
        part = list(range(n))
        total = degree.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in rng.permutation(n):
                links: dict[int, float] = {}
                for j, w in near[i].items():
                    if j != i:
                        links[part[j]] = links.get(part[j], 0.0) + w
                total[part[i]] -= degree[i]
                gain = lambda c: links.get(c, 0.0) - total[c] * degree[i] / m2
                best = max(sorted(set(links) | {part[i]}), key=lambda c: (gain(c) + (1e-12 if c == part[i] else 0.0)))
                if best != part[i]:
                    part[i], moved, moved_any = best, True, True
                total[part[i]] += degree[i]
        fresh = {c: k for k, c in enumerate(sorted(set(part)))}
        member = [fresh[part[c]] for c in member]
        if not moved_any:
            return {name: c for name, c in zip(names, member)}
        folded: dict[tuple[int, int], float] = {}
        for (a, b), w in weights.items():
            key = tuple(sorted((fresh[part[a]], fresh[part[b]])))
            folded[key] = folded.get(key, 0.0) + w
        weights = folded


def part_graph(edges: DataFrame, seed: int = 0, most_turns: int = 40) -> DataFrame:
    """node, community of a weighted graph (src, dst, weight), by moves that raise the modularity, and contraction, all in joins.

    A community is named by its smallest node. In each turn every node rates the communities of its neighbours by what
    joining them would gain; a half of the nodes, picked by a hash of node, seed and turn, may move to the best, so that
    neighbours do not swap for ever. When none of either half moves, communities become the nodes of a smaller graph,
    until nothing is merged. Sides of equal ends count twice for a node's degree; an empty graph has no rows.
    """
    links = stored(edges.filter("weight > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("w")), "edges")
    both = lambda e: e.select("src", "dst", "w").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    whole = links.agg(F.sum("w")).first()[0]
    member = None  # of the first graph's nodes
    while True:
        near = stored(both(links), "near")
        degree = stored(near.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "degree")
        at = stored(degree.select("node", "k", F.col("node").alias("c")), "parts")
        still, turn, merged = 0, 0, False
        while still < 2 and turn < most_turns and whole:
            turn += 1
            # Communities carry their sums to the nodes first, so that what grows with the edges is dealt out twice: by the
            # far end, which brings its community, and by the near end, where all of a node's choices stay together.
            totals = at.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
            sums = at.join(totals, "c")
            met = near.filter("src <> dst").join(sums.select(F.col("node").alias("dst"), "c", "total", "size"), "dst").select(F.col("src").alias("node"), "c", "w", "total", "size")
            met = met.unionByName(sums.select("node", "c", F.lit(0.0).alias("w"), "total", "size")).repartition("node")
            rated = met.groupBy("node", "c").agg(F.sum("w").alias("to"), F.max("total").alias("total"), F.max("size").alias("size"))
            rated = rated.join(at.select("node", "k", F.col("c").alias("own")), "node")
            gain = F.round(F.col("to") - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * whole), 9)
            choice = rated.withColumn("gain", gain).groupBy("node", "k", "own").agg(
                F.min(F.struct((-F.col("gain")).alias("less"), "c", "size")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.struct("gain", "size"))).alias("now")
            )
            may = F.pmod(F.xxhash64("node", F.lit(seed + turn // 2)) + turn, F.lit(2)) == 0
            alone = (F.col("now.size") == 1) & (F.col("best.size") == 1) & (F.col("best.c") > F.col("own"))  # of two single nodes the larger moves
            moves = may & ~alone & (-F.col("best.less") > F.col("now.gain"))
            at = stored(choice.select("node", "k", F.when(moves, F.col("best.c")).otherwise(F.col("own")).alias("c"), moves.alias("moved")), "parts")
            moved = bool(at.filter("moved").limit(1).count())
            at = at.drop("moved")
            still, merged = (0, True) if moved else (still + 1, merged)
        least = at.groupBy("c").agg(F.min("node").alias("community"))
        placed = at.join(least, "c").select("node", "community")
        member = placed if member is None else member.join(placed.withColumnRenamed("node", "inner"), member["community"] == F.col("inner")).select(member["node"], placed["community"])
        member = stored(member, "member")
        if not merged:
            return member
        of = lambda end: placed.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
        joined = links.join(of("src"), "src").join(of("dst"), "dst")
        links = stored(joined.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("w").alias("w")), "edges")


def community_report(corrs: DataFrame, thresholds: list[float], seed: int = 0, within_table: bool = True) -> DataFrame:
    """cluster, node, tbl, var, degree: the communities of the correlations that pass the six signals, the largest first.

    Clusters are numbered by falling size, equal ones by their smallest node; ``degree`` counts a variable's neighbours
    within its cluster.
    """
    edges = stored(variable_edges(filter_signals(corrs, thresholds).withColumnRenamed("r_val", "r"), within_table), "edges")
    parts = part_graph(edges.select("src", "dst", F.lit(1.0).alias("weight")), seed)
    sizes = parts.groupBy("community").agg(F.count(F.lit(1)).alias("size"))  # a row a community
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1)
    own = lambda end: parts.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    inner = degrees(edges.join(own("src"), "src").join(own("dst"), "dst").filter("c_src = c_dst"))
    split = F.split("node", "--", 2)
    return parts.join(numbered, "community").join(inner, "node", "left").select("cluster", "node", F.get(split, F.lit(0)).alias("tbl"), F.get(split, F.lit(1)).alias("var"), F.coalesce("degree", F.lit(0)).alias("degree"))


def communities(edges: DataFrame, seed: int = 0, most: int = 5_000_000) -> dict[str, dict[str, list[str]]]:
    """``Cluster i`` -> table -> variables, the largest first. The graph has one edge a correlated pair of variables; more than ``most`` are refused."""
    rows = edges.select("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: raise the thresholds first")
    groups: dict[int, list[str]] = {}
    for node, c in louvain([(r.src, r.dst, 1.0) for r in rows], seed).items():
        groups.setdefault(c, []).append(node)
    out = {}
    for i, c in enumerate(sorted(groups.values(), key=lambda g: (-len(g), g))):
        tables: dict[str, list[str]] = {}
        for node in c:
            tbl, var = node.split("--", 1)
            tables.setdefault(tbl, []).append(var)
        out[f"Cluster {i}"] = tables
    return out


def within_community(corrs: DataFrame, nodes: DataFrame, same_table: bool = True) -> DataFrame:
    """Correlations both of whose variables are among ``nodes`` (node)."""
    placed = corrs.withColumns({"_a": F.concat_ws("--", "tbl1", "var1"), "_b": F.concat_ws("--", "tbl2", "var2")})
    for c in ("_a", "_b"):
        placed = placed.join(nodes.select(F.col("node").alias(c)), c, "left_semi")
    return placed.drop("_a", "_b") if same_table else placed.filter("tbl1 <> tbl2").drop("_a", "_b")


def _reached(name: str, thresholds: list[float]) -> Column:
    """How many of a signal's thresholds, from the loosest on, a correlation passes; what passes one passes all looser ones."""
    return F.aggregate(F.array(*(F.coalesce(signal_condition(name, t), F.lit(False)).cast("int") for t in thresholds)), F.lit(0), lambda n, one: n + one)


def _settings_reached(shape: tuple[int, ...]):
    """Of cells (t, cell), sorted by t, the number of distinct t that reach each setting: a cell reaches all settings that are looser on every axis."""

    def run(batches):
        total, own, table = np.zeros(shape, np.int32), np.zeros(shape, bool), None

        def close():
            nonlocal own
            for axis in range(len(shape)):
                own = np.flip(np.logical_or.accumulate(np.flip(own, axis), axis), axis)
            np.add(total, own, out=total)
            own = np.zeros(shape, bool)

        for batch in batches:
            names, cells = batch.column("t").to_pylist(), np.asarray(batch.column("cell"))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if table is not None and names[lo] != table:
                    close()
                table = names[lo]
                own.ravel()[cells[lo:hi]] = True
        if table is not None:
            close()
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["cell", "n_tables"])

    return run


def _suffix_sums(shape: tuple[int, ...]):
    """Of cells (cell, n), the number of correlations in each setting: sums over all cells that are as tight or tighter on every axis."""

    def run(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            total.ravel()[np.asarray(batch.column("cell"))] += np.asarray(batch.column("n"))
        for axis in range(len(shape)):
            total = np.flip(np.cumsum(np.flip(total, axis), axis), axis)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n_edges"])

    return run


def threshold_grid(corrs: DataFrame, axes: dict[str, list[float]], n_tables: int, least_coverage: float) -> DataFrame:
    """Coverage and size of the graph under every combination of thresholds: t_<signal>, coverage, n_edges, for those that cover enough tables.

    ``axes`` lists each signal's thresholds from the loosest on. A correlation is put once, at the tightest threshold
    that it passes on each axis. The correlations of all settings are then sums over the cells that are as tight or
    tighter, taken along one axis after the other; so is, table by table, whether a setting has any. What a task holds
    is one number a setting, and no correlation meets a setting.
    """
    shape = tuple(len(axes[n]) for n in SIGNALS)
    ranks = [_reached(n, axes[n]) for n in SIGNALS]
    placed = corrs.select("tbl1", "tbl2", *(r.alias(f"k{i}") for i, r in enumerate(ranks))).filter(" AND ".join(f"k{i} > 0" for i in range(len(shape))))
    strides = [int(np.prod(shape[i + 1 :], dtype=np.int64)) for i in range(len(shape))]
    cell = reduce(lambda a, b: a + b, ((F.col(f"k{i}") - 1).cast("long") * w for i, w in enumerate(strides)))
    cells = placed.select("tbl1", "tbl2", cell.alias("cell"))
    edges = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).repartition(1).mapInArrow(_suffix_sums(shape), "cell long, n_edges long")  # at most a row a setting
    owned = cells.select(F.explode(F.array("tbl1", "tbl2")).alias("t"), "cell").distinct().repartition("t").sortWithinPartitions("t")
    tables = owned.mapInArrow(_settings_reached(shape), "cell long, n_tables long").groupBy("cell").agg(F.sum("n_tables").alias("n"))
    kept = tables.select("cell", F.round(F.col("n") / n_tables, 2).alias("coverage")).filter(F.col("coverage") >= least_coverage).join(edges, "cell")
    settings = [F.get(F.array(*(F.lit(float(t)) for t in axes[n])), (F.floor(F.col("cell") / w) % k).cast("int")).alias(f"t_{n}") for n, w, k in zip(SIGNALS, strides, shape)]
    return kept.select(*settings, "coverage", "n_edges")


def signal_ranges(corrs: DataFrame, steps: dict[str, float], n_tables: int, least_coverage: float) -> dict[str, list[float]]:
    """For each signal the thresholds, from the loosest on, up to the first that leaves too few of the tables.

    Ratios go from 1 down to 0, |r| and samples from their least to their largest value; the loosest always stays. All
    thresholds of all signals, a short list, are tested in one job.
    """
    bounds = corrs.agg(F.min(F.abs("r_val")).alias("r0"), F.max(F.abs("r_val")).alias("r1"), F.min("samples").alias("s0"), F.max("samples").alias("s1")).first()
    span = {"r_val": (bounds.r0, bounds.r1), "samples": (bounds.s0, bounds.s1)}
    lists = {}
    for name, direction in SIGNALS.items():
        low, high = (0.0, 1.0) if direction < 0 else span[name]
        found = [float(t) for t in np.arange(low, high, steps[name])]
        if not found or found[-1] != high:
            found.append(float(high))
        lists[name] = found[::-1] if direction < 0 else found
    passed = [F.when(signal_condition(n, t), F.struct(F.lit(n).alias("signal"), F.lit(i).alias("i"))) for n, ts in lists.items() for i, t in enumerate(ts)]
    kept = corrs.select("tbl1", "tbl2", F.explode(F.filter(F.array(*passed), lambda c: c.isNotNull())).alias("k"))
    tables = kept.select("k.signal", "k.i", F.explode(F.array("tbl1", "tbl2")).alias("t")).groupBy("signal", "i").agg(F.countDistinct("t").alias("n"))
    share = {(r.signal, r.i): r.n / n_tables for r in tables.collect()}
    out = {}
    for name, ts in lists.items():
        good = [share.get((name, i), 0.0) >= least_coverage for i in range(len(ts))]
        out[name] = ts[: good.index(False)] if False in good else ts
        out[name] = out[name] or ts[:1]
    return out


def search_thresholds(corrs: DataFrame, steps: dict[str, float], n_tables: int, least_coverage: float, seed: int = 0) -> dict[tuple[float, float], list[list[float]]]:
    """(coverage, modularity of the table graph's communities) -> settings of the six thresholds, the undominated ones only.

    Settings are the product of the signals' ranges. Their coverage is one job; the table graph of each that covers
    enough is small and is parted on the driver.
    """
    ranges = signal_ranges(corrs, steps, n_tables, least_coverage)
    points: dict[tuple[float, float], list[list[float]]] = {}
    for r in threshold_grid(corrs, ranges, n_tables, least_coverage).collect():
        setting = [r[f"t_{n}"] for n in SIGNALS]
        edges = [(e.src, e.dst, 1.0) for e in table_edges(filter_signals(corrs, setting)).filter("src <> dst").collect()]
        score = round(plain_modularity(edges, louvain(edges, seed)), 2)
        points.setdefault((float(r.coverage), score), []).append([round(t, 2) for t in setting])
    best = [p for p in points if not any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in points)]
    return {p: points[p] for p in sorted(best)}


def plain_modularity(edges: list[tuple[str, str, float]], part: dict[str, int]) -> float:
    m = sum(w for *_, w in edges)
    if not m:
        return 0.0
    inside: dict[int, float] = {}
    ends: dict[int, float] = {}
    for a, b, w in edges:
        for n in (a, b):
            ends[part[n]] = ends.get(part[n], 0.0) + w
        if part[a] == part[b]:
            inside[part[a]] = inside.get(part[a], 0.0) + w
    return sum(inside.get(c, 0.0) / m - (d / (2 * m)) ** 2 for c, d in ends.items())


def best_settings(points: dict[tuple[float, float], list[list[float]]], targets: list[float]) -> dict[float, tuple[float, list[float]]]:
    """For each coverage the best score at or above it, with a setting that reaches it."""
    out = {}
    for t in targets:
        fit = [(score, settings[0]) for (coverage, score), settings in points.items() if coverage >= t]
        if fit:
            out[t] = max(fit)
    return out


def skyline(points: DataFrame, x: str = "coverage", y: str = "score") -> DataFrame:
    """Points that no other one matches or beats in both coordinates, one of equal ones; nulls are no points.

    Each task keeps the skyline of its own rows, in one pass after a sort; what is left, the few rows that their
    neighbours did not beat, is compared once more.
    """
    kinds = [points.schema[c].dataType for c in (x, y)]
    schema = StructType([StructField(x, kinds[0]), StructField(y, kinds[1])])

    def run(batches):
        best: list[tuple] = []
        for batch in batches:
            rows = sorted({*best, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}, reverse=True)
            best = []
            for p in rows:  # from the largest x down, the largest y of each first
                if not best or p[1] > best[-1][1]:
                    best.append(p)
        yield pa.RecordBatch.from_pylist([{x: a, y: b} for a, b in best], schema=to_arrow_schema(schema))

    known = points.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    return known.mapInArrow(run, schema).repartition(1).mapInArrow(run, schema)
