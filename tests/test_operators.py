import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.stats import packed_correlations
from tidemark.operators import bins, correlate, evaluate, factors, graph, index, joins, labels, measures, spatial, topology
from tidemark.operators.measures import Source
from tidemark.plans.engine import Assistant, Engine
from tidemark.plans.search import Options
from tidemark.sources.catalog import Catalog, Entry
from tidemark.sources.csv import read_csv


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def two_tables(spark):
    rng = np.random.default_rng(124)
    a = [(str(i), float(rng.integers(1, 50))) for i in range(1, 21)]
    b = [(str(i), float(rng.integers(1, 50))) for i in range(11, 31)]
    one = frame(spark, [("temporal", "a_k", "a", "x", k, v) for k, v in a] + [("temporal", "a_k", "a", "count", k, 1.0) for k, _ in a], "kind string, agg string, tbl string, var string, val string, x double")
    two = frame(spark, [("temporal", "b_k", "b", "y", k, v) for k, v in b] + [("temporal", "b_k", "b", "count", k, 1.0) for k, _ in b], "kind string, agg string, tbl string, var string, val string, x double")
    return one.union(two), pd.DataFrame(a, columns=["k", "x"]), pd.DataFrame(b, columns=["k", "y"])


def test_imputed_coefficients_equal_the_outer_join(spark):
    long, a, b = two_tables(spark)
    pairs = index.joinable_pairs(measures.keys_of(long), 5)
    got = correlate.pearson_pairs(long, pairs, measures.column_stats(long)).filter("var1 = 'x' AND var2 = 'y'").first()
    both = a.merge(b, on="k", how="outer")
    zero = both[["x", "y"]].fillna(0).corr().iloc[0, 1]
    mean = both[["x", "y"]].fillna(both[["x", "y"]].mean()).corr().iloc[0, 1]
    assert got.n == 10 and abs(got.r_impute_zero - zero) < 1e-9 and abs(got.r_impute_avg - mean) < 1e-9


def test_constants_nulls_and_absent_columns(spark):
    rows = []
    for i in range(6):
        rows += [("spatial", "a_k", "a", v, str(i), x) for v, x in (("up", float(i)), ("same", 3.0), ("none", None), ("once", 2.0 if i == 0 else None), ("count", 1.0))]
        rows += [("spatial", "b_k", "b", v, str(i), x) for v, x in (("down", -2.0 * i), ("count", float(i)))]
    long = frame(spark, rows, "kind string, agg string, tbl string, var string, val string, x double")
    pairs = index.joinable_pairs(measures.keys_of(long), 2)
    got = {(r.var1, r.var2): (r.r, r.p) for r in correlate.pearson_pairs(long, pairs).collect()}
    assert abs(got["up", "down"][0] + 1) < 1e-12 and got["none", "down"] == (0.0, 1.0)
    assert ("same", "down") not in got and ("once", "down") not in got
    assert correlate.masked_pairs(long, pairs).filter("var1 = 'none'").count() == 0


def test_rank_coefficients_with_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 8, 60).astype(float), rng.integers(0, 6, 60).astype(float)
    joined = frame(spark, [("k", "a", "u", "b", "v", str(i), float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "kind string, agg1 string, var1 string, agg2 string, var2 string, val string, x double, y double")
    ranks = [pd.Series(v).rank() for v in (x, y)]
    assert abs(correlate.spearman_pairs(joined).first().r - np.corrcoef(*ranks)[0, 1]) < 1e-12
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    tau = (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())
    got = correlate.kendall_pairs(joined).first()
    assert abs(got.r - tau) < 1e-12 and 0 <= got.p <= 1


def test_one_large_pair_spreads_over_tasks(spark):
    """Ranks of a group come from many ranges, also where one value fills a third of it."""
    from tidemark.operators.ranges import average_ranks, running_totals

    n = 20_000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 1000).cast("double").alias("x"))
    got = average_ranks(rows, ["g"], "x", "rank").toPandas()
    assert (got["rank"] == got["x"].rank()).all() and len(got) == n
    plain = spark.range(n).select(F.lit("g").alias("g"), "id", (F.col("id") % 5).alias("w"))
    out = running_totals(plain, ["g"], ["id"], "w").toPandas().sort_values("id")
    assert (out["before"] == out["w"].cumsum() - out["w"]).all()
    shares = plain.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 8 and max(r["count"] for r in shares) < n / 4


def test_quantiles_by_ranges(spark):
    from tidemark.operators.ranges import quantiles

    rng = np.random.default_rng(11)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 101)] + [("b", float(v)) for v in rng.normal(size=50)] + [("c", 5.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    got = {r.g: (r.low, r.mid, r.high) for r in quantiles(frame(spark, rows, "g string, x double"), ["g"], "x", {"low": 0.25, "mid": 0.5, "high": 0.9}).collect()}
    assert got.keys() == set("abce")
    for g in got:
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g], [0.25, 0.5, 0.9]))


def test_partial_correlation_equals_the_inverse_covariance(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5))
    df = frame(spark, [tuple(map(float, r)) for r in data], "a double, b double, c double, d double, e double")
    got = correlate.partial_correlations(df, [("a", "b"), ("a", "c")], ["c", "d", "e"], None).collect()
    p = np.linalg.inv(np.cov(data, rowvar=False))
    assert len(got) == 1 and abs(got[0].r + p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])) < 1e-9


def test_ten_controls_in_one_pass(spark):
    import time

    rng = np.random.default_rng(4)
    data = rng.normal(size=(500, 14)) @ rng.normal(size=(14, 14))
    names = [f"v{i}" for i in range(14)]
    df = frame(spark, [tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names))
    began = time.time()
    got = {(r.x, r.y): r for r in correlate.partial_correlations(df, [("v0", "v1"), ("v2", "v3"), ("v0", "v3")], names[4:], None).collect()}
    assert time.time() - began < 60  # a busy machine; alone it takes a few seconds
    for x, y in got:
        own = [int(x[1:]), int(y[1:]), *range(4, 14)]
        p = np.linalg.inv(np.cov(data[:, own], rowvar=False))
        assert abs(got[x, y].r + p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])) < 1e-8
    assert len(got) == 3
    # a control given twice, and one that is constant, change nothing; a variable that a control explains has no row
    more = df.withColumn("twice", F.col("v4") * 2 + 1).withColumn("flat", F.lit(3.0)).withColumn("told", 1 - F.col("v0"))
    again = correlate.partial_correlations(more, [("v0", "v1")], [*names[4:], "twice", "flat"], None).first()
    assert abs(again.r - correlate.partial_correlations(df, [("v0", "v1")], names[4:], None).first().r) < 1e-9
    assert correlate.partial_correlations(more, [("v0", "v1")], ["told"], None).count() == 0


def test_controls_of_all_pairs_in_one_job(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    cells = [("k", f"{'abc'[i]}_k", "abc"[i], v, str(k), float(x[k, j])) for j, (i, v) in enumerate([(0, "p"), (1, "q"), (1, "r"), (2, "s")]) for k in range(40) if (i, k) != (2, 7)]
    long = frame(spark, cells, "kind string, agg string, tbl string, var string, val string, x double")
    corrs = frame(spark, [("a_k", "p", "b_k", "q"), ("a_k", "p", "b_k", "r"), ("b_k", "q", "c_k", "s")], "agg1 string, var1 string, agg2 string, var2 string")
    got = {(r.var1, r.var2): (r.n, r.r) for r in correlate.partial_pairs(long, corrs, [("c_k", "s")], None).collect()}
    kept = np.delete(x, 7, 0)  # the control's table lacks a key
    for (a, b), (i, j) in {("p", "q"): (0, 1), ("p", "r"): (0, 2)}.items():
        p = np.linalg.inv(np.cov(kept[:, [i, j, 3]], rowvar=False))
        assert got[a, b][0] == 39 and abs(got[a, b][1] + p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])) < 1e-9
    assert len(got) == 2
    assert correlate.partial_pairs(long, corrs, [], None).count() == 3


def test_false_discovery_rate(spark):
    ps = {"x": [0.001, 0.01, 0.02, 0.0401, 0.5], "z": [0.025, 0.5]}
    corrs = frame(spark, [("t", "a", v, f"b{i}", "y", 0.5, p) for v, own in ps.items() for i, p in enumerate(own)], "kind string, agg1 string, var1 string, agg2 string, var2 string, r double, p double")
    kept = sorted(r.p for r in correlate.benjamini_hochberg(corrs, 0.05).collect())
    assert kept == [0.001, 0.01, 0.02]  # of z none: 0.025 is not below 1 / 2 * 0.05


def test_search_methods_agree(spark):
    long, _, _ = two_tables(spark)
    from tidemark.plans.search import correlations

    options = dict(overlap=5, r_least=0.0, p_most=1.0)
    a = correlations(long, Options(method="INDEX_SEARCH", **options)).collect()
    b = correlations(long, Options(method="JOIN_ALL", **options)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


def test_regression(spark):
    df = frame(spark, [(float(i), float(i * i), 2.0 * i - 3.0 * i * i + 5) for i in range(10)], "a double, b double, y double")
    fit = correlate.regress(df, "y", ["a", "b"])
    assert abs(fit["coefficients"]["a"] - 2) < 1e-6 and abs(fit["coefficients"]["b"] + 3) < 1e-6 and abs(fit["intercept"] - 5) < 1e-6 and abs(fit["r2"] - 1) < 1e-9


def test_csv_with_odd_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,inf,12\n")
    rows = [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv")).collect()]
    assert len(rows) == 3 and (rows[1][0], rows[1][2]) == (4, None)


def test_labels_need_more_than_half(spark):
    rows = [(f"2024-01-{i % 28 + 1:02d}T00:00:00", "60604" if i < h else "x", float(i)) for h in (50,) for i in range(100)]
    df = frame(spark, rows, "made string, place string, amount double")
    assert labels.label_columns(df) == {"t_attrs": [("made", "DateTime")], "s_attrs": [], "num_columns": ["amount"]}
    more = frame(spark, [("60604" if i < 51 else "x",) for i in range(100)], "place string")
    assert labels.label_columns(more)["s_attrs"] == [("place", "zipCode")]


def test_portal_tables(spark):
    meta = frame(spark, [("1", "a", ["start_date", "end_date", "n"], ["Date", "Date", "Number"]), ("2", "b", ["spot", "last_updated"], ["Point", "Date"])], "id string, name string, names array<string>, types array<string>")
    got = labels.portal_tables(meta).collect()
    assert [(r.id, r.t_attrs, r.s_attrs) for r in got] == [("2", [], ["spot"])]


def test_points_on_edges_and_outside(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    regions = frame(spark, [("a", ring(0.0)), ("b", ring(1.0)), ("c", ring(0.0))], "region string, ring array<struct<lon: double, lat: double>>")
    points = frame(spark, [(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 1.0, 0.5), (4, 9.0, 9.0), (5, None, 1.0)], "point_id int, lon double, lat double")
    assert {r.point_id: r.region for r in spatial.locate(points, regions, 0.3).collect()} == {1: "a", 2: "b"}
    assert {(r.region, r.neighbour) for r in spatial.adjacency(regions).collect()} >= {("a", "b"), ("b", "c")}


def box(name, x0, y0, x1, y1, clockwise=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return (name, ring[::-1] if clockwise else ring)


REGION = "region string, ring array<struct<lon: double, lat: double>>"


def test_regions_that_touch(spark):
    shapes = [
        box("a", 0.0, 0.0, 2.0, 2.0), box("shifted", 2.0, 1.0, 4.0, 3.0), box("below", 0.5, -1.0, 1.0, 0.0, True), box("crossing", 1.5, 1.5, 2.5, 5.0), box("within", 0.25, 0.25, 0.75, 0.75),
        box("at_side", 0.0, 0.5, 1.0, 1.0), box("far", 9.0, 9.0, 9.5, 9.5), box("corner", -1.0, -1.0, 0.0, 0.0), box("copy", 9.0, 9.0, 9.5, 9.5), ("tip", [(2.0, 0.5), (3.0, 0.0), (3.0, 0.7)]), box("beside", 0.5, 0.0, 3.5, 2.0),
    ]
    got = {(r.region, r.neighbour) for r in spatial.adjacency(frame(spark, shapes, REGION)).collect()}
    want = {("a", "shifted"), ("a", "below"), ("a", "corner"), ("a", "tip"), ("at_side", "beside"), ("within", "at_side"), ("beside", "below"), ("beside", "corner")}
    want -= {("at_side", "beside"), ("within", "at_side"), ("beside", "corner")}  # these overlap, or are apart
    assert got == want | {(b, a) for a, b in want}
    assert spatial.adjacency(frame(spark, shapes, REGION).limit(0)).count() == 0


def test_shapefiles_in_parts(spark, tmp_path):
    import struct

    from tidemark.sources import shapefile

    shapes = [
        ("001", "North", [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]]),  # with a hole
        ("002", "", [[(5.0, 0.0), (5.0, 1.0), (6.0, 1.0), (6.0, 0.0), (5.0, 0.0)], [(8.0, 0.0), (8.0, 1.0), (9.0, 1.0), (9.0, 0.0), (8.0, 0.0)]]),  # two parts
        ("003", "Null", None), ("004", "Gone", [[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]), ("005", "Caf\xe9", [[(4.0, 0.0), (4.0, 9.0), (4.5, 9.0), (4.0, 0.0)]]),
    ]
    body, index, rows = b"", b"", b""
    for i, (code, name, rings) in enumerate(shapes):
        flat = [p for ring in rings or [] for p in ring]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))] if rings else []
        content = struct.pack("<i", 0) if rings is None else struct.pack(f"<i4d2i{len(starts)}i", 5, 0, 0, 9, 9, len(starts), len(flat), *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", i + 1, len(content) // 2) + content
        rows += (b"*" if name == "Gone" else b" ") + code.encode().ljust(4) + name.encode("latin-1").ljust(8)
    field = lambda n, size: n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15)
    (tmp_path / "t.shp").write_bytes(bytes(100) + body)
    (tmp_path / "t.shx").write_bytes(bytes(100) + index)
    (tmp_path / "t.dbf").write_bytes(b"\x03" + bytes(3) + struct.pack("<IHH", len(shapes), 32 + 64 + 1, 13) + bytes(20) + field("CODE", 4) + field("NAME", 8) + b"\x0d" + rows)
    got = shapefile.read_shapefile(spark, f"file://{tmp_path}/t.shp", records=2)
    assert got.rdd.getNumPartitions() == 3
    have = {r.record: r for r in got.collect()}
    assert sorted(have) == [0, 1, 2, 4] and have[1].NAME is None and have[4].NAME == "Caf\xe9" and have[2].rings is None
    assert [[tuple(p) for p in ring] for ring in have[0].rings] == [ring[:-1] for ring in shapes[0][2]]
    places = shapefile.regions(got, "CODE")
    points = frame(spark, [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.5, 0.5), (4, 8.5, 0.5), (5, 7.0, 0.5), (6, 4.1, 8.0)], "point_id int, lon double, lat double")
    assert {r.point_id: r.region for r in spatial.locate(points, places, 1.0).collect()} == {1: "001", 3: "002", 4: "002", 6: "005"}
    assert {(r.region, r.neighbour) for r in spatial.adjacency(places, 1.0).collect()} == {("001", "005"), ("005", "001")}


def test_features_and_shifts(spark):
    rows = [("temporal", "a_k", "x", f"{i:02d}", float(i)) for i in range(1, 13)]
    long = frame(spark, rows, "kind string, agg string, var string, val string, x double")
    plain = {(r.val, r.sign) for r in topology.features(long).collect()}
    assert plain == {("10", 1), ("11", 1), ("12", 1), ("01", -1), ("02", -1), ("03", -1)}
    moved = {(r.val, r.sign) for r in topology.features(long, 2).collect()}
    assert ("08", 1) in moved and len(moved) == 6


def plain_places(graph, h):
    """Level after level from the smallest hash of each part, parts by that hash."""
    left, out = set(graph), []
    while left:
        level, part = [min(left, key=h.get)], []
        while level:
            part += sorted(level, key=h.get)
            left -= set(level)
            level = {n for v in level for n in graph[v] if n in left}
        out += part
    return out


def test_breadth_first_places_by_joins(spark):
    import hashlib

    rng = np.random.default_rng(2)
    near = [(f"p{a}", f"p{b}") for a, b in rng.integers(0, 30, (26, 2))] + [("p1", "p1"), ("p2", "nowhere")]
    adjacency = frame(spark, near, "region string, neighbour string")
    spatial_keys = [("spatial", "a", f"p{i}") for i in range(30)] + [("spatial", "b", f"p{i}") for i in range(0, 30, 2)]
    st_keys = [("st", "c", f"20{t:02d},p{i}") for t in range(6) for i in range(12) if (t * i) % 5 != 3]
    keys = frame(spark, spatial_keys + st_keys, "kind string, agg string, val string")
    graphs = {a: {v: set() for _, x, v in spatial_keys + st_keys if x == a} for a in "abc"}
    for x, y in near + [(b, a) for a, b in near]:
        for a in "ab":
            if x != y and x in graphs[a] and y in graphs[a]:
                graphs[a][x].add(y)
        for t in range(6):
            u, v = f"20{t:02d},{x}", f"20{t:02d},{y}"
            if x != y and u in graphs["c"] and v in graphs["c"]:
                graphs["c"][u].add(v)
    for v in graphs["c"]:
        t, p = v.split(",")
        for other in (f"{int(t) - 1},{p}", f"{int(t) + 1},{p}"):
            if other in graphs["c"]:
                graphs["c"][v].add(other)
    got = topology.breadth_first_places(keys, topology.key_graph(keys, adjacency), [None, 7]).toPandas()
    for turn, seed in enumerate((None, 7)):
        for a, graph in graphs.items():
            h = {v: "0" + v if seed is None else hashlib.md5(f"{seed}|{v}".encode()).hexdigest() + v for v in graph}
            own = got[(got["turn"] == turn) & (got["agg"] == a)].sort_values("at")
            assert list(own["val"]) == plain_places(graph, h) and list(own["at"]) == list(range(len(graph)))
    # each key takes the value of one other, and no two the same
    mapping = topology.shuffled_keys(keys, topology.key_graph(keys, adjacency), [1, 2]).toPandas()
    assert len(mapping) == 2 * len(spatial_keys + st_keys) and not mapping.duplicated(["turn", "agg", "source"]).any()
    assert topology.shuffled_keys(keys.limit(0), topology.key_graph(keys.limit(0), adjacency), [1]).count() == 0


def test_communities_and_factors(spark):
    edges = [(f"t--a{i}", f"t--a{j}", 1.0) for i in range(5) for j in range(i)] + [(f"u--b{i}", f"u--b{j}", 1.0) for i in range(4) for j in range(i)] + [("t--a0", "u--b0", 1.0)]
    df = frame(spark, edges, "src string, dst string, weight double")
    found = graph.communities(df)
    assert sorted(found["Cluster 0"]["t"]) == [f"a{i}" for i in range(5)] and sorted(found["Cluster 1"]["u"]) == [f"b{i}" for i in range(4)]
    m = np.full((3, 3), 0.81)
    np.fill_diagonal(m, 1)
    loaded = factors.loadings(m, 1)
    assert np.allclose(loaded, 0.9, atol=1e-3)
    assert factors.factor_clusters(["t--a", "t--b", "u--c"], loaded) == {"Cluster 0": {"t": ["a", "b"], "u": ["c"]}}


def test_bins(spark):
    events = frame(spark, [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 02:00:00", 3.0)], "t string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    got = {str(r.bin_start): (r.n, r.total) for r in bins.tumbling(events, "1 hour").collect()}
    assert got == {"2024-01-01 00:00:00": (2, 3.0), "2024-01-01 02:00:00": (1, 3.0)}
    around = {str(r.bin_start): r.n for r in bins.centred(events, 3600, "1 hour").collect()}
    assert around["2024-01-01 01:00:00"] == 2


def test_scores_of_equal_and_crossed_parts(spark):
    same = frame(spark, [(i, i % 3, i % 3) for i in range(30)], "node int, a int, b int")
    r = evaluate.partition_scores(same).first()
    assert abs(r.ari - 1) < 1e-9 and abs(r.v_measure - 1) < 1e-9
    e = frame(spark, [("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    t = frame(spark, [("b", "a", 1.5), ("b", "c", 2.0)], "src string, dst string, weight double")
    s = evaluate.edge_scores(e, t).first()
    assert s.precision == 1 and s.direction_ratio == 0.5 and s.weight_difference == 0.25


def test_engine_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"2024-{m:02d}", m, float(m + rng.normal()), float(rng.normal())) for m in range(1, 13) for _ in range(3)]
    df = frame(spark, rows, "month string, zip int, size double, noise double")
    other = frame(spark, [(f"2024-{m:02d}", 2.0 * m) for m in range(1, 13)], "month string, weight double")
    engine = Engine(spark, f"file://{tmp_path}")
    engine.catalog.register(Entry("one", "Table one", "none"))
    engine.ingest([Source("one", df, {"month": F.col("month")}, {"zip": F.col("zip")}, ("size", "noise")), Source("two", other, {"month": F.col("month")}, {}, ("weight",))])
    found = engine.find_correlations_from("one", Options(overlap=5, r_least=0.6))
    assert len(found.columns) == 28
    rows = found.filter("agg_attr1 = 'avg_size' AND agg_attr2 = 'avg_weight'").collect()
    assert len(rows) == 1 and rows[0]["correlation coefficient"] > 0.9 and rows[0]["table_name1"] == "Table one"
    assert engine.joined_row(rows[0]).count() == 12
    held = engine.control_variables([("one_month", "avg_size", "two_month", "avg_weight")], [("one_month", "avg_noise")]).first()
    assert held.r > 0.9
    assert engine.find_all_correlations(path=f"file://{tmp_path}/found").count() >= 1
    assert engine.explain_discovery(5).count() == 4
    assert "Table one" in Assistant(lambda q: q, rows[0].asDict()).summarize()
    assert engine.regress(("two_month", "avg_weight"), [("one_month", "avg_size")])["r2"] > 0.8


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.register(Entry("t", "T", "x", t_attrs=["d"], s_attrs=[("zip", "ZIPCODE")], num_columns=["n"]))
    c.register(Entry("u", "U", "x"))
    c.save_entries()
    back = Catalog(spark, c.root).load_entries()
    assert back.entries == c.entries and back.profile() == {"tables": 2, "temporal": 1, "spatial": 1, "st": 1, "measures": 1}
    assert set(back.without_keyless().entries) == {"t"}


def test_joins_with_constraints(spark):
    a = frame(spark, [("1", 1.0, 5), ("2", 2.0, 1)], "val string, avg_x double, count long")
    b = frame(spark, [("1", 3.0, 2), ("2", 4.0, 9)], "val string, avg_y double, count long")
    rows = joins.join_and_project({"a": a, "b": b}, [("a", "avg_x"), ("b", "avg_y")], {"a": 2}, samples=True).collect()
    assert [r.asDict() for r in rows] == [{"val": "1", "a_avg_x": 1.0, "a_samples": 5, "b_avg_y": 3.0, "b_samples": 2}]


def test_communities_of_a_known_structure(spark):
    from tidemark.operators import synthetic

    of, edges = synthetic.community_graph(3, 5, 3, inside=0.9, across=0.0, seed=2)
    df = synthetic.sample(spark, len(of), edges, 800, seed=5)
    names = [f"x{i}" for i in range(len(of))]
    m = np.reshape(df.agg(packed_correlations([F.col(n) for n in names])).first()[0], (len(names), len(names)))
    strong = [(f"t--{a}", f"t--{b}") for i, a in enumerate(names) for j, b in enumerate(names[:i]) if abs(m[i, j]) >= 0.3]
    found = graph.louvain([(a, b, 1.0) for a, b in strong], 0)
    parts = frame(spark, [(n, of[int(n[4:])], c) for n, c in found.items()], "node string, a int, b int")
    assert evaluate.partition_scores(parts).first().ari > 0.5
    assert synthetic.sample(spark, 2, {}, 50, "binary").filter("x0 NOT IN (0, 1)").count() == 0
    assert synthetic.calibrate([2.0], [200_000], [1.0], [100_000]) == 1.0


def test_pairs_that_share_enough_without_counting_all(spark):
    """Common keys that all tables have do not pair them all; the pairs are those of the full count."""
    from tidemark.operators.counters import Counters

    rng = np.random.default_rng(8)
    rows = set()
    for t in range(40):
        rows |= {("k", f"t{t:02d}_k", f"t{t % 37:02d}", f"common{i}") for i in range(3)}
        rows |= {("k", f"t{t:02d}_k", f"t{t % 37:02d}", f"own{rng.integers(0, 60)}") for _ in range(int(rng.integers(0, 12)))}
    keys = frame(spark, sorted(rows), "kind string, agg string, tbl string, val string")
    for threshold in (1, 2, 4, 5):
        full, early = Counters(), Counters()
        want = {tuple(r)[:3] for r in index.joinable_pairs(keys, threshold, full).collect()}
        assert {tuple(r) for r in index.pairs_at_least(keys, threshold, early).collect()} == want
        if threshold == 5:
            assert sum(early.values().values()) < 0.6 * full.values()["keys_met"] and want
    assert index.pairs_at_least(keys.limit(0), 2).count() == 0


def test_counts_of_a_search(spark):
    from tidemark.operators.counters import Counters
    from tidemark.plans.search import correlations

    long, *_ = two_tables(spark)
    found = {}
    for method in ("INDEX_SEARCH", "PREFIX_SEARCH", "JOIN_ALL", "COST_MODEL"):
        watch = Counters()
        found[method] = {(r.agg1, r.var1, r.agg2, r.var2) for r in correlations(long, Options(overlap=5, r_least=0.0, p_most=1.0, method=method), watch=watch).collect()}
        counts = watch.values()
        assert counts["pairs"] == 1 and counts["kept"] == len(found[method]) <= counts["tested"]
        assert method != "INDEX_SEARCH" or counts["keys_met"] == 10
    assert len(set(map(frozenset, found.values()))) == 1 and found["JOIN_ALL"]


def test_hashes_and_sketches_merge(spark):
    from tidemark.operators import sketch

    def plain(key):  # 32-bit Murmur3 as published
        data, h = key.encode(), 0
        turn = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
        scramble = lambda k: turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        whole = len(data) // 4 * 4
        for i in range(0, whole, 4):
            h = (turn(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= scramble(int.from_bytes(data[whole:], "little")) if data[whole:] else 0
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        return h - 2**32 if h >= 2**31 else h

    assert plain("foo") == -156908512
    keys = ["foo", "", "a", "ab", "abc", "abcd", "abcde", "2020-01", "漢字 ñ", *(f"key{i}" for i in range(400))]
    df = frame(spark, [(k,) for k in keys], "val string").withColumns({"h": sketch.murmur3(F.col("val")), "u": sketch.unit_hash(F.col("val"))})
    for r in df.collect():
        x = (plain(r.val) + 1) * (0.6180339887498949025 + 1)
        assert r.h == plain(r.val) and r.u == x - np.floor(x)
    rows = frame(spark, [("t" if i % 3 else "s", k) for i, k in enumerate(keys)] + [("t", k) for k in keys[:100]], "agg string, val string").distinct()
    one, two = rows.filter("val < 'key2'"), rows.filter("val >= 'key1'")
    united = sketch.unite(sketch.key_sketch(one, 20), sketch.key_sketch(two, 20), k=20)
    assert sorted(map(tuple, united.collect())) == sorted(map(tuple, sketch.key_sketch(rows, 20).collect())) and united.count() == 40
    guess = {r.agg: r.n_keys for r in sketch.estimate_keys(sketch.key_sketch(rows, 64), 64).collect()}
    true = {r.agg: r["count"] for r in rows.groupBy("agg").count().collect()}
    assert all(0.6 < guess[a] / true[a] < 1.6 for a in true) and sketch.estimate_keys(sketch.key_sketch(rows.limit(5), 64), 64).agg(F.sum("n_keys")).first()[0] == 5


def test_threshold_grid_and_skyline_equal_brute_force(spark):
    import itertools

    rng = np.random.default_rng(6)
    names = [f"{s}{i}" for s in ("missing_ratio", "zero_ratio", "missing_ratio_o", "zero_ratio_o") for i in (1, 2)]
    rows = [(*(round(float(v), 1) for v in rng.random(8)), round(float(rng.uniform(-1, 1)), 1) if k % 9 else None, int(rng.integers(3, 60)), f"t{rng.integers(0, 9)}", f"t{rng.integers(0, 9)}") for k in range(150)]
    corrs = frame(spark, rows, ", ".join(f"{n} double" for n in names) + ", r_val double, samples int, tbl1 string, tbl2 string").repartition(5)
    axes = {"missing_ratio": [1.0, 0.8], "zero_ratio": [1.0, 0.9, 0.5], "missing_ratio_o": [1.0], "zero_ratio_o": [1.0, 0.7], "r_val": [0.0, 0.2, 0.6], "samples": [0.0, 20.0, 1000.0]}
    want = {}
    for t in itertools.product(*axes.values()):
        kept = [r for r in rows if all(max(r[2 * i], r[2 * i + 1]) <= t[i] for i in range(4)) and r[8] is not None and abs(r[8]) >= t[4] and r[9] >= t[5]]
        cover = round(len({x for r in kept for x in r[10:]}) / 9, 2)
        if cover >= 0.3:
            want[t] = (cover, len(kept))
    got = {tuple(r[:6]): (r.coverage, r.n_edges) for r in graph.threshold_grid(corrs, axes, 9, 0.3).collect()}
    assert got == want and len(want) > 10
    assert graph.threshold_grid(corrs.limit(0), axes, 9, 0.0).count() == 0

    pts = [(float(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))] + [(float("nan"), 99)]
    plain = {p for p in pts[:-1] if not any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in pts[:-1])}
    df = frame(spark, [*pts, (None, 5), (100.0, None)], "coverage double, score long").repartition(7)
    assert sorted(map(tuple, graph.skyline(df).collect())) == sorted(plain) and graph.skyline(df.limit(0)).count() == 0


def test_threshold_search(spark):
    rows = [(0.1, 0.2, 0.0, 0.0, 0.1, 0.1, 0.0, 0.0, r, 10 + k, a, b) for k, (r, a, b) in enumerate([(0.9, "a", "b"), (0.8, "b", "c"), (-0.85, "a", "c"), (0.9, "x", "y"), (0.95, "y", "z"), (0.9, "x", "z"), (0.4, "a", "x")])]
    names = [f"{s}{i}" for s in ("missing_ratio", "zero_ratio", "missing_ratio_o", "zero_ratio_o") for i in (1, 2)]
    corrs = frame(spark, rows, ", ".join(f"{n} double" for n in names) + ", r_val double, samples int, tbl1 string, tbl2 string")
    steps = {"missing_ratio": 0.5, "zero_ratio": 1.0, "missing_ratio_o": 1.0, "zero_ratio_o": 1.0, "r_val": 0.3, "samples": 100}
    ranges = graph.signal_ranges(corrs, steps, 6, 0.9)
    assert ranges["missing_ratio"] == [1.0, 0.5] and ranges["r_val"] == [0.4, 0.7] and ranges["samples"] == [10.0]
    found = graph.search_thresholds(corrs, steps, 6, 0.9)
    assert list(found) == [(1.0, 0.5)] and all(s[4] == 0.7 for s in found[1.0, 0.5])
    assert graph.best_settings(found, [0.5, 1.0]).keys() == {0.5, 1.0}


def test_saved_tables_and_listing(spark, tmp_path):
    from tidemark.sources.catalog import Catalog, Entry

    catalog, other = (Catalog(spark, f"file://{tmp_path}/{n}") for n in "ab")
    entry = catalog.register(Entry("t", "Trips", "x.csv", t_attrs=["day"], s_attrs=[("area", "zip")], num_columns=["fare"]))
    assert [r[0] for r in catalog.listing()] == ["t", "t_day_month", "t_area_zip", "t_day_month_area_zip"]
    assert entry.control_variables() == ["avg_fare"] and Entry("u", "u", "u").control_variables() == ["count"] and entry.control_variables(True) == ["avg_fare", "count"]
    frame = spark.createDataFrame([(1, "a")], "x int, y string")
    path = catalog.save(frame, "mine", {"query": "by hand"})
    assert spark.read.csv(path, header=True).columns == ["x", "y"] and catalog.provenance("mine") == {"name": "mine", "columns": ["x", "y"], "query": "by hand"}
    catalog.write("measures", frame)
    other.write("measures", spark.createDataFrame([(2, "b")], "x int, y string"))
    assert catalog.merge(other).read("measures").count() == 2


def _tables(engine):
    """What an engine has stored, in order."""
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    keys = engine.catalog.index().withColumn("aggs", F.array_join("aggs", "|"))
    return [rows(engine.catalog.read(n)) for n in ("measures", "stats", "value_profiles", "profiles", "keys")] + [rows(keys)]


def test_a_catalog_grows_source_by_source(spark, tmp_path):
    def source(tbl, months, factor=1.0, flaw=None):
        rows = [(f"2020-{m:02d}", f"p{m % 3}", factor * m if m != flaw else None) for m in months for _ in range(2)]
        df = spark.createDataFrame(rows, "t string, s string, x double")
        return Source(tbl, df, {"month": F.col("t")}, {"place": F.col("s")}, ("x",))

    one, two, three = source("007", range(1, 9)), source("a/b=c d", range(4, 13), -2.0, 5), source("third", range(2, 4))
    whole = Engine(spark, f"file://{tmp_path}/whole")
    whole.ingest([one, two, three])
    grown = Engine(spark, f"file://{tmp_path}/grown")
    for s in (one, two, three):
        grown.ingest([s])
    assert _tables(grown) == _tables(whole)
    assert {r.tbl for r in grown.long.select("tbl").distinct().collect()} == {"007", "a/b=c d", "third"}
    # again, with other rows: the old ones are gone, also from the index
    other = source("a/b=c d", range(11, 14), 5.0)
    grown.ingest([other])
    replaced = Engine(spark, f"file://{tmp_path}/replaced")
    replaced.ingest([other, three, one])
    assert _tables(grown) == _tables(replaced)
    assert grown.catalog.index().filter("val = '2020-13'").first().aggs == ["a/b=c d_month"]
    # the same again changes nothing
    grown.ingest([other])
    assert _tables(grown) == _tables(replaced)
    # taken out
    grown.remove(["007", "unknown"])
    left = Engine(spark, f"file://{tmp_path}/left")
    left.ingest([three, other])
    assert _tables(grown) == _tables(left)
    assert grown.find_all_correlations(Options(overlap=2, r_least=0.0, p_most=1.0)).count() == left.find_all_correlations(Options(overlap=2, r_least=0.0, p_most=1.0)).count()
    # a source without a row keeps no part
    grown.ingest([source("third", [])])
    assert "third" not in {r.tbl for r in grown.long.select("tbl").distinct().collect()} and grown.catalog.index().filter(F.array_contains("aggs", "third_month")).count() == 0
    # two catalogs read as one have one row a key
    both = Engine(spark, f"file://{tmp_path}/both")
    both.ingest([one])
    both.merge(left)
    keys = both.catalog.index()
    assert keys.count() == keys.select("kind", "val").distinct().count() and keys.filter("cnt > 1").count() > 0


def test_portals_are_read_in_parallel_tasks(spark):
    import json

    from tidemark.sources import portal

    def fetch(url: str) -> bytes:
        if "broken" in url:
            raise OSError("gone")
        if url.endswith("/domains"):
            return json.dumps({"results": [{"domain": "a.org", "count": "3"}]}).encode()
        if "/catalog/" in url:
            at = int(url.split("offset=")[1].split("&")[0])
            return json.dumps({"results": [{"resource": {"id": f"t{k}", "name": f"Table {k}", "columns_field_name": ["day", "x"], "columns_datatype": ["Calendar date", "Number"]}} for k in range(at, min(at + 2, 5))]}).encode()
        return url.encode()

    tables = frame(spark, [("a.org", f"t{i}") for i in range(5)] + [("a.org", "broken")], "domain string, id string").repartition(3)
    got = {r.id: r for r in portal.download(tables, fetch, 7).collect()}
    assert bytes(got["t3"].content) == b"https://a.org/resource/t3.csv?$limit=7" and got["t3"].ok
    assert not got["broken"].ok and got["broken"].error == "gone" and got["broken"].content is None
    assert portal.domains(fetch) == [("a.org", 3)] and portal.metadata_url("a.org", "t1").endswith("/t1")
    listed = portal.datasets(spark, "a.org", 5, fetch, page=2)
    assert sorted(r.id for r in listed.collect()) == [f"t{k}" for k in range(5)]
    assert labels.portal_tables(listed).first().t_attrs == ["day"]


def test_maps_of_results_and_chosen_columns(spark, tmp_path):
    from tidemark.sources.results import correlation_map

    rows = [("1", "One", "avg_x_t1", "2", "Two", "avg_y_t2", 0.5), ("2", "Two", "avg_y_t1", "1", "One", "avg_x_t2", -0.7), ("3", "Three", "count", "1", "One", "avg_x", 1.0), ("4", "Four", "a", "1", "One", "b", None)]
    results = frame(spark, rows, "table_id1 string, table_name1 string, agg_attr1 string, table_id2 string, table_name2 string, agg_attr2 string, `correlation coefficient` double")
    assert {tuple(r) for r in correlation_map(results).collect()} == {("One--avg_x", "Two--avg_y", -0.7), ("One--avg_x", "Three--count", 1.0)}
    assert {tuple(r) for r in correlation_map(results, "id", perfect=False).collect()} == {("1--avg_x", "2--avg_y", -0.7)}
    df = spark.createDataFrame([(pd.Timestamp("2020-03-04").to_pydatetime(), "a", 1)], "t timestamp, s string, n int")
    df.write.parquet(f"file://{tmp_path}/raw")
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.register(Entry("raw", "raw", f"file://{tmp_path}/raw", num_columns=["n"]))
    assert catalog.select_columns("raw", ["s", "n"]).first() == ("a", 1)
    assert catalog.select_columns("raw", ["t", "s"], joined="/", formats={"t": "yyyy-MM"}).first().value == "2020-03/a"


def test_controls_that_a_table_offers(spark, tmp_path):
    rng = np.random.default_rng(9)
    def source(tbl):
        rows = [(f"k{i:02d}", *map(float, rng.normal(size=2))) for i in range(30) for _ in range(2)]
        return Source(tbl, frame(spark, rows, "s string, x double, y double"), {}, {"place": F.col("s")}, ("x", "y"))

    engine = Engine(spark, f"file://{tmp_path}")
    engine.ingest([source("a"), source("b"), source("c")])
    engine.catalog.register(Entry("c", "c", "", num_columns=["x", "y"]))
    corrs = [("a_place", "avg_x", "b_place", "avg_x")]
    by_table = engine.control_by_table(corrs, "c_place").first()
    by_hand = engine.control_variables(corrs, [("c_place", "avg_x"), ("c_place", "avg_y")]).first()
    assert by_table == by_hand and by_table.n == 30


def test_communities_by_joins(spark):
    from tidemark.operators import synthetic

    of, edges = synthetic.community_graph(4, 6, 4, inside=1.0, across=0.02, seed=3)
    rows = [(f"t{a // 5}--{a:02d}", f"t{b // 5}--{b:02d}", 1.0) for a, b in edges]
    df = frame(spark, rows, "src string, dst string, weight double")
    found = {r.node: r.community for r in graph.part_graph(df).collect()}
    plain = graph.louvain(rows, 0)
    assert found.keys() == plain.keys()
    names = {c: i for i, c in enumerate(sorted(set(found.values())))}
    ours, theirs = (graph.plain_modularity(rows, p) for p in ({n: names[c] for n, c in found.items()}, plain))
    assert ours >= theirs - 0.03 and ours > 0.4
    assert all(c == min(n for n in found if found[n] == c) for c in found.values())
    assert {r.node: r.community for r in graph.part_graph(df).collect()} == found  # the same seed, the same parts
    assert graph.part_graph(df.limit(0)).count() == 0
    loop = frame(spark, [("a", "a", 3.0), ("a", "b", 1.0), ("c", "d", 2.0)], "src string, dst string, weight double")
    assert {r.node: r.community for r in graph.part_graph(loop).collect()}["d"] == "c"
    signals = {f"{n}{i}": 0.0 for n in ("missing_ratio", "zero_ratio", "missing_ratio_o", "zero_ratio_o") for i in (1, 2)}
    corrs = frame(spark, [(*signals.values(), 0.9, 10, *a.split("--"), *b.split("--")) for a, b, _ in rows], ", ".join(f"{n} double" for n in signals) + ", r_val double, samples int, tbl1 string, var1 string, tbl2 string, var2 string")
    report = graph.community_report(corrs, [1.0, 1.0, 1.0, 1.0, 0.5, 5]).toPandas()
    assert len(report) == len(found) and report.groupby("cluster")["node"].count().is_monotonic_decreasing and report["degree"].max() > 1


def test_rollups_of_several_batches(spark, tmp_path):
    from tidemark.streaming import rollup

    def add(k, rows):
        frame(spark, rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")

    at = lambda h, m: pd.Timestamp(f"2024-01-01 {h:02d}:{m:02d}").to_pydatetime()
    run = lambda: rollup.start(rollup.rollup(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"file://{tmp_path}/in/*")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    add(0, [(at(1, 5), "a", 1.0), (at(1, 50), "a", 3.0), (at(2, 0), "b", 5.0)])
    run()
    add(1, [(at(1, 59), "a", 8.0), (at(3, 0), "b", 2.0)])
    run()
    got = {(r.event_type, r.bin_start.hour): (r.n, r.avg_value) for r in rollup.current(spark, f"file://{tmp_path}/out").collect()}
    assert got == {("a", 1): (3, 4.0), ("b", 2): (1, 5.0), ("b", 3): (1, 2.0)}


def test_a_turn_deals_edges_out_twice(spark, monkeypatch):
    plans, plain = [], graph.stored

    def stored(frame, name="rows"):
        if "moved" in frame.columns:
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame, name)

    monkeypatch.setattr(graph, "stored", stored)
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("false", "-1")):
            spark.conf.set(name, value)
        found = graph.part_graph(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "src string, dst string, weight double"))
        assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    shuffles = [p.count("Exchange hashpartitioning") - p.count("ReusedExchange") for p in plans]
    assert plans and max(shuffles) <= 6, shuffles
