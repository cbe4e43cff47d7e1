"""The engine's registered queries, each with the SQL that gives the same rows.

The collection: ``orders`` and ``lineitem`` by month and by the nation of their customer or supplier, ``customer`` and
``supplier`` by nation. Nulls are made from values where a query is about them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions.stats import correlation_log_p
from tidemark.operators import bins, correlate, evaluate, factors, graph, index, joins, labels, measures, ranges, sketch, spatial, topology
from tidemark.operators.counters import Counters
from tidemark.operators.measures import Source, Variable
from tidemark.plans.engine import Engine
from tidemark.plans.search import Options, correlations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the nation of their customer."""
    return table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the nation of their supplier."""
    return table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")


def sources(spark: SparkSession, d: str) -> list[Source]:
    month = lambda c: {"month": K.time_key(F.col(c), K.TimeUnit.MONTH)}
    place = {"nation": F.col("nation").cast("string")}
    discount = F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    return [
        Source("orders", orders(spark, d), month("o_orderdate"), place, ("o_totalprice",)),
        Source("lineitem", lines(spark, d).withColumn("big_discount", discount), month("l_shipdate"), place, ("l_quantity", "l_extendedprice", "l_tax", "big_discount")),
        Source("customer", table(spark, d, "customer").withColumn("nation", F.col("c_nationkey")), {}, place, ("c_acctbal",)),
        Source("supplier", table(spark, d, "supplier").withColumn("nation", F.col("s_nationkey")), {}, place, ("s_acctbal",)),
    ]


def long(spark: SparkSession, d: str, round_dp: int | None = None) -> DataFrame:
    return measures.measures(sources(spark, d), round_dp=round_dp)


# The same long form in SQL.
_RAW = """
    o AS (SELECT *, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
    l AS (SELECT *, s_nationkey AS nation, CASE WHEN l_discount > 0.05 THEN l_discount END AS big FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    ok AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, nation::VARCHAR AS nation, o_totalprice FROM o),
    lk AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, nation::VARCHAR AS nation, l_quantity, l_extendedprice, l_tax, big FROM l),
    og AS (SELECT 'temporal' AS kind, 'orders_month' AS agg, month AS val, avg(o_totalprice) AS a, count(*) AS n FROM ok GROUP BY month
        UNION ALL SELECT 'spatial', 'orders_nation', nation, avg(o_totalprice), count(*) FROM ok GROUP BY nation
        UNION ALL SELECT 'st', 'orders_month_nation', month || ',' || nation, avg(o_totalprice), count(*) FROM ok GROUP BY ALL),
    lg AS (SELECT 'temporal' AS kind, 'lineitem_month' AS agg, month AS val, avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_tax) AS t, avg(big) AS b, count(*) AS n FROM lk GROUP BY month
        UNION ALL SELECT 'spatial', 'lineitem_nation', nation, avg(l_quantity), avg(l_extendedprice), avg(l_tax), avg(big), count(*) FROM lk GROUP BY nation
        UNION ALL SELECT 'st', 'lineitem_month_nation', month || ',' || nation, avg(l_quantity), avg(l_extendedprice), avg(l_tax), avg(big), count(*) FROM lk GROUP BY ALL),
    cg AS (SELECT 'spatial' AS kind, 'customer_nation' AS agg, c_nationkey::VARCHAR AS val, avg(c_acctbal) AS a, count(*) AS n FROM customer GROUP BY c_nationkey),
    sg AS (SELECT 'spatial' AS kind, 'supplier_nation' AS agg, s_nationkey::VARCHAR AS val, avg(s_acctbal) AS a, count(*) AS n FROM supplier GROUP BY s_nationkey),
    m0 AS (SELECT kind, agg, 'orders' AS tbl, 'avg_o_totalprice' AS var, val, a AS x FROM og UNION ALL SELECT kind, agg, 'orders', 'count', val, n FROM og
        UNION ALL SELECT kind, agg, 'lineitem', 'avg_l_quantity', val, q FROM lg UNION ALL SELECT kind, agg, 'lineitem', 'avg_l_extendedprice', val, e FROM lg
        UNION ALL SELECT kind, agg, 'lineitem', 'avg_l_tax', val, t FROM lg UNION ALL SELECT kind, agg, 'lineitem', 'avg_big_discount', val, b FROM lg
        UNION ALL SELECT kind, agg, 'lineitem', 'count', val, n FROM lg
        UNION ALL SELECT kind, agg, 'customer', 'avg_c_acctbal', val, a FROM cg UNION ALL SELECT kind, agg, 'customer', 'count', val, n FROM cg
        UNION ALL SELECT kind, agg, 'supplier', 'avg_s_acctbal', val, a FROM sg UNION ALL SELECT kind, agg, 'supplier', 'count', val, n FROM sg)"""
_LONG = f"WITH {_RAW}, m AS (SELECT * FROM m0), k AS (SELECT kind, agg, tbl, val FROM m WHERE var = 'count')"
_ROUNDED = f"WITH {_RAW}, m AS (SELECT * REPLACE (round_even(x, 3) AS x) FROM m0), k AS (SELECT kind, agg, tbl, val FROM m WHERE var = 'count')"
_PAIRS = """,
    sz AS (SELECT kind, agg, tbl, count(*) AS n FROM k GROUP BY ALL),
    kp AS (SELECT a.kind, a.agg AS agg1, b.agg AS agg2, count(*) AS overlap FROM k a JOIN k b ON a.kind = b.kind AND a.val = b.val AND a.tbl <> b.tbl
        JOIN sz x ON x.agg = a.agg JOIN sz y ON y.agg = b.agg WHERE (x.n, a.agg) < (y.n, b.agg) GROUP BY ALL HAVING count(*) >= 5)"""
_JOINED = """,
    j AS (SELECT p.kind, p.agg1, a.tbl AS tbl1, a.var AS var1, p.agg2, b.tbl AS tbl2, b.var AS var2, a.val, a.x, b.x AS y
        FROM kp p JOIN m a ON a.agg = p.agg1 JOIN m b ON b.agg = p.agg2 AND a.val = b.val)"""
_STATS = """,
    st AS (SELECT agg, var, sum(x) AS s, sum(x * x) AS ss, avg(x) AS mean, (count(*) - 1) * var_samp(x) AS res, count(*) AS cnt FROM m GROUP BY ALL)"""
_R = "coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"
_R0 = _R.format(x="coalesce(x, 0)", y="coalesce(y, 0)")
_CORR = f""",
    c AS (SELECT kind, agg1, tbl1, var1, agg2, tbl2, var2, count(*) AS n, {_R0} AS r, sum(coalesce(x, 0)) AS sx, sum(coalesce(y, 0)) AS sy, sum(coalesce(x, 0) * coalesce(y, 0)) AS sxy
        FROM j GROUP BY ALL HAVING count(DISTINCT x) <> 1 AND count(DISTINCT y) <> 1)"""
_P = """CASE WHEN {v} < 1 THEN NULL WHEN abs({r}) >= 1 THEN 0::DOUBLE
    WHEN {v} % 2 = 0 THEN greatest(0, 1 - abs({r}) * (SELECT sum(coalesce((SELECT product((2 * j - 1) / (2 * j) * (1 - {r} * {r})) FROM range(1, k) q(j)), 1)) FROM range(1, greatest({v} // 2, 1) + 1) z(k)))
    WHEN {v} = 1 THEN 1 - 2 / pi() * asin(abs({r}))
    ELSE greatest(0, 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * (SELECT sum(coalesce((SELECT product((2 * j) / (2 * j + 1) * (1 - {r} * {r})) FROM range(1, k) q(j)), 1)) FROM range(1, greatest(({v} - 1) // 2, 1) + 1) z(k)))) END"""
_P2 = _P.format(v="(n - 2)", r="r")


def _rounded(df: DataFrame, dp: int = 6, *columns: str) -> DataFrame:
    """Means of prices often lie halfway between two values of four places, where the last bit decides: they are nudged up."""
    return df.withColumns({c: F.round(F.col(c) + (1e-7 if dp == 4 else 0.0), dp) for c in columns})


# Keys and aggregation

for _unit, _format in (("HOUR", "%Y-%m-%d-%H"), ("DAY", "%Y-%m-%d"), ("MONTH", "%Y-%m"), ("YEAR", "%Y"), ("QUARTER", None)):
    _val = f"strftime(ts, '{_format}')" if _format else "strftime(ts, '%Y') || '-' || quarter(ts)"

    @query(f"agg_time_{_unit.lower()}", f"SELECT {_val} AS val, round(avg(value), 6) AS avg_value, count(*) AS \"count\" FROM events GROUP BY 1")
    def _agg_time(spark, d, unit=_unit):
        return _rounded(measures.aggregate_by(table(spark, d, "events"), K.time_key(F.col("ts"), K.TimeUnit[unit]), [Variable("value")]), 6, "avg_value")


@query("agg_space_nation", "SELECT c_nationkey::VARCHAR AS val, round(avg(c_acctbal), 6) AS avg_c_acctbal, count(*) AS \"count\" FROM customer GROUP BY 1")
def agg_space_nation(spark, d):
    return _rounded(measures.aggregate_by(table(spark, d, "customer"), K.space_key(F.col("c_nationkey")), [Variable("c_acctbal")]), 6, "avg_c_acctbal")


@query("agg_space_levels", "SELECT n_regionkey || '-' || n_nationkey AS val, round(avg(c_acctbal), 6) AS avg_c_acctbal, count(*) AS \"count\" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agg_space_levels(spark, d):
    placed = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _rounded(measures.aggregate_by(placed, K.space_key(F.col("n_regionkey"), F.col("n_nationkey")), [Variable("c_acctbal")]), 6, "avg_c_acctbal")


@query("agg_time_space", "SELECT strftime(o_orderdate, '%Y-%m') || ',' || c_nationkey AS val, round(avg(o_totalprice) + 1e-7, 4) AS avg_o_totalprice, count(*) AS \"count\" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_time_space(spark, d):
    key = K.joint_key(K.time_key(F.col("o_orderdate"), K.TimeUnit.MONTH), F.col("nation").cast("string"))
    return _rounded(measures.aggregate_by(orders(spark, d), key, [Variable("o_totalprice")]), 4, "avg_o_totalprice")


@query("agg_min_max_median_sum", """SELECT strftime(l_shipdate, '%Y-%m') AS val, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
    round(median(l_extendedprice) + 1e-7, 4) AS median_l_extendedprice, round(sum(l_quantity) + 1e-7, 4) AS sum_l_quantity, count(l_tax) AS count_l_tax FROM lineitem GROUP BY 1""")
def agg_others(spark, d):
    wanted = [Variable("l_quantity", "min"), Variable("l_quantity", "max"), Variable("l_extendedprice", "median"), Variable("l_quantity", "sum"), Variable("l_tax", "count")]
    out = measures.aggregate_by(table(spark, d, "lineitem"), K.time_key(F.col("l_shipdate"), K.TimeUnit.MONTH), wanted, with_count=False)
    return _rounded(out, 4, "median_l_extendedprice", "sum_l_quantity")


@query("agg_all_keys", f"WITH {_RAW} SELECT kind, agg, val, round(q, 5) AS avg_l_quantity, round(e + 1e-7, 4) AS avg_l_extendedprice, round(t, 6) AS avg_l_tax, round(b, 6) AS avg_big_discount, n AS \"count\" FROM lg")
def agg_all_keys(spark, d):
    out = measures.aggregate_all(sources(spark, d)[1])
    return _rounded(_rounded(_rounded(out, 6, "avg_l_tax", "avg_big_discount"), 5, "avg_l_quantity"), 4, "avg_l_extendedprice")


@query("time_range", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS val, count(*) AS \"count\" FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def time_range(spark, d):
    kept = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1996-01-01' AND l_shipdate < timestamp_ntz'1997-01-01'")
    return measures.aggregate_by(kept, K.time_key(F.col("l_shipdate"), K.TimeUnit.DAY), [])


@query("measures_long", f"{_LONG} SELECT kind, agg, tbl, var, val, round(x + 1e-7, 4) AS x FROM m")
def measures_long(spark, d):
    return _rounded(long(spark, d), 4, "x")


# The index and discovery


@query("inv_index", f"{_LONG} SELECT kind, val, array_to_string(list_sort(list(DISTINCT agg)), '|') AS aggs FROM k GROUP BY ALL")
def inv_index(spark, d):
    return index.inverted_index(measures.keys_of(_stored(long(spark, d)))).withColumn("aggs", F.array_join("aggs", "|"))


@query("inv_index_cnt", f"{_LONG} SELECT kind, val, count(DISTINCT agg) AS cnt FROM k GROUP BY ALL")
def inv_index_cnt(spark, d):
    return index.index_counts(measures.keys_of(_stored(long(spark, d))))


_CNT = ", ic AS (SELECT kind, val, count(DISTINCT agg) AS cnt FROM k GROUP BY ALL), tc AS (SELECT agg, val, cnt FROM k JOIN ic USING (kind, val))"
_COST = ", sc AS (SELECT agg, count(*) AS n_keys, sum(cnt)::BIGINT AS rows_to_read, ((sum(cnt) - count(*)) // 5)::BIGINT AS max_joinable FROM tc GROUP BY agg)"


@query("agg_cnt", f"{_LONG}{_CNT} SELECT agg, val, cnt FROM tc")
def agg_cnt(spark, d):
    return index.table_counts(measures.keys_of(_stored(long(spark, d))))


@query("rows_to_read", f"{_LONG}{_CNT}{_COST} SELECT * FROM sc")
def rows_to_read(spark, d):
    return index.search_costs(measures.keys_of(_stored(long(spark, d))), 5)


_CAND = "SELECT a.agg, b.agg AS cand, count(*) AS overlap FROM k a JOIN k b ON a.kind = b.kind AND a.val = b.val AND a.tbl <> b.tbl GROUP BY ALL HAVING count(*) >= 5"


@query("join_candidates", f"{_LONG} {_CAND}")
def join_candidates(spark, d):
    return index.candidates(measures.keys_of(_stored(long(spark, d))), 5)


_SAMPLED = """, rk AS (SELECT *, row_number() OVER (PARTITION BY agg ORDER BY cnt DESC, val) AS r FROM tc),
    pk AS (SELECT rk.* FROM rk JOIN sc USING (agg) WHERE r <= floor(n_keys * 0.05)),
    sl AS (SELECT agg, floor(max(rows_to_read) / sum(cnt))::BIGINT AS scale FROM pk JOIN sc USING (agg) GROUP BY agg),
    es AS (SELECT a.agg, b.agg AS cand, count(*) * any_value(scale) AS estimate FROM pk JOIN k a ON a.agg = pk.agg AND a.val = pk.val JOIN k b ON a.kind = b.kind AND a.val = b.val AND a.tbl <> b.tbl
        JOIN sl ON sl.agg = a.agg GROUP BY ALL HAVING estimate >= 5)"""


@query("join_candidates_sampled", f"{_LONG}{_CNT}{_COST}{_SAMPLED} SELECT * FROM es")
def join_candidates_sampled(spark, d):
    return index.sampled_candidates(measures.keys_of(_stored(long(spark, d))), 5)


@query("join_cost", f"""{_LONG}, s AS (SELECT kind, agg, count(*) AS cnt FROM k GROUP BY ALL HAVING count(*) >= 5),
    w AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY kind) AS n, avg(cnt) OVER (PARTITION BY kind ORDER BY cnt DESC, agg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s WINDOW o AS (PARTITION BY kind ORDER BY cnt DESC, agg))
    SELECT kind, agg, cnt, round(i / n * cnt + (1 - i / n) * rest, 2) AS cost FROM w""")
def join_cost(spark, d):
    return index.join_costs(measures.keys_of(_stored(long(spark, d))), 5)


@query("joinable_pairs", f"{_LONG}{_PAIRS} SELECT * FROM kp")
def joinable_pairs(spark, d):
    return index.joinable_pairs(measures.keys_of(_stored(long(spark, d))), 5)


@query("joinable_early", f"{_LONG}{_PAIRS} SELECT kind, agg1, agg2 FROM kp")
def joinable_early(spark, d):
    return index.pairs_at_least(measures.keys_of(_stored(long(spark, d))), 5)


@query("search_counts", f"""{_LONG}{_PAIRS}{_JOINED}{_CORR}{_STATS}, f AS (SELECT c.*, {_P2} AS p FROM c JOIN st u ON u.agg = agg1 AND u.var = var1 AND u.res <> 0 JOIN st v ON v.agg = agg2 AND v.var = var2 AND v.res <> 0)
    SELECT 'keys_met' AS phase, (SELECT count(*) FROM k a JOIN k b ON a.kind = b.kind AND a.val = b.val AND a.tbl < b.tbl)::BIGINT AS n UNION ALL SELECT 'pairs', count(*) FROM kp UNION ALL SELECT 'tested', count(*) FROM f
    UNION ALL SELECT 'kept', count(*) FILTER (abs(r) >= 0.1 AND p <= 0.5) FROM f""")
def search_counts(spark, d):
    """What each phase of a search over all tables saw."""
    watch = Counters()
    correlations(_stored(long(spark, d)), Options(overlap=5, r_least=0.1, p_most=0.5), watch=watch).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(watch.values().items()), "phase string, n long")


@query("all_pairs", f"{_LONG}{_PAIRS} SELECT x.kind, x.agg AS agg1, y.agg AS agg2 FROM sz x JOIN sz y ON x.kind = y.kind AND x.tbl <> y.tbl AND (x.n, x.agg) < (y.n, y.agg) WHERE x.n >= 5 AND y.n >= 5")
def all_pairs(spark, d):
    return index.all_pairs(measures.keys_of(_stored(long(spark, d))), 5)


@query("discovery_method", f"""{_LONG}{_PAIRS}{_CNT}{_COST}{_SAMPLED},
    ev AS (SELECT x.agg, sum(least(x.n, y.n)) AS all_cost, count(*) AS n_cands FROM sz x JOIN sz y ON x.kind = y.kind AND x.tbl <> y.tbl GROUP BY x.agg),
    gs AS (SELECT es.agg, count(*) AS kk, avg(least(x.n, y.n)) AS each_ FROM es JOIN sz x ON x.agg = es.agg JOIN sz y ON y.agg = es.cand GROUP BY es.agg),
    t AS (SELECT sz.agg, CASE WHEN n >= 100000 THEN 4.2 ELSE 0.1 END::DOUBLE * (n + rows_to_read) AS overhead, n, max_joinable, coalesce(n_cands, 0) AS n_cands, coalesce(all_cost, 0)::DOUBLE AS all_cost, coalesce(kk * each_, 0) AS guess
        FROM sz JOIN sc USING (agg) LEFT JOIN ev USING (agg) LEFT JOIN gs USING (agg) WHERE n >= 5),
    f AS (SELECT *, overhead + least(max_joinable, n_cands) * n AS find_cost FROM t)
    SELECT agg, round(overhead, 3) AS overhead, round(find_cost, 3) AS find_cost, all_cost, CASE WHEN find_cost <= all_cost THEN 'INDEX_SEARCH' WHEN overhead >= all_cost THEN 'JOIN_ALL' WHEN overhead + guess <= all_cost THEN 'INDEX_SEARCH' ELSE 'JOIN_ALL' END AS method FROM f""")
def discovery_method(spark, d):
    return _rounded(index.choose_method(measures.keys_of(_stored(long(spark, d))), 5), 3, "overhead", "find_cost")


def _monthly(spark, d) -> tuple[DataFrame, DataFrame]:
    month = lambda c: K.time_key(F.col(c), K.TimeUnit.MONTH)
    a = measures.aggregate_by(table(spark, d, "orders"), month("o_orderdate"), [Variable("o_totalprice")])
    return a, measures.aggregate_by(table(spark, d, "lineitem"), month("l_shipdate"), [Variable("l_quantity"), Variable("l_tax")])


_MONTHLY = """WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS val, avg(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1),
    b AS (SELECT strftime(l_shipdate, '%Y-%m') AS val, avg(l_quantity) AS q, avg(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1)"""


@query("key_intersect", f"{_MONTHLY} SELECT val FROM a INTERSECT SELECT val FROM b")
def key_intersect(spark, d):
    return joins.shared_keys(*_monthly(spark, d))


@query("key_overlap", f"{_MONTHLY} SELECT count(*) AS overlap FROM a JOIN b USING (val)")
def key_overlap(spark, d):
    return joins.shared_keys(*_monthly(spark, d)).agg(F.count(F.lit(1)).alias("overlap"))


# Joins


@query("align_inner", f"{_MONTHLY} SELECT val, round(p + 1e-7, 4) AS avg_o_totalprice_t1, round(q, 6) AS avg_l_quantity_t2 FROM a JOIN b USING (val)")
def align_inner(spark, d):
    a, b = _monthly(spark, d)
    return _rounded(_rounded(joins.align_inner(a, ["avg_o_totalprice"], b, ["avg_l_quantity"]), 4, "avg_o_totalprice_t1"), 6, "avg_l_quantity_t2")


@query("align_outer", f"{_MONTHLY} SELECT a.val AS key1, b.val AS key2, round(p + 1e-7, 4) AS avg_o_totalprice_t1, round(q, 6) AS avg_l_quantity_t2 FROM a FULL JOIN b ON a.val = b.val")
def align_outer(spark, d):
    a, b = _monthly(spark, d)
    return _rounded(_rounded(joins.align_outer(a, ["avg_o_totalprice"], b, ["avg_l_quantity"]), 4, "avg_o_totalprice_t1"), 6, "avg_l_quantity_t2")


@query("align_star", """SELECT a.val, round(a.x, 6) AS customer_avg_c_acctbal, round(b.x, 6) AS supplier_avg_s_acctbal, round(c.x + 1e-7, 4) AS orders_avg_o_totalprice FROM
    (SELECT c_nationkey::VARCHAR AS val, avg(c_acctbal) AS x FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey::VARCHAR AS val, avg(s_acctbal) AS x FROM supplier GROUP BY 1) b USING (val)
    JOIN (SELECT c_nationkey::VARCHAR AS val, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) c USING (val)""")
def align_star(spark, d):
    tables = {s.tbl: measures.aggregate_by(s.df, s.places["nation"], [Variable(m) for m in s.measures]) for s in sources(spark, d)}
    out = joins.join_and_project(tables, [("customer", "avg_c_acctbal"), ("supplier", "avg_s_acctbal"), ("orders", "avg_o_totalprice")])
    return _rounded(_rounded(out, 6, "customer_avg_c_acctbal", "supplier_avg_s_acctbal"), 4, "orders_avg_o_totalprice")


@query("join_project_constrained", f"{_MONTHLY} SELECT val, round(p + 1e-7, 4) AS orders_avg_o_totalprice, a.n AS orders_samples, round(q, 6) AS lineitem_avg_l_quantity, b.n AS lineitem_samples FROM a JOIN b USING (val) WHERE a.n >= 5 AND b.n >= 60")
def join_project_constrained(spark, d):
    a, b = _monthly(spark, d)
    out = joins.join_and_project({"orders": a, "lineitem": b}, [("orders", "avg_o_totalprice"), ("lineitem", "avg_l_quantity")], {"orders": 5, "lineitem": 60}, samples=True)
    return _rounded(_rounded(out, 4, "orders_avg_o_totalprice"), 6, "lineitem_avg_l_quantity")


@query("align_reduced", """SELECT val, round(a + 1e-7, 4) AS a, round(b, 6) AS b FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS val, avg(o_totalprice) AS a FROM orders GROUP BY 1)
    JOIN (SELECT strftime(l_shipdate, '%Y-%m-%d') AS val, avg(l_quantity) AS b FROM lineitem GROUP BY 1) USING (val)""")
def align_reduced(spark, d):
    day = lambda c: K.time_key(F.col(c), K.TimeUnit.DAY)
    out = joins.align_reduced(table(spark, d, "orders"), day("o_orderdate"), table(spark, d, "lineitem"), day("l_shipdate"), "o_totalprice", "l_quantity")
    return _rounded(_rounded(out, 4, "a"), 6, "b")


# Profiles


@query("col_stats", f"{_LONG}{_STATS} SELECT agg, var, round(s, 2) AS sum, round(ss, -2) AS sum_square, round(mean + 1e-7, 4) AS avg, round(res, -2) AS res_sum, cnt FROM st")
def col_stats(spark, d):
    out = measures.column_stats(long(spark, d))
    return _rounded(_rounded(_rounded(out, 2, "sum"), -2, "sum_square", "res_sum"), 4, "avg")


@query("col_profile", """SELECT 'lineitem' AS tbl, 'l_discount' AS var, round(avg((l_discount IS NULL)::INT), 2) AS missing_ratio, round(avg(coalesce(l_discount = 0, FALSE)::INT), 2) AS zero_ratio FROM lineitem
    UNION ALL SELECT 'lineitem', 'big_discount', round(avg((big IS NULL)::INT), 2), round(avg(coalesce(big = 0, FALSE)::INT), 2) FROM (SELECT CASE WHEN l_discount > 0.05 THEN l_discount END AS big FROM lineitem)""")
def col_profile(spark, d):
    df = table(spark, d, "lineitem").withColumn("big_discount", F.when(F.col("l_discount") > 0.05, F.col("l_discount")))
    return measures.column_profile(df, "lineitem", ("l_discount", "big_discount"))


@query("total_vars", f"{_LONG} SELECT agg, count(*) FILTER (c > 1) AS n_vars FROM (SELECT agg, var, count(DISTINCT x) AS c FROM m GROUP BY ALL) GROUP BY agg")
def total_vars(spark, d):
    return measures.varying(_stored(long(spark, d)))


@query("label_columns", r"""WITH e AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS made, CASE WHEN event_id % 10 < 6 THEN lpad((60000 + event_id % 1000)::VARCHAR, 5, '0') ELSE 'none' END AS area,
        'POINT (' || (event_id % 90) || '.5 ' || (event_id % 45) || '.25)' AS spot FROM events)
    SELECT c AS "column", a AS axis, k AS kind, round(s, 6) AS share FROM (SELECT 'made' AS c, 'time' AS a, 'DateTime' AS k, avg(regexp_matches(made, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}')::INT) AS s FROM e
    UNION ALL SELECT 'area', 'place', 'zipCode', avg(regexp_matches(area, '^\d{5}$')::INT) FROM e UNION ALL SELECT 'spot', 'place', 'geoCoordinate', avg(regexp_matches(spot, '^POINT')::INT) FROM e) WHERE s > 0.5""")
def label_columns(spark, d):
    e = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("made"),
        F.when(F.col("event_id") % 10 < 6, F.lpad((60000 + F.col("event_id") % 1000).cast("string"), 5, "0")).otherwise("none").alias("area"),
        F.concat(F.lit("POINT ("), (F.col("event_id") % 90).cast("string"), F.lit(".5 "), (F.col("event_id") % 45).cast("string"), F.lit(".25)")).alias("spot"),
    )
    return _rounded(labels.match_shares(e).filter("share > 0.5"), 6, "share")


# Statistics


def _stored(frame: DataFrame) -> DataFrame:
    """The long form, written once, so that keys, pairs and measures read it rather than the raw tables again."""
    return ranges.stored(frame, "long")


def _with_pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    """The long form and the joinable pairs of its tables, of all three kinds."""
    m = _stored(long(spark, d))
    return m, index.joinable_pairs(measures.keys_of(m), 5)


_FEW_JOINED = _PAIRS + _JOINED


@query("pearson_pairs", f"{_LONG}{_FEW_JOINED}{_CORR} SELECT kind, agg1, var1, agg2, var2, n, round(r, 6) AS r, round({_P2}, 6) AS p FROM c")
def pearson_pairs(spark, d):
    out = correlate.pearson_pairs(*_with_pairs(spark, d))
    return _rounded(out, 6, "r", "p").drop("tbl1", "tbl2")


@query("pearson_masked", f"{_LONG}{_FEW_JOINED}, c AS (SELECT kind, agg1, var1, agg2, var2, count(*) AS n, {_R.format(x='x', y='y')} AS r FROM j WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL) SELECT kind, agg1, var1, agg2, var2, n, round(r, 6) AS r, round({_P2}, 6) AS p FROM c")
def pearson_masked(spark, d):
    return _rounded(correlate.masked_pairs(*_with_pairs(spark, d)), 6, "r", "p")


_TAILS = "SELECT p_partkey, 3 + (p_partkey * 31 + p_size) % 1997 AS n, ((p_partkey * 7 + p_size) % 39 - 19) / 20.0::DOUBLE AS r FROM part"


@query("pearson_pvalue", f"""WITH t AS ({_TAILS}), q AS (SELECT *, ((n - 2) / 2)::DOUBLE AS a, 1 - r * r AS x FROM t WHERE abs(r) >= 0.2 AND abs(r) < 1)
    SELECT p_partkey, n::BIGINT AS n, round((a * ln(x) + ln(abs(r)) + lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) - ln(a)
        + ln((SELECT sum(exp(lgamma(a + 0.5 + k) - lgamma(a + 0.5) - lgamma(a + 1 + k) + lgamma(a + 1) + k * ln(x))) FROM range(0, 1200) s(k)))) / ln(10), 7) AS log10_p FROM q""")
def pearson_pvalue(spark, d):
    """The order of magnitude of p for correlations made from parts; SQL sums the tail as a series of positive terms."""
    k = F.col("p_partkey")
    r = ((k * 7 + F.col("p_size")) % 39 - 19) / 20.0
    rows = table(spark, d, "part").select("p_partkey", (3 + (k * 31 + F.col("p_size")) % 1997).cast("long").alias("n"), r.alias("r")).filter("abs(r) >= 0.2 AND abs(r) < 1")
    return rows.select("p_partkey", "n", F.round(correlation_log_p(F.col("r"), F.col("n")) / F.log(F.lit(10.0)), 7).alias("log10_p"))


_IMPUTED = f"{_LONG}{_STATS}{_FEW_JOINED}{_CORR}, i AS (SELECT c.*, x.s AS s1, x.ss AS q1, x.mean AS m1, x.res AS r1, x.cnt AS c1, y.s AS s2, y.ss AS q2, y.mean AS m2, y.res AS r2, y.cnt AS c2, x.cnt + y.cnt - c.n AS nn FROM c JOIN st x ON x.agg = agg1 AND x.var = var1 JOIN st y ON y.agg = agg2 AND y.var = var2 WHERE x.res <> 0 AND y.res <> 0)"


@query("impute_avg", f"{_IMPUTED} SELECT agg1, var1, agg2, var2, round((sxy - m2 * sx - m1 * sy + n * m1 * m2) / sqrt(r1 * r2), 6) AS r_impute_avg FROM i")
def impute_avg(spark, d):
    m, pairs = _with_pairs(spark, d)
    return _rounded(correlate.pearson_pairs(m, pairs, measures.column_stats(m)), 6, "r_impute_avg").select("agg1", "var1", "agg2", "var2", "r_impute_avg")


@query("impute_zero", f"""{_IMPUTED}, ze AS (SELECT i.agg1, i.var1, i.agg2, i.var2, a.val, a.x AS x FROM i JOIN m a ON a.agg = agg1 AND a.var = var1), zf AS (SELECT i.agg1, i.var1, i.agg2, i.var2, b.val, b.x AS y FROM i JOIN m b ON b.agg = agg2 AND b.var = var2),
    zo AS (SELECT agg1, var1, agg2, var2, val, coalesce(ze.x, 0) AS x, coalesce(zf.y, 0) AS y FROM ze FULL JOIN zf USING (agg1, var1, agg2, var2, val))
    SELECT agg1, var1, agg2, var2, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) + 1e-7, 4) AS r_impute_zero FROM zo GROUP BY ALL""")
def impute_zero(spark, d):
    """All pairs; SQL joins the tables outright and fills the keys that one of them lacks."""
    m, pairs = _with_pairs(spark, d)
    out = correlate.pearson_pairs(m, pairs, measures.column_stats(m))
    return _rounded(out, 4, "r_impute_zero").select("agg1", "var1", "agg2", "var2", "r_impute_zero")


@query("impute_outer", """WITH a AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS val, avg(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS val, avg(l_quantity) AS y FROM lineitem GROUP BY 1),
    o AS (SELECT x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM a FULL JOIN b ON a.val = b.val)
    SELECT count(*) AS n, round(corr(coalesce(x, 0), coalesce(y, 0)), 6) AS zero_r, round(corr(coalesce(x, mx), coalesce(y, my)), 6) AS mean_r FROM o""")
def impute_outer(spark, d):
    """The explicit outer join, against which the closed forms can be checked."""
    day = lambda c: K.time_key(F.col(c), K.TimeUnit.DAY)
    a = measures.aggregate_by(table(spark, d, "orders"), day("o_orderdate"), [Variable("o_totalprice")])
    b = measures.aggregate_by(table(spark, d, "lineitem"), day("l_shipdate"), [Variable("l_quantity")])
    both = joins.align_outer(a, ["avg_o_totalprice"], b, ["avg_l_quantity"]).select(F.col("avg_o_totalprice_t1").alias("x"), F.col("avg_l_quantity_t2").alias("y"))
    means = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row
    filled = both.crossJoin(F.broadcast(means))
    r = lambda fx, fy: F.round(F.corr(F.coalesce("x", fx), F.coalesce("y", fy)), 6)
    return filled.agg(F.count(F.lit(1)).alias("n"), r(F.lit(0.0), F.lit(0.0)).alias("zero_r"), r(F.col("mx"), F.col("my")).alias("mean_r"))


@query("spearman", f"""{_LONG}{_FEW_JOINED}, f AS (SELECT kind, agg1, var1, agg2, var2, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM j),
    k2 AS (SELECT *, rank() OVER (PARTITION BY kind, agg1, var1, agg2, var2 ORDER BY x) + (count(*) OVER (PARTITION BY kind, agg1, var1, agg2, var2, x) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY kind, agg1, var1, agg2, var2 ORDER BY y) + (count(*) OVER (PARTITION BY kind, agg1, var1, agg2, var2, y) - 1) / 2 AS ry FROM f),
    c AS (SELECT kind, agg1, var1, agg2, var2, count(*) AS n, {_R.format(x='rx', y='ry')} AS r FROM k2 GROUP BY ALL)
    SELECT kind, agg1, var1, agg2, var2, n, round(r, 6) AS r, round({_P2}, 6) AS p FROM c WHERE r <> 0""")
def spearman(spark, d):
    return _rounded(correlate.spearman_pairs(correlate.joined_pairs(*_with_pairs(spark, d))), 6, "r", "p")


_ERFC = "1 - 2 * {x} / sqrt(pi()) * exp(-{x} * {x}) * (SELECT sum(exp(k * ln(2 * {x} * {x}) - (k + 1) * ln(2) - lgamma(k + 1.5) + lgamma(0.5))) FROM range(0, 150) e(k))"


@query("kendall", f"""{_LONG}{_FEW_JOINED}, f AS (SELECT kind, agg1, var1, agg2, var2, val, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM j),
    s AS (SELECT a.kind, a.agg1, a.var1, a.agg2, a.var2, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum((a.x = b.x)::INT) AS tx, sum((a.y = b.y)::INT) AS ty, count(*) AS m
        FROM f a JOIN f b ON a.agg1 = b.agg1 AND a.var1 = b.var1 AND a.agg2 = b.agg2 AND a.var2 = b.var2 AND a.val < b.val GROUP BY ALL),
    u AS (SELECT kind, agg1, var1, agg2, var2, x AS v, 1 AS side, count(*)::DOUBLE AS t FROM f GROUP BY ALL UNION ALL SELECT kind, agg1, var1, agg2, var2, y, 2, count(*) FROM f GROUP BY ALL),
    w AS (SELECT kind, agg1, var1, agg2, var2, sum(t) FILTER (side = 1) AS n, sum(t * (t - 1) * (t - 2)) FILTER (side = 1) AS x0, sum(t * (t - 1) * (t - 2)) FILTER (side = 2) AS y0,
        sum(t * (t - 1) * (2 * t + 5)) FILTER (side = 1) AS x1, sum(t * (t - 1) * (2 * t + 5)) FILTER (side = 2) AS y1 FROM u GROUP BY ALL),
    z AS (SELECT *, abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - x1 - y1) / 18 + 2.0::DOUBLE * tx * ty / (n * (n - 1)) + x0 * y0 / (9 * n * (n - 1) * (n - 2))) / sqrt(2) AS q FROM s JOIN w USING (kind, agg1, var1, agg2, var2) WHERE m > tx AND m > ty AND s <> 0)
    SELECT kind, agg1, var1, agg2, var2, n::BIGINT AS n, round(s / sqrt((m - tx)::DOUBLE * (m - ty)), 6) AS r, round({_ERFC.format(x='q')}, 6) AS p FROM z""")
def kendall(spark, d):
    return _rounded(correlate.kendall_pairs(correlate.joined_pairs(*_with_pairs(spark, d))), 6, "r", "p")


_LINES = "WITH f AS (SELECT strftime(l_shipdate, '%Y-%m') AS val, avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_tax) AS c, avg(l_discount) AS e FROM lineitem GROUP BY 1), m AS (SELECT count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc, corr(a, e) AS ae, corr(b, e) AS be, corr(c, e) AS ce FROM f), p1 AS (SELECT *, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS r1, (ae - ac * ce) / sqrt((1 - ac * ac) * (1 - ce * ce)) AS ae_c, (be - bc * ce) / sqrt((1 - bc * bc) * (1 - ce * ce)) AS be_c FROM m)"


def _line_means(spark, d) -> DataFrame:
    return measures.aggregate_by(table(spark, d, "lineitem"), K.time_key(F.col("l_shipdate"), K.TimeUnit.MONTH), [Variable(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount")])


@query("partial_corr_1", f"{_LINES} SELECT 'avg_l_quantity' AS x, 'avg_l_extendedprice' AS y, n, round(r, 6) AS r, round({_P.format(v='(n - 3)', r='r')}, 6) AS p FROM (SELECT n, r1 AS r FROM p1)")
def partial_corr_1(spark, d):
    return _rounded(correlate.partial_correlations(_line_means(spark, d), [("avg_l_quantity", "avg_l_extendedprice")], ["avg_l_tax"], None), 6, "r", "p")


@query("partial_corr_2", f"{_LINES} SELECT 'avg_l_quantity' AS x, 'avg_l_extendedprice' AS y, n, round(r, 6) AS r, round({_P.format(v='(n - 4)', r='r')}, 6) AS p FROM (SELECT n, (r1 - ae_c * be_c) / sqrt((1 - ae_c * ae_c) * (1 - be_c * be_c)) AS r FROM p1)")
def partial_corr_2(spark, d):
    return _rounded(correlate.partial_correlations(_line_means(spark, d), [("avg_l_quantity", "avg_l_extendedprice")], ["avg_l_tax", "avg_l_discount"], None), 6, "r", "p")


_ELIMINATE = """WITH RECURSIVE f AS ({f}), v AS (SELECT unnest({names}) AS c, generate_subscripts({names}, 1) AS i), w AS (SELECT val, i, x FROM (UNPIVOT f ON COLUMNS(* EXCLUDE val) INTO NAME c VALUE x) JOIN v USING (c)),
    r0 AS (SELECT a.i, b.i AS j, coalesce(corr(a.x, b.x), 0) AS r FROM w a JOIN w b USING (val) GROUP BY ALL){steps}"""


def _eliminated(frame: str, names: list[str], controls: int) -> str:
    """The correlations of a frame's columns (val and names), the last ``controls`` of them held fixed one after the other, as r{controls}."""
    steps = "".join(
        f", r{s + 1} AS (SELECT a.i, a.j, (a.r - b.r * c.r) / sqrt((1 - b.r * b.r) * (1 - c.r * c.r)) AS r FROM r{s} a JOIN r{s} b ON b.i = a.i AND b.j = {len(names) - s} JOIN r{s} c ON c.i = a.j AND c.j = {len(names) - s} WHERE a.i <> {len(names) - s} AND a.j <> {len(names) - s})"
        for s in range(controls)
    )
    return _ELIMINATE.format(f=frame, names=names, steps=steps)


_MEANS = "SELECT strftime(l_shipdate, '%Y-%m') AS val, avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_tax) AS c, avg(l_discount) AS e, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1"


@query("partial_corr_3", f"""{_eliminated(_MEANS, ["a", "b", "c", "e", "n"], 3)}, m AS (SELECT r, (SELECT count(*) FROM f) AS n FROM r3 WHERE i = 1 AND j = 2)
    SELECT 'avg_l_quantity' AS x, 'avg_l_extendedprice' AS y, n, round(r, 6) AS r, round({_P.format(v='(n - 5)', r='r')}, 6) AS p FROM m""")
def partial_corr_3(spark, d):
    return _rounded(correlate.partial_correlations(_line_means(spark, d), [("avg_l_quantity", "avg_l_extendedprice")], ["avg_l_tax", "avg_l_discount", "count"], None), 6, "r", "p")


_BOTH = f"SELECT val, p, q, t, a.n::DOUBLE AS n1, b.n::DOUBLE AS n2 FROM ({_MONTHLY} SELECT * FROM a) a JOIN ({_MONTHLY} SELECT * FROM b) b USING (val)"


@query("control_variables", f"""{_eliminated(_BOTH, ["p", "q", "t", "n1", "n2"], 3)}, m AS (SELECT r, (SELECT count(*) FROM f) AS n FROM r3 WHERE i = 1 AND j = 2)
    SELECT 'orders_month' AS agg1, 'avg_o_totalprice' AS var1, 'lineitem_month' AS agg2, 'avg_l_quantity' AS var2, n, round(r, 6) AS r, round({_P.format(v='(n - 5)', r='r')}, 6) AS p FROM m""")
def control_variables(spark, d):
    """One correlation of two tables with three variables of both held fixed."""
    wanted = spark.createDataFrame([("orders_month", "avg_o_totalprice", "lineitem_month", "avg_l_quantity")], "agg1 string, var1 string, agg2 string, var2 string")
    controls = [("lineitem_month", "avg_l_tax"), ("orders_month", "count"), ("lineitem_month", "count")]
    return _rounded(correlate.partial_pairs(long(spark, d), wanted, controls, None), 6, "r", "p")


@query("control_all", f"""{_LONG}{_PAIRS}{_JOINED}, z AS (SELECT val, x AS z FROM m WHERE agg = 'lineitem_nation' AND var = 'count'),
    g AS (SELECT agg1, var1, agg2, var2, coalesce(x, 0) AS x, coalesce(y, 0) AS y, z FROM j JOIN z USING (val) WHERE kind = 'spatial' AND (agg1, var1) <> ('lineitem_nation', 'count') AND (agg2, var2) <> ('lineitem_nation', 'count')),
    c AS (SELECT agg1, var1, agg2, var2, count(*) AS n, coalesce(corr(x, y), 0) AS xy, coalesce(corr(x, z), 0) AS xz, coalesce(corr(y, z), 0) AS yz FROM g GROUP BY ALL),
    q AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM c)
    SELECT agg1, var1, agg2, var2, n, round(r, 6) AS r, round({_P.format(v='(n - 3)', r='r')}, 6) AS p FROM q WHERE r IS NOT NULL AND NOT isnan(r) AND r <> 0 AND r <> -1""")
def control_all(spark, d):
    """All correlations of places, of every pair of tables in one job, with the number of line items held fixed."""
    m, pairs = _with_pairs(spark, d)
    found = correlate.pair_moments(correlate.joined_pairs(m, pairs.filter("kind = 'spatial'")))
    return _rounded(correlate.partial_pairs(m, found, [("lineitem_nation", "count")], None), 6, "r", "p")


_BH = """, w AS (SELECT *, row_number() OVER (PARTITION BY agg1, var1 ORDER BY p, kind, agg2, var2) AS i, count(*) OVER (PARTITION BY agg1, var1) AS k FROM {c}),
    z AS (SELECT *, max(CASE WHEN p < i / k * {q} THEN i END) OVER (PARTITION BY agg1, var1) AS last FROM w)"""


@query("bh_fdr", f"{_LONG}{_FEW_JOINED}{_CORR}, cp AS (SELECT *, {_P2} AS p FROM c){_BH.format(c='cp', q='0.4')} SELECT kind, agg1, var1, agg2, var2, n, round(r, 6) AS r, round(p, 6) AS p FROM z WHERE i <= last AND abs(r) >= 0.1")
def bh_fdr(spark, d):
    out = correlate.benjamini_hochberg(correlate.pearson_pairs(*_with_pairs(spark, d)), 0.4, 0.1)
    return _rounded(out, 6, "r", "p").drop("tbl1", "tbl2")


@query("regress_ols", f"{_MONTHLY} SELECT round(regr_intercept(p, q), 2) AS intercept, round(regr_slope(p, q), 3) AS slope, round(regr_r2(p, q), 6) AS r2 FROM a JOIN b USING (val)")
def regress_ols(spark, d):
    a, b = _monthly(spark, d)
    frame = joins.align_inner(a, ["avg_o_totalprice"], b, ["avg_l_quantity"])
    fit = correlate.regress(frame, "avg_o_totalprice_t1", ["avg_l_quantity_t2"])
    return spark.range(1).select(F.round(F.lit(fit["intercept"]), 2).alias("intercept"), F.round(F.lit(fit["coefficients"]["avg_l_quantity_t2"]), 3).alias("slope"), F.round(F.lit(fit["r2"]), 6).alias("r2"))


# Searches

_USABLE = "JOIN st u ON u.agg = agg1 AND u.var = var1 AND u.res <> 0 JOIN st v ON v.agg = agg2 AND v.var = var2 AND v.res <> 0"


@query("find_correlations_from", f"""{_ROUNDED}{_STATS}{_PAIRS.replace("kp AS (", "kp0 AS (")}, kp AS (SELECT kind, CASE WHEN agg1 LIKE 'orders%' THEN agg1 ELSE agg2 END AS agg1, CASE WHEN agg1 LIKE 'orders%' THEN agg2 ELSE agg1 END AS agg2 FROM kp0 WHERE agg1 LIKE 'orders%' OR agg2 LIKE 'orders%'){_JOINED}{_CORR},
    f AS (SELECT c.*, {_P2} AS p FROM c {_USABLE} WHERE abs(r) >= 0.02)
    SELECT kind, agg1, tbl1, var1, agg2, tbl2, var2, n, round(r, 5) AS r, round(p, 5) AS p FROM f WHERE p <= 0.5""")
def find_correlations_from(spark, d):
    out = correlations(_stored(long(spark, d, 3)), Options(overlap=5, r_least=0.02, p_most=0.5), "orders")
    return _rounded(out.select("kind", "agg1", "tbl1", "var1", "agg2", "tbl2", "var2", "n", "r", "p"), 5, "r", "p")


@query("find_all_correlations", f"""{_ROUNDED}{_STATS}{_FEW_JOINED}{_CORR}, cp AS (SELECT c.*, {_P2} AS p FROM c {_USABLE}){_BH.format(c='cp', q='0.3')}
    SELECT kind, agg1, tbl1, var1, agg2, tbl2, var2, n, round(r, 5) AS r, round(p, 5) AS p FROM z WHERE i <= last AND abs(r) >= 0.1""")
def find_all_correlations(spark, d):
    out = correlations(_stored(long(spark, d, 3)), Options(overlap=5, r_least=0.1, correction="FDR", q=0.3))
    return _rounded(out.select("kind", "agg1", "tbl1", "var1", "agg2", "tbl2", "var2", "n", "r", "p"), 5, "r", "p")


# A catalog that grows

_GROWN = _RAW.replace("FROM lineitem JOIN supplier ON l_suppkey = s_suppkey", "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 25 AND l_shipdate >= TIMESTAMP '1993-01-01'")


def _grown(spark, d):
    """Four sources come in two calls, one of them again with other rows, and the orders are taken out."""
    tables = {s.tbl: s for s in sources(spark, d)}
    engine = Engine(spark, f"{ranges.shared_root(spark)}/tidemark-catalog-{uuid.uuid4().hex}")
    engine.ingest([tables["lineitem"], tables["orders"], tables["customer"]])
    engine.ingest([tables["supplier"]])
    line = tables["lineitem"]
    engine.ingest([Source(line.tbl, line.df.filter("l_quantity > 25 AND l_shipdate >= timestamp_ntz'1993-01-01'"), line.times, line.places, line.measures)])
    engine.remove(["orders"])
    return engine


@query("catalog_index", f"WITH {_GROWN}, m AS (SELECT * FROM m0 WHERE tbl <> 'orders') SELECT kind, val, string_agg(agg, '|' ORDER BY agg) AS aggs, count(*) AS cnt FROM m WHERE var = 'count' GROUP BY ALL")
def catalog_index(spark, d):
    return _grown(spark, d).catalog.index().withColumn("aggs", F.array_join("aggs", "|"))


@query("catalog_stats", f"WITH {_GROWN}, m AS (SELECT * REPLACE (round_even(x, 3) AS x) FROM m0 WHERE tbl <> 'orders') SELECT tbl, agg, var, count(*) AS cnt, round(avg(x), 3) AS avg, round(coalesce(stddev_samp(x), 0), 3) AS spread FROM m GROUP BY ALL")
def catalog_stats(spark, d):
    rows = _grown(spark, d).catalog.read("stats")
    spread = F.sqrt(F.coalesce("res_sum", F.lit(0.0)) / F.greatest(F.col("cnt") - 1, F.lit(1)))
    return rows.select("tbl", "agg", "var", "cnt", F.round("avg", 3).alias("avg"), F.round(spread, 3).alias("spread"))


# Sketches and topology

_SCRAMBLE = "(((({k}) * 3432918353 % 4294967296 * 32768 % 4294967296 + (({k}) * 3432918353 % 4294967296) // 131072) % 4294967296) * 461845907 % 4294967296)"
_BLOCK = "(list_reduce(list_transform(range(0, {n}), lambda q: ('0x' || substr(hx, ({at} + q) * 2 + 1, 2))::UBIGINT * pow(256, q)::UBIGINT), lambda p, q: p + q))"
#: Murmur3 of the bytes of val, block by block, then its golden place.
_SK = f""", mb AS (SELECT agg, val, hex(encode(val)) AS hx, strlen(val) AS n FROM k),
    mh AS (SELECT agg, val, n, hx, list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, n // 4), lambda i: {_BLOCK.format(n=4, at='4 * i')})),
        lambda h, w: ((xor(h, {_SCRAMBLE.format(k='w')}) * 8192 % 4294967296 + xor(h, {_SCRAMBLE.format(k='w')}) // 524288) % 4294967296 * 5 + 3864292196) % 4294967296) AS h FROM mb),
    mt AS (SELECT agg, val, xor(CASE WHEN n % 4 = 0 THEN h ELSE xor(h, {_SCRAMBLE.format(k=_BLOCK.format(n='n % 4', at='n // 4 * 4'))}) END, n::UBIGINT) AS h FROM mh),
    m1 AS (SELECT agg, val, xor(h, h // 65536) * 2246822507 % 4294967296 AS h FROM mt), m2 AS (SELECT agg, val, xor(h, h // 8192) * 3266489909 % 4294967296 AS h FROM m1), m3 AS (SELECT agg, val, xor(h, h // 65536)::BIGINT AS h FROM m2),
    mu AS (SELECT agg, val, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END + 1)::DOUBLE * 1.6180339887498949025::DOUBLE AS g FROM m3), mg AS (SELECT agg, val, g - floor(g) AS place FROM mu),
    kk AS (SELECT agg, val, place FROM (SELECT agg, val, place, row_number() OVER (PARTITION BY agg ORDER BY place, val) AS r FROM mg) WHERE r <= 32)"""


@query("kmv_sketch", f"{_LONG}{_SK} SELECT agg, val, round(place, 9) AS place FROM kk")
def kmv_sketch(spark, d):
    return _rounded(sketch.key_sketch(measures.keys_of(_stored(long(spark, d))), 32), 9, "place")


@query("kmv_united", f"{_LONG.replace('k AS (SELECT kind, agg, tbl, val', 'k AS (SELECT DISTINCT kind, kind AS agg, kind AS tbl, val')}{_SK} SELECT agg, val, round(place, 9) AS place FROM kk")
def kmv_united(spark, d):
    """One sketch for the keys of each kind, from the stored sketches of the tables; SQL takes it from all keys."""
    keys = measures.keys_of(_stored(long(spark, d)))
    own = ranges.stored(sketch.key_sketch(keys, 32), "sketch").join(F.broadcast(keys.select("agg", "kind").distinct()), "agg")
    return _rounded(sketch.unite(own.select(F.col("kind").alias("agg"), "val", "place"), k=32), 9, "place")


@query("sketch_corr", f"""{_LONG}{_FEW_JOINED}{_SK}, js AS (SELECT j.* FROM j JOIN kk a ON a.agg = agg1 AND a.val = j.val JOIN kk b ON b.agg = agg2 AND b.val = j.val)
    SELECT kind, agg1, var1, agg2, var2, count(*) AS n, round({_R0}, 6) AS r FROM js GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT x) <> 1 AND count(DISTINCT y) <> 1""")
def sketch_corr(spark, d):
    return _rounded(sketch.sketch_correlations(*_with_pairs(spark, d), 32), 6, "r").drop("tbl1", "tbl2", "p")


_FEAT = """, th AS (SELECT agg, var, quantile_cont(x, 0.75) FILTER (x <> 0) AS hi, quantile_cont(x, 0.25) FILTER (x <> 0) AS lo, count(DISTINCT x) FILTER (x <> 0) AS c FROM m GROUP BY ALL),
    ft AS (SELECT m.kind, m.agg, m.var, m.val, CASE WHEN x > hi THEN 1 ELSE -1 END AS sign FROM m JOIN th ON m.agg = th.agg AND m.var = th.var WHERE c > 1 AND (x > hi OR x < lo))"""


@query("rows_per_key", f"{_LONG} SELECT agg, round(avg(x), 6) AS avg_rows, round(median(x), 6) AS median_rows FROM m WHERE var = 'count' GROUP BY agg")
def rows_per_key(spark, d):
    return _rounded(measures.rows_per_key(long(spark, d)), 6, "avg_rows", "median_rows")


@query("value_profile", f"{_LONG} SELECT agg, var, round(avg((x IS NULL)::INT), 2) AS missing_ratio, round(avg(coalesce(x = 0, FALSE)::INT), 2) AS zero_ratio FROM m GROUP BY ALL")
def value_profile(spark, d):
    return measures.value_profile(long(spark, d))


@query("topology_features", f"{_LONG}{_FEAT} SELECT agg, var, val, sign FROM ft")
def topology_features(spark, d):
    return topology.features(_stored(long(spark, d))).drop("kind")


@query("topology_score", f"""{_LONG}{_FEAT}, n1 AS (SELECT agg, var, count(*) AS n FROM ft GROUP BY ALL),
    g AS (SELECT a.agg AS agg1, a.var AS var1, b.agg AS agg2, b.var AS var2, sum(a.sign * b.sign) AS net, count(*) AS c FROM ft a JOIN ft b ON a.kind = b.kind AND a.val = b.val AND a.agg <> b.agg GROUP BY ALL)
    SELECT agg1, var1, agg2, var2, round(net / c, 6) AS score, round(2 * (c / n) / (c / n + 1), 6) AS strength FROM g JOIN n1 ON n1.agg = agg1 AND n1.var = var1""")
def topology_score(spark, d):
    f = topology.features(_stored(long(spark, d)))
    return _rounded(topology.relationships(f, f), 6, "score", "strength")


@query("feature_overlap", f"""{_LONG}{_FEAT}, fn AS (SELECT agg, var, count(*) AS n FROM ft GROUP BY ALL),
    fo AS (SELECT a.agg AS agg1, a.var AS var1, b.agg AS agg2, b.var AS var2, count(*) AS shared FROM ft a JOIN ft b ON a.kind = b.kind AND a.val = b.val AND a.agg <> b.agg GROUP BY ALL)
    SELECT agg1, var1, agg2, var2, shared, x.n + y.n - shared AS either, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM fo JOIN fn x ON x.agg = agg1 AND x.var = var1 JOIN fn y ON y.agg = agg2 AND y.var = var2""")
def feature_overlap(spark, d):
    f = _stored(topology.features(_stored(long(spark, d))))
    return _rounded(topology.feature_overlap(f, f), 6, "jaccard")


_SHIFTS = (7, 19)


def _shifted(k: int) -> str:
    """Features after the values of each variable moved k places along its ordered keys, with their scores."""
    return f""", sh{k} AS (SELECT a.kind, a.agg, a.var, a.val, b.x FROM pos a JOIN pos b ON a.agg = b.agg AND a.var = b.var AND a.i = (b.i - {k} % b.n + b.n) % b.n),
        fs{k} AS (SELECT s.kind, s.agg, s.var, s.val, CASE WHEN x > hi THEN 1 ELSE -1 END AS sign FROM sh{k} s JOIN th ON s.agg = th.agg AND s.var = th.var WHERE c > 1 AND (x > hi OR x < lo)),
        gs{k} AS (SELECT a.agg AS agg1, a.var AS var1, b.agg AS agg2, b.var AS var2, abs(sum(a.sign * b.sign) / count(*)) AS o FROM fs{k} a JOIN ft b ON a.kind = b.kind AND a.val = b.val AND a.agg <> b.agg GROUP BY ALL)"""


@query("topology_significant", f"""{_LONG}{_FEAT}, n1 AS (SELECT agg, var, count(*) AS n FROM ft GROUP BY ALL),
    g AS (SELECT a.agg AS agg1, a.var AS var1, b.agg AS agg2, b.var AS var2, sum(a.sign * b.sign) / count(*) AS score, count(*) AS c FROM ft a JOIN ft b ON a.kind = b.kind AND a.val = b.val AND a.agg <> b.agg GROUP BY ALL),
    pos AS (SELECT kind, agg, var, val, x, row_number() OVER (PARTITION BY agg, var ORDER BY val) - 1 AS i, count(*) OVER (PARTITION BY agg, var) AS n FROM m){"".join(map(_shifted, _SHIFTS))},
    s AS (SELECT agg1, var1, agg2, var2, max(o) AS o FROM ({" UNION ALL ".join(f"SELECT * FROM gs{k}" for k in _SHIFTS)}) GROUP BY ALL)
    SELECT agg1, var1, agg2, var2, round(g.score, 6) AS score, round(2 * (c / n) / (c / n + 1), 6) AS strength FROM g JOIN n1 ON n1.agg = agg1 AND n1.var = var1
    LEFT JOIN s USING (agg1, var1, agg2, var2) WHERE s.o IS NULL OR s.o < abs(g.score)""")
def topology_significant(spark, d):
    return _rounded(topology.significant(_stored(long(spark, d)), list(_SHIFTS)), 6, "score", "strength")


_BFS = f""", pk AS (SELECT DISTINCT kind, agg, val, CASE WHEN kind = 'st' THEN split_part(val, ',', 1) ELSE '' END AS t, CASE WHEN kind = 'st' THEN split_part(val, ',', 2) ELSE val END AS s FROM m),
    tt AS (SELECT agg, t, lead(t) OVER (PARTITION BY agg ORDER BY t) AS u FROM (SELECT DISTINCT agg, t FROM pk WHERE kind = 'st')),
    ed AS (SELECT a.agg, a.val, b.val AS other FROM pk a JOIN pk b ON a.agg = b.agg AND a.t = b.t AND a.s <> b.s AND abs(a.s::INT % 5 - b.s::INT % 5) <= 1 AND abs(a.s::INT // 5 - b.s::INT // 5) <= 1
        UNION ALL SELECT a.agg, unnest([a.val, b.val]), unnest([b.val, a.val]) FROM pk a JOIN tt ON a.agg = tt.agg AND a.t = tt.t JOIN pk b ON b.agg = a.agg AND b.t = tt.u AND b.s = a.s),
    rc AS (SELECT agg, val, val AS far FROM pk UNION SELECT rc.agg, rc.val, ed.other FROM rc JOIN ed ON ed.agg = rc.agg AND ed.val = rc.far),
    nd AS (SELECT turn, agg, val, part, CASE WHEN turn = 0 THEN '0' || val ELSE md5([{_SHIFTS[0]}, {_SHIFTS[1]}][turn] || '|' || val) || val END AS h FROM (SELECT agg, val, min(far) AS part FROM rc GROUP BY ALL), range(0, 3) r(turn)),
    sa AS (SELECT turn, agg, part, min(h) AS start FROM nd GROUP BY ALL),
    lv AS (SELECT turn, agg, val, 0 AS level FROM nd JOIN sa USING (turn, agg, part) WHERE h = start UNION SELECT turn, lv.agg, ed.other, level + 1 FROM lv JOIN ed ON ed.agg = lv.agg AND ed.val = lv.val WHERE level < 24),
    ps AS (SELECT nd.turn, nd.agg, nd.val, row_number() OVER (PARTITION BY nd.turn, nd.agg ORDER BY start, level, h) AS at FROM nd JOIN sa USING (turn, agg, part) JOIN (SELECT turn, agg, val, min(level) AS level FROM lv GROUP BY ALL) USING (turn, agg, val))"""


@query("topology_shuffled", f"""{_LONG.replace("WITH", "WITH RECURSIVE", 1).replace("'%Y-%m'", "'%Y'").replace("SELECT * FROM m0", "SELECT * FROM m0 WHERE kind <> 'temporal'")}{_FEAT}{_BFS}, n1 AS (SELECT agg, var, count(*) AS n FROM ft GROUP BY ALL),
    g AS (SELECT a.agg AS agg1, a.var AS var1, b.agg AS agg2, b.var AS var2, sum(a.sign * b.sign) / count(*) AS score, count(*) AS c FROM ft a JOIN ft b ON a.kind = b.kind AND a.val = b.val AND a.agg <> b.agg GROUP BY ALL),
    mv AS (SELECT q.turn, p.agg, p.val, q.val AS source FROM ps p JOIN ps q ON p.turn = 0 AND q.turn > 0 AND q.agg = p.agg AND q.at = p.at),
    sf AS (SELECT mv.turn, m.kind, m.agg, m.var, mv.val, CASE WHEN x > hi THEN 1 ELSE -1 END AS sign FROM mv JOIN m ON m.agg = mv.agg AND m.val = mv.source JOIN th ON th.agg = m.agg AND th.var = m.var WHERE c > 1 AND (x > hi OR x < lo)),
    bs AS (SELECT agg1, var1, agg2, var2, max(o) AS o FROM (SELECT a.turn, a.agg AS agg1, a.var AS var1, b.agg AS agg2, b.var AS var2, abs(sum(a.sign * b.sign) / count(*)) AS o FROM sf a JOIN ft b ON a.kind = b.kind AND a.val = b.val AND a.agg <> b.agg GROUP BY ALL) GROUP BY ALL)
    SELECT agg1, var1, agg2, var2, round(g.score, 6) AS score, round(2 * (c / n) / (c / n + 1), 6) AS strength FROM g JOIN n1 ON n1.agg = agg1 AND n1.var = var1
    LEFT JOIN bs USING (agg1, var1, agg2, var2) WHERE bs.o IS NULL OR bs.o < abs(g.score)""")
def topology_shuffled(spark, d):
    """Places, and places by year, whose peaks agree more than after any shuffle that keeps neighbours near; nations lie on a grid of five by five."""
    year = lambda c: {"month": K.time_key(F.col(c), K.TimeUnit.YEAR)}
    by_year = [Source(s.tbl, s.df, year({"orders": "o_orderdate", "lineitem": "l_shipdate"}[s.tbl]) if s.times else {}, s.places, s.measures) for s in sources(spark, d)]
    m = _stored(measures.measures(by_year, round_dp=None).filter("kind <> 'temporal'"))
    near = spatial.adjacency(_grid(spark, d)).select(F.substring("region", 4, 9).alias("region"), F.substring("neighbour", 4, 9).alias("neighbour"))
    return _rounded(topology.significant(m, list(_SHIFTS), near), 6, "score", "strength")


# Graphs

def _corrs(spark, d) -> DataFrame:
    return correlate.pearson_pairs(*_with_pairs(spark, d)).filter("abs(r) >= 0.05")


_C = f"{_LONG}{_FEW_JOINED}{_CORR}, g AS (SELECT * FROM c WHERE abs(r) >= 0.05), e AS (SELECT least(tbl1 || '--' || var1, tbl2 || '--' || var2) AS src, greatest(tbl1 || '--' || var1, tbl2 || '--' || var2) AS dst, max(abs(r)) AS weight FROM g GROUP BY 1, 2)"


@query("corr_graph_edges", f"{_C} SELECT src, dst, round(weight, 6) AS weight FROM e")
def corr_graph_edges(spark, d):
    return _rounded(graph.variable_edges(_corrs(spark, d)), 6, "weight")


@query("table_graph_weights", f"{_C} SELECT least(tbl1, tbl2) AS src, greatest(tbl1, tbl2) AS dst, count(*) AS weight FROM g GROUP BY 1, 2")
def table_graph_weights(spark, d):
    return graph.table_edges(_corrs(spark, d))


@query("degree_ranking", f"{_C} SELECT tbl, var, count(*) AS degree FROM (SELECT tbl1 AS tbl, var1 AS var FROM g UNION ALL SELECT tbl2, var2 FROM g) GROUP BY ALL")
def degree_ranking(spark, d):
    from tidemark.plans.engine import degree_ranking as ranking

    return ranking(_corrs(spark, d))


_Q = "SELECT p_partkey, p_size / 50 AS missing_ratio1, p_partkey % 10 / 10 AS missing_ratio2, p_partkey % 7 / 7 AS zero_ratio1, p_size % 9 / 9 AS zero_ratio2, p_partkey % 3 / 3 AS missing_ratio_o1, p_size % 4 / 4 AS missing_ratio_o2, p_partkey % 11 / 11 AS zero_ratio_o1, p_size % 5 / 5 AS zero_ratio_o2, (p_partkey % 21 - 10) / 10 AS r_val, p_size AS samples, 't' || p_partkey % 13 AS tbl1, 'u' || p_size % 6 AS tbl2 FROM part"


def _quality(spark, d) -> DataFrame:
    """Correlations with quality signals, made from parts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", (s / 50).alias("missing_ratio1"), (k % 10 / 10).alias("missing_ratio2"), (k % 7 / 7).alias("zero_ratio1"), (s % 9 / 9).alias("zero_ratio2"), (k % 3 / 3).alias("missing_ratio_o1"), (s % 4 / 4).alias("missing_ratio_o2"),
        (k % 11 / 11).alias("zero_ratio_o1"), (s % 5 / 5).alias("zero_ratio_o2"), ((k % 21 - 10) / 10).alias("r_val"), s.alias("samples"), F.concat(F.lit("t"), (k % 13).cast("string")).alias("tbl1"), F.concat(F.lit("u"), (s % 6).cast("string")).alias("tbl2"),
    )


_PASS = "missing_ratio1 <= {0} AND missing_ratio2 <= {0} AND zero_ratio1 <= {1} AND zero_ratio2 <= {1} AND missing_ratio_o1 <= {2} AND missing_ratio_o2 <= {2} AND zero_ratio_o1 <= {3} AND zero_ratio_o2 <= {3} AND abs(r_val) >= {4} AND samples >= {5}"


@query("signal_filter", f"SELECT p_partkey FROM ({_Q}) WHERE {_PASS.format('0.75', '0.8', '0.9', '0.9', '0.35', '5')}")
def signal_filter(spark, d):
    return graph.filter_signals(_quality(spark, d), [0.75, 0.8, 0.9, 0.9, 0.35, 5]).select("p_partkey")


@query("coverage_ratio", f"SELECT count(DISTINCT t) AS n_tables FROM (SELECT tbl1 AS t FROM ({_Q}) WHERE abs(r_val) >= 0.85 UNION ALL SELECT tbl2 FROM ({_Q}) WHERE abs(r_val) >= 0.85)")
def coverage_ratio(spark, d):
    return graph.covered_tables(_quality(spark, d).filter(graph.signal_condition("r_val", 0.85)))


#: Thresholds of all six signals, the loosest first.
_AXES = {"missing_ratio": [1.0, 0.9, 0.7], "zero_ratio": [1.0, 0.8, 0.6], "missing_ratio_o": [1.0, 0.9, 0.5], "zero_ratio_o": [1.0, 0.95, 0.7], "r_val": [0.0, 0.25, 0.5, 0.75], "samples": [0.0, 10.0, 20.0, 30.0, 40.0]}
_GRID = "SELECT * FROM " + ", ".join(f"(SELECT unnest({list(v)}::DOUBLE[]) AS t_{k})" for k, v in _AXES.items())
_T = ", ".join(f"t_{k}" for k in _AXES)


@query("threshold_grid", f"""WITH q AS ({_Q}), g AS ({_GRID}), k AS (SELECT * FROM q JOIN g ON {_PASS.format(*(f"t_{k}" for k in _AXES))}),
    t AS (SELECT {_T}, count(DISTINCT t) AS n FROM (SELECT {_T}, tbl1 AS t FROM k UNION ALL SELECT {_T}, tbl2 FROM k) GROUP BY ALL),
    z AS (SELECT {_T}, count(*) AS n_edges FROM k GROUP BY ALL) SELECT {_T}, round(n / 19, 2) AS coverage, n_edges FROM t JOIN z USING ({_T}) WHERE round(n / 19, 2) >= 0.5""")
def threshold_grid(spark, d):
    """Every combination of the thresholds of all six signals that keeps half of the tables."""
    return graph.threshold_grid(_quality(spark, d), _AXES, 19, 0.5)


_E = "SELECT DISTINCT 'n' || least(s_nationkey, s_suppkey % 23) AS src, 'n' || greatest(s_nationkey, s_suppkey % 23) AS dst FROM supplier WHERE s_nationkey <> s_suppkey % 23"


def _plain_graph(spark, d) -> DataFrame:
    a, b = F.col("s_nationkey").cast("bigint"), F.col("s_suppkey") % 23
    return table(spark, d, "supplier").filter(a != b).select(F.concat(F.lit("n"), F.least(a, b).cast("string")).alias("src"), F.concat(F.lit("n"), F.greatest(a, b).cast("string")).alias("dst")).distinct()


@query("modularity", f"""WITH e AS ({_E}), p AS (SELECT *, substr(src, 2)::INT % 4 AS c1, substr(dst, 2)::INT % 4 AS c2 FROM e), m AS (SELECT count(*) AS m FROM p),
    d AS (SELECT c, count(*) AS d FROM (SELECT c1 AS c FROM p UNION ALL SELECT c2 FROM p) GROUP BY c), l AS (SELECT c1 AS c, count(*) AS l FROM p WHERE c1 = c2 GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM d LEFT JOIN l USING (c), m""")
def modularity(spark, d):
    edges = _plain_graph(spark, d)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return _rounded(graph.modularity(edges, nodes.withColumn("community", F.substring("node", 2, 9).cast("int") % 4)), 6, "modularity")


@query("avg_clustering", f"""WITH e AS ({_E}), b AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT u, count(*) AS k FROM b GROUP BY u),
    t AS (SELECT x.u, count(*) / 2 AS t FROM b x JOIN b y ON x.u = y.u JOIN b z ON z.u = x.v AND z.v = y.v GROUP BY x.u)
    SELECT round(avg(CASE WHEN k < 2 THEN 0 ELSE coalesce(t, 0) / (k * (k - 1) / 2) END), 6) AS avg_clustering FROM d LEFT JOIN t USING (u)""")
def avg_clustering(spark, d):
    return _rounded(graph.average_clustering(_plain_graph(spark, d)), 6, "avg_clustering")


@query("skyline", "WITH p AS (SELECT p_size AS coverage, max(p_retailprice) AS score FROM part GROUP BY 1) SELECT coverage, score FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.coverage > a.coverage AND b.score >= a.score)")
def skyline(spark, d):
    points = table(spark, d, "part").select(F.col("p_size").alias("coverage"), F.col("p_retailprice").alias("score"))
    return graph.skyline(points)


@query("louvain")
def louvain(spark, d):
    """node, community of the correlation graph."""
    return graph.part_graph(graph.variable_edges(_corrs(spark, d)))


@query("louvain_blocks", "SELECT 'n' || p_partkey AS node, 'n' || min(p_partkey) OVER (PARTITION BY p_partkey // 6) AS community FROM part WHERE p_partkey < 6 * (SELECT (max(p_partkey) + 1) // 6 FROM part) AND p_partkey >= 6")
def louvain_blocks(spark, d):
    """Parts in cliques of six, each joined with the next by one light edge: the communities are the cliques."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    most = F.floor((parts.agg(F.max("k")).first()[0] + 1) / F.lit(6)) * 6
    k = parts.filter((F.col("k") >= 6) & (F.col("k") < most))
    block = k.withColumn("b", F.floor(F.col("k") / 6))
    inside = block.join(block.withColumnRenamed("k", "j"), "b").filter("k < j").select("k", "j", F.lit(1.0).alias("weight"))
    across = k.filter("k % 6 = 5").select("k", (F.col("k") + 1).alias("j"), F.lit(0.0001).alias("weight")).filter(F.col("j") < most)
    name = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 9, "0"))
    found = graph.part_graph(inside.unionByName(across).select(name("k").alias("src"), name("j").alias("dst"), "weight"))
    bare = lambda c: F.regexp_replace(c, "^n0*", "n").alias(c)
    return found.select(bare("node"), bare("community"))


@query("factor_loadings")
def factor_loadings(spark, d):
    """node, factor, loading of three factors of the correlation matrix."""
    names, matrix = factors.correlation_matrix(_corrs(spark, d))
    loaded = factors.loadings(matrix, 3)
    rows = [F.struct(F.lit(n).alias("node"), F.lit(f).alias("factor"), F.lit(float(loaded[i, f])).alias("loading")) for i, n in enumerate(names) for f in range(3)]
    return spark.range(1).select(F.inline(F.array(*rows)))


# Time bins, places, evaluation


@query("events_tumbling", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS bin_start, count(*) AS n, round(sum(value) + 1e-7, 4) AS total FROM events GROUP BY 1")
def events_tumbling(spark, d):
    out = bins.tumbling(table(spark, d, "events"), "6 hours")
    return _rounded(out.withColumn("bin_start", F.date_format("bin_start", "yyyy-MM-dd HH:mm")), 4, "total")


@query("events_sliding", "SELECT strftime(b, '%Y-%m-%d %H:%M') AS bin_start, count(*) AS n, round(sum(value) + 1e-7, 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS b FROM events) GROUP BY 1")
def events_sliding(spark, d):
    out = bins.sliding(table(spark, d, "events"), "12 hours", "6 hours")
    return _rounded(out.withColumn("bin_start", F.date_format("bin_start", "yyyy-MM-dd HH:mm")), 4, "total")


@query("point_in_polygon", """WITH p AS (SELECT c_custkey AS point_id, (c_custkey % 97) / 10.0 + 0.03 AS lon, (c_custkey % 89) / 10.0 + 0.07 AS lat FROM customer),
    r AS (SELECT 'box' || n_nationkey AS region, n_nationkey % 5 * 2 AS x, n_nationkey // 5 * 2 AS y FROM nation)
    SELECT point_id, region FROM p JOIN r ON lon > x AND lon < x + 1 AND lat > y AND lat < y + 1""")
def point_in_polygon(spark, d):
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("point_id"), ((k % 97) / 10.0 + 0.03).alias("lon"), ((k % 89) / 10.0 + 0.07).alias("lat"))
    x, y = (F.col("n_nationkey") % 5 * 2).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 2).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    regions = table(spark, d, "nation").select(F.concat(F.lit("box"), F.col("n_nationkey").cast("string")).alias("region"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    return spatial.locate(points, regions, 0.5).select("point_id", "region")


@query("region_adjacency", """WITH r AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)
    SELECT 'box' || a.k AS region, 'box' || b.k AS neighbour FROM r a JOIN r b ON a.k <> b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1""")
def region_adjacency(spark, d):
    return spatial.adjacency(_grid(spark, d))


@query("region_touching", """WITH r AS (SELECT n_nationkey AS k, n_nationkey % 5 * 2 + n_nationkey // 5 % 2 * 1.0 AS x, n_nationkey // 5 AS y, CASE WHEN n_nationkey % 7 = 3 THEN 2.5 ELSE 2.0 END AS w FROM nation)
    SELECT 'box' || a.k AS region, 'box' || b.k AS neighbour FROM r a JOIN r b ON a.k <> b.k AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + 1 AND b.y <= a.y + 1
    WHERE NOT (a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + 1 AND b.y < a.y + 1)""")
def region_touching(spark, d):
    """Nations as bricks: each row is moved by half a brick, so sides meet without common corners, and some bricks overlap the next."""
    k = F.col("n_nationkey")
    x, y, w = k % 5 * 2 + F.floor(k / 5) % 2 * 1.0, F.floor(k / 5).cast("double"), F.when(k % 7 == 3, 2.5).otherwise(2.0)
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    zero = F.lit(0.0)
    bricks = table(spark, d, "nation").select(F.concat(F.lit("box"), k.cast("string")).alias("region"), F.array(corner(zero, zero), corner(w, zero), corner(w, F.lit(1.0)), corner(zero, F.lit(1.0))).alias("ring"))
    return spatial.adjacency(bricks, 2.0)


def _grid(spark, d) -> DataFrame:
    """Nations as unit boxes, five in a row."""
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("lon"), (y + b).alias("lat"))
    return table(spark, d, "nation").select(F.concat(F.lit("box"), F.col("n_nationkey").cast("string")).alias("region"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


@query("discovery_precision_recall", f"""{_LONG}, f AS (SELECT agg, cand FROM ({_CAND.replace('>= 5', '>= 60')})), t AS (SELECT agg, cand FROM ({_CAND})),
    b AS (SELECT count(*) FILTER (f.agg IS NOT NULL AND t.agg IS NOT NULL) AS tp, count(*) FILTER (t.agg IS NULL) AS fp, count(*) FILTER (f.agg IS NULL) AS fn FROM f FULL JOIN t ON f.agg = t.agg AND f.cand = t.cand)
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM b""")
def discovery_precision_recall(spark, d):
    k = measures.keys_of(_stored(long(spark, d)))
    out = evaluate.precision_recall(index.candidates(k, 60), index.candidates(k, 5), ["agg", "cand"])
    return _rounded(out, 6, "precision", "recall").drop("f_score")


@query("partition_scores", """WITH p AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b FROM customer), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
    i AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT a, sum(n) AS n FROM c GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT b, sum(n) AS n FROM c GROUP BY b)),
    t AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c)
    SELECT round((ij - i.v * j.v / (n * (n - 1) / 2)) / ((i.v + j.v) / 2 - i.v * j.v / (n * (n - 1) / 2)), 6) AS ari, round(ij / sqrt(i.v * j.v), 6) AS fowlkes_mallows FROM t, i, j""")
def partition_scores(spark, d):
    parts = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"))
    return _rounded(evaluate.partition_scores(parts).select("ari", "fowlkes_mallows"), 6, "ari", "fowlkes_mallows")


@query("events_rollup_stream", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bin_start, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL")
def events_rollup_stream(spark, d):
    """The stream's rows as they stand once all input has been read."""
    from tidemark.streaming import rollup

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    root = f"{ranges.shared_root(spark)}/tidemark-rollup-{uuid.uuid4().hex}"
    rollup.start(rollup.rollup(stream), f"{root}/bins", f"{root}/checkpoint").awaitTermination()
    return _rounded(rollup.current(spark, f"{root}/bins").withColumn("bin_start", F.date_format("bin_start", "yyyy-MM-dd HH:mm")), 6, "avg_value")
