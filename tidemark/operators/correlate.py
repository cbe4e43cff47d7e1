"""Correlations of every pair of variables of joinable tables, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import correlation_p, held_fixed, imputed_mean, imputed_zero, packed_correlations, two_sided_normal
from tidemark.operators.ranges import average_ranks, dense_places, running_totals, stored

PAIR = ["kind", "agg1", "var1", "agg2", "var2"]


def joined_pairs(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, agg1, tbl1, var1, agg2, tbl2, var2, val, x, y for the shared keys of each pair (kind, agg1, agg2).

    The list of pairs is small; it prunes the left side before keys meet.
    """
    one = long.select("kind", F.col("agg").alias("agg1"), F.col("tbl").alias("tbl1"), F.col("var").alias("var1"), "val", "x")
    two = long.select("kind", F.col("agg").alias("agg2"), F.col("tbl").alias("tbl2"), F.col("var").alias("var2"), "val", F.col("x").alias("y"))
    return one.join(pairs.select("kind", "agg1", "agg2"), ["kind", "agg1"]).join(two, ["kind", "agg2", "val"])


def pair_moments(joined: DataFrame) -> DataFrame:
    """Counts, centred moments and sums of each pair of variables; nulls count as 0 on a shared key.

    The centred moments come from Spark's one-pass updates, which do not cancel for large means.
    """
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return joined.groupBy(*PAIR, "tbl1", "tbl2").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("cov"), F.stddev_pop(x).alias("sd1"), F.stddev_pop(y).alias("sd2"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
        (F.count("x") > 0).alias("known1"), (F.count("y") > 0).alias("known2"), (F.min("x") < F.max("x")).alias("varies1"), (F.min("y") < F.max("y")).alias("varies2"),
    )


def _not_constant(known: str, varies: str) -> Column:
    """A column with exactly one distinct value on the shared keys is left out; one without any value stays, as zeros."""
    return ~F.col(known) | F.col(varies)


def pearson_pairs(long: DataFrame, pairs: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """PAIR, tbl1, tbl2, n, r, p for the variables of each pair; constants of the joined keys, and of the whole table if ``stats`` is given, left out.

    With ``stats`` (column_stats) r_impute_avg and r_impute_zero are added: the coefficients after the keys that only
    one table has are filled with means or zeros, without an outer join.
    """
    moments = pair_moments(joined_pairs(long, pairs)).filter(_not_constant("known1", "varies1") & _not_constant("known2", "varies2"))
    r = F.coalesce(F.col("cov") / F.nullif(F.col("sd1") * F.col("sd2"), F.lit(0.0)), F.lit(0.0))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    out = moments.withColumn("r", r).withColumn("p", correlation_p(F.col("r"), F.col("n")))
    if stats is None:
        return out.select(*PAIR, "tbl1", "tbl2", "n", "r", "p")
    usable = stats.filter(F.col("avg").isNotNull() & (F.col("res_sum") != 0))
    for i in "12":
        own = usable.select(F.col("agg").alias(f"agg{i}"), F.col("var").alias(f"var{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("sum", "sum_square", "avg", "res_sum", "cnt")))
        out = out.join(own, [f"agg{i}", f"var{i}"])
    n_outer = F.col("cnt1") + F.col("cnt2") - F.col("n")
    avg = imputed_mean(*(F.col(c) for c in ("sxy", "sx", "sy", "n", "avg1", "avg2", "res_sum1", "res_sum2")))
    zero = imputed_zero(*(F.col(c) for c in ("sxy", "sum1", "sum2", "sum_square1", "sum_square2")), n_outer)
    return out.select(*PAIR, "tbl1", "tbl2", "n", "r", "p", avg.alias("r_impute_avg"), zero.alias("r_impute_zero"))


def masked_pairs(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """PAIR, n, r, p over the keys at which both variables are known."""
    both = joined_pairs(long, pairs).filter("x IS NOT NULL AND y IS NOT NULL")
    r = F.coalesce(F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0)), F.lit(0.0))
    return both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), r.alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n")))


def spearman_pairs(joined: DataFrame) -> DataFrame:
    """PAIR, n, r, p of average ranks; nulls as 0; pairs with r = 0 left out, as in every coefficient taken pair by pair.

    Ranks come from ranges of values, so the keys of one pair spread over all tasks.
    """
    rows = joined.select(*PAIR, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    for c in "xy":
        rows = average_ranks(rows, PAIR, c, f"r{c}")
    r = F.coalesce(F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), r.alias("r")).withColumn("p", correlation_p(F.col("r"), F.col("n"))).filter("r <> 0")


def kendall_pairs(joined: DataFrame) -> DataFrame:
    """PAIR, n, r (tau-b), p (normal approximation with ties); nulls as 0; pairs with r = 0 left out.

    Two samples differ in x first at one bit of its place among the distinct values. For each bit, samples that agree
    above it are one group in the order of y: those with the bit set count the ones without it before and after them.
    Samples of one group and one y are summed up, and the counts before them come from ranges, so n log n rows are
    dealt out and neither a pair nor a group is held by one task.
    """
    rows = joined.select(*PAIR, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    rows = stored(dense_places(dense_places(rows, PAIR, "x", "i"), PAIR, "y", "j").select(*PAIR, "i", "j"), "places")
    levels = rows.groupBy(*PAIR).agg(F.greatest(F.lit(1), F.ceil(F.log2(F.max("i") + 1)).cast("int")).alias("levels"))  # a row a pair
    deep = rows.join(levels, PAIR).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)))
    bit = F.expr("shiftright(i, b) & 1")
    group = [*PAIR, "b", "head"]
    cells = deep.select(*PAIR, "b", F.expr("shiftright(i, b + 1)").alias("head"), "j", bit.alias("bit")).groupBy(*group, "j").agg(F.sum("bit").alias("ones"), F.sum(1 - F.col("bit")).alias("zeros"))
    counted = running_totals(cells, group, ["j"], "zeros", "before")
    sums = counted.groupBy(*group).agg(F.sum(F.col("ones") * (2 * F.col("before") + F.col("zeros"))).alias("met"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    balance = sums.groupBy(*PAIR).agg(F.sum(F.col("met") - F.col("ones") * F.col("zeros")).alias("s"))

    def ties(c: str) -> DataFrame:
        t = rows.groupBy(*PAIR, c).agg(F.count(F.lit(1)).cast("double").alias("t"))
        k = F.col("t")
        return t.groupBy(*PAIR).agg(F.sum(k).alias("n"), F.sum(k * (k - 1) / 2).alias(f"tie_{c}"), F.sum(k * (k - 1) * (k - 2)).alias(f"three_{c}"), F.sum(k * (k - 1) * (2 * k + 5)).alias(f"spread_{c}"))

    all_ = balance.join(ties("i"), PAIR).join(ties("j").drop("n"), PAIR)
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    tau = F.col("s") / F.nullif(F.sqrt((pairs - F.col("tie_i")) * (pairs - F.col("tie_j"))), F.lit(0.0))
    three = F.when(n > 2, F.col("three_i") * F.col("three_j") / (9 * n * F.nullif((n - 1) * (n - 2), F.lit(0.0)))).otherwise(0.0)
    spread = (n * (n - 1) * (2 * n + 5) - F.col("spread_i") - F.col("spread_j")) / 18 + 2 * F.col("tie_i") * F.col("tie_j") / F.nullif(n * (n - 1), F.lit(0.0)) + three
    return all_.select(*PAIR, n.cast("long").alias("n"), F.coalesce(tau, F.lit(0.0)).alias("r"), two_sided_normal(F.col("s") / F.nullif(F.sqrt(spread), F.lit(0.0))).alias("p")).filter("r <> 0")


#: Coefficients by name; each takes joined rows.
COEFFICIENTS = {"spearman": spearman_pairs, "kendall": kendall_pairs}


def partial_correlations(frame: DataFrame, wanted: list[tuple[str, str]], controls: list[str], round_dp: int | None = 3) -> DataFrame:
    """x, y, n, r, p of a joined frame (nulls as 0) with the controls held fixed; pairs with a control, or whose r is null, 0 or -1, are left out.

    One pass takes all correlations, and the controls are eliminated from their matrix once for all pairs.
    """
    wanted = [(x, y) for x, y in wanted if x not in controls and y not in controls]
    columns = list(dict.fromkeys([c for w in wanted for c in w] + controls))
    k, at = len(columns), {c: i for i, c in enumerate(columns)}
    known = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    row = frame.agg(F.count(F.lit(1)).alias("n"), packed_correlations(known).alias("m"))
    row = row.select("n", held_fixed(F.col("m"), k, range(k - len(controls), k)).alias("m"))
    out = row.select("n", F.inline(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.get("m", F.lit(at[x] * k + at[y])).alias("r")) for x, y in wanted))))
    return _told(out, ["x", "y"], len(controls), round_dp)


def _told(out: DataFrame, names: list[str], controls: int, round_dp: int | None) -> DataFrame:
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    out = out.withColumn("p", correlation_p(r, F.col("n"), controls)).withColumn("r", F.bround(r, round_dp) if round_dp is not None else r)
    return out.select(*names, "n", "r", "p").filter("r IS NOT NULL AND NOT isnan(r) AND r <> 0 AND r <> -1")


def partial_pairs(long: DataFrame, corrs: DataFrame, controls: list[tuple[str, str]], round_dp: int | None = 3) -> DataFrame:
    """agg1, var1, agg2, var2, n, r, p of given correlations (agg1, var1, agg2, var2) with control variables (agg, var) held fixed, all in one job.

    Samples are the keys of both tables and of every control's table; nulls count as 0. The controls are brought side
    by side once; pairs whose own variable is a control are left out, as are r that are null, 0 or -1.
    """
    names = ["agg1", "var1", "agg2", "var2"]
    is_control = lambda i: F.coalesce(F.array_contains(F.array(*(F.struct(F.lit(a).alias(f"agg{i}"), F.lit(v).alias(f"var{i}")) for a, v in controls)), F.struct(f"agg{i}", f"var{i}")), F.lit(False))
    wanted = corrs.select(*names).distinct()
    if controls:
        wanted = wanted.filter(~is_control(1) & ~is_control(2))
    x = F.coalesce("x", F.lit(0.0))
    one = long.select(F.col("agg").alias("agg1"), F.col("var").alias("var1"), "val", x.alias("x"))
    two = long.select(F.col("agg").alias("agg2"), F.col("var").alias("var2"), "val", x.alias("y"))
    rows = wanted.join(one, ["agg1", "var1"]).join(two, ["agg2", "var2", "val"])
    if controls:
        tables = sorted({a for a, _ in controls})
        own = long.filter(F.col("agg").isin(tables))
        beside = own.groupBy("val").agg(F.count_distinct("agg").alias("_tables"), *(F.coalesce(F.max(F.when((F.col("agg") == a) & (F.col("var") == v), x)), F.lit(0.0)).alias(f"c{i}") for i, (a, v) in enumerate(controls)))
        rows = rows.join(beside.filter(F.col("_tables") == len(tables)), "val")
    k = 2 + len(controls)
    met = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), packed_correlations([F.col(c) for c in ("x", "y", *(f"c{i}" for i in range(k - 2)))]).alias("m"))
    fixed = met.select(*names, "n", held_fixed(F.col("m"), k, range(2, k)).alias("m"))
    return _told(fixed.select(*names, "n", F.get("m", F.lit(1)).alias("r")), names, len(controls), round_dp)


def benjamini_hochberg(corrs: DataFrame, q: float = 0.05, r_least: float = 0.0, group: tuple[str, ...] = ("agg1", "var1")) -> DataFrame:
    """Rows that the false-discovery-rate procedure keeps in each group, then those with |r| of at least ``r_least``.

    In the order of p, rows up to the last i with p < i / n * q stay; the comparison is strict.
    """
    own = Window.partitionBy(*group)
    rest = [c for c in PAIR if c in corrs.columns and c not in group]
    i = F.row_number().over(own.orderBy("p", *rest))
    ranked = corrs.withColumn("_i", i).withColumn("_n", F.count(F.lit(1)).over(own))
    last = F.max(F.when(F.col("p") < F.col("_i") / F.col("_n") * q, F.col("_i"))).over(own)
    return ranked.withColumn("_last", last).filter((F.col("_i") <= F.col("_last")) & (F.abs("r") >= r_least)).drop("_i", "_n", "_last")


def regress(frame: DataFrame, target: str, inputs: list[str], estimator=None):
    """Ordinary least squares of a joined frame: intercept, coefficients and R squared.

    ``estimator`` is any object of Spark's ML library with ``fit`` over a features column; by default the normal
    equations are solved from one pass of sums.
    """
    if estimator is not None:
        from pyspark.ml.feature import VectorAssembler

        data = VectorAssembler(inputCols=inputs, outputCol="features").transform(frame.dropna(subset=[target, *inputs]))
        return estimator.fit(data)
    import numpy as np

    names = [*inputs, target]
    rows = frame.dropna(subset=names)
    means = rows.agg(*(F.avg(n).alias(n) for n in names), F.count(F.lit(1)).alias("n")).first()
    cov = rows.agg(*(F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    k = len(names)
    c = np.array([[cov[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    beta = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
    fit = float(beta @ c[:-1, -1] / c[-1, -1]) if c[-1, -1] else 0.0
    return {"intercept": float(means[target] - sum(b * means[n] for b, n in zip(beta, inputs))), "coefficients": dict(zip(inputs, map(float, beta))), "r2": fit, "n": means["n"]}
