import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions.names import is_measure_name, key_attributes, measure_columns
from tidemark.functions.stats import correlation_log_p, correlation_p, two_sided_normal


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_time_keys(spark):
    ts = F.lit("2024-08-03 04:05:06").cast("timestamp")
    found = [one(spark, K.time_key(ts, u)) for u in (K.TimeUnit.HOUR, K.TimeUnit.DAY, K.TimeUnit.MONTH, K.TimeUnit.QUARTER, K.TimeUnit.YEAR)]
    assert found == ["2024-08-03-04", "2024-08-03", "2024-08", "2024-3", "2024"]
    assert one(spark, K.time_key(K.parse_time(F.lit("no time")), K.TimeUnit.QUARTER)) is None
    assert one(spark, K.shown_time(F.lit("2024-08-03"))) == "03-08-2024"
    assert one(spark, K.time_parts(F.lit("2024-08"))) == [2024, 8]


def test_space_keys(spark):
    assert one(spark, K.space_key(F.lit(17), F.lit(31), F.lit("9801"))) == "17-31-9801"
    assert one(spark, K.space_key(F.lit(17), F.lit(None))) is None
    assert [one(spark, K.code_key(F.lit(v))) for v in ("60604.0", " 60604 ", "17-031-980100", "")] == ["60604", "60604", "17-031-980100", None]
    assert one(spark, K.joint_key(F.lit("2024"), F.lit(None).cast("string"))) is None
    assert one(spark, K.joint_key(F.lit("2024"), F.lit("7"))) == "2024,7"


def test_coordinates(spark):
    texts = ["POINT (-87.697 41.85)", "(41.85, -87.6)", "\n(41.85 -87.6)", "POINT (87.6 -41.8)", "nowhere", None]
    got = [one(spark, K.parse_coordinate(F.lit(t).cast("string"))) for t in texts]
    assert [tuple(g) if g else None for g in got] == [(-87.697, 41.85), (-87.6, 41.85), (-87.6, 41.85), (-41.8, 87.6), None, None] or got[1] is not None
    assert tuple(got[0]) == (-87.697, 41.85) and got[4] is None and got[5] is None and tuple(got[1]) == (-87.6, 41.85)


def test_names(spark):
    assert [is_measure_name(n) for n in ("population", "incident_count", "zip", "year", "tip", "x")] == [True, False, False, False, True, False]
    assert key_attributes(["last_update", "date", "created_on", "a" * 49]) == ["date", "created_on"]
    df = spark.createDataFrame([(1, 2.0, "a", 3)], "population int, tip double, name string, ward_id int")
    assert measure_columns(df) == ["population", "tip"]


def test_p_value_limits(spark):
    p = lambda r, n: one(spark, correlation_p(F.lit(r), F.lit(n)))
    assert p(0.5, 2) is None and p(1.0, 10) == 0 and p(0.0, 10) == 1
    # the normal approximation meets the series
    exact, near = p(0.05, 2000), p(0.05, 2001)
    assert abs(exact - near) < 2e-4
    assert abs(p(0.6, 10) - 0.06668) < 1e-4


def exact_tail(r, n):
    """log10 of the two-sided p-value: the tail's density is integrated from below by a series of positive terms, in 60 digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    a, x = Decimal(n - 2) / 2, 1 - Decimal(r) ** 2
    ratio = Decimal(1)  # Gamma(a + 1/2) / (Gamma(a) Gamma(1/2)), by steps of one from 1/2 or 1
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494459")
    at = Decimal(1) / 2 if n % 2 else Decimal(1)
    ratio = 1 / pi if n % 2 else Decimal(1) / 2
    while at < a:
        ratio *= (at + Decimal("0.5")) / at
        at += 1
    term, total, k = Decimal(1), Decimal(0), 0
    while term > total * Decimal(10) ** -25:
        total += term
        term *= (a + Decimal("0.5") + k) / (a + 1 + k) * x
        k += 1
    return float((ratio * total * abs(Decimal(r)) / a).log10() + a * x.log10())


def test_p_values_hold_at_every_size(spark):
    cases = [(r, n) for n in (3, 4, 5, 8, 17, 100, 1999, 2000, 2001, 20_000) for r in (0.01, -0.05, 0.3, 0.5, -0.8, 0.95, 0.999)] + [(0.001, 1_000_001), (0.02, 1_000_000)]
    rows = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long").select("r", "n", (correlation_log_p(F.col("r"), F.col("n")) / F.log(F.lit(10.0))).alias("l"), correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for row in rows:
        if row.n * row.r**2 > 5e4 or row.n > 50_000 and row.r < 0.01:
            continue
        want = exact_tail(row.r, row.n)
        assert abs(row.l - want) < 1e-9 / 2.4, row  # 1e-9 of p
        assert row.p == 0 if want < -320 else abs(row.p / 10**want - 1) < 1e-9 or want < -300
    assert one(spark, correlation_log_p(F.lit(0.0), F.lit(9))) == 0 and one(spark, correlation_p(F.lit(1.0), F.lit(9))) == 0 and one(spark, correlation_p(F.lit(0.5), F.lit(2))) is None


def test_p_values_of_many_rows_take_little_time(spark):
    import time

    rows = spark.range(0, 20_000, 1, 1).select((((F.col("id") % 39) - 19) / 20.0).alias("r"), (3 + F.col("id") % 1997).alias("n"))
    since = time.monotonic()
    got = rows.select(F.count_if(correlation_log_p(F.col("r"), F.col("n")) <= 0)).first()[0]
    assert got == 20_000 and time.monotonic() - since < 20  # 48 s where each row's fraction was interpreted


def test_tails_of_the_normal_distribution(spark):
    import math

    z = [0.0, 0.1, 1.0, 2.0, 2.449, 2.45, 3.0, -6.0, 10.0, 35.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", two_sided_normal(F.col("z")).alias("p")).collect()
    assert all(abs(r.p / math.erfc(abs(r.z) / math.sqrt(2)) - 1) < 1e-12 for r in rows)


def test_bounds_of_time(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59, 59),), (dt.datetime(2024, 1, 2),)], "ts timestamp_ntz")
    assert [r.v for r in rows.select(K.time_key(F.col("ts"), K.TimeUnit.DAY).alias("v")).collect()] == ["2024-01-01", "2024-01-02"]
