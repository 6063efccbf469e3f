import random

import pytest
from pyspark.sql import functions as F

from posledger.functions import wideint as w

RAY = 10**27
HUGE = 422166581625087607993


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def n(x):
    return F.lit(str(x)).cast(w.DEC)


def test_rounding(spark):
    up = lambda a, b: one(spark, w.ray_mul_up(n(a), n(b)))
    assert [up(2, RAY), up(1, RAY + 1), up(0, RAY)] == [2, 2, 0]
    assert up(HUGE, RAY) == HUGE
    assert [one(spark, w.from_ray_up(n(x))) for x in (RAY, RAY + 1, 1, 0)] == [1, 2, 1, 0]
    assert [one(spark, w.percent_mul_down(n(a), n(b))) for a, b in ((1, 9999), (10000, 1000))] == [0, 1000]


def test_products_of_any_width(spark):
    r = random.Random(1)
    rows = [(str(r.randrange(10 ** r.randint(1, 38))), str(r.randrange(10 ** r.randint(1, 27)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", w.product(n(0) + F.col("a").cast(w.DEC), F.col("b").cast(w.DEC)).alias("p")).collect()
    assert all(int(g.p) == int(g.a) * int(g.b) for g in got)
    small = df.where("length(b) < 27 AND length(a) < 30").select("a", "b", w.ray_mul_up(F.col("a"), F.col("b")).alias("p")).collect()
    assert small and all(int(g.p) == -(-int(g.a) * int(g.b) // RAY) for g in small)


def test_interest_and_premium(spark):
    year = w.YEAR_SECONDS
    assert one(spark, w.linear_interest(n(RAY // 20), F.lit(year))) == RAY + RAY // 20
    assert one(spark, w.linear_interest(n(RAY // 20), F.lit(2 * year))) == RAY + 2 * RAY // 20
    assert one(spark, w.premium_ray(n(1), n(-1), n(RAY))) == RAY + 1
    for bad in (w.premium_ray(n(1), n(2 * RAY), n(RAY)), w.linear_interest(n(1), F.lit(-1))):
        with pytest.raises(Exception, match="premium|checkpoint"):
            one(spark, bad)


def test_limbs(spark):
    r = random.Random(2)
    values = [r.choice((-1, 1)) * r.randrange(10 ** r.randint(1, 61)) for _ in range(60)] + [0, 10**52, -(10**52), 10**26 - 1, -(10**26)]
    df = spark.createDataFrame([(str(v), i % 3) for i, v in enumerate(values)], "v string, g int")
    parts = df.select("g", *[c.alias(f"l{k}") for k, c in enumerate(w.limbs(F.col("v")))])
    got = parts.groupBy("g").agg(w.joined(*[F.sum(f"l{k}").cast(w.DEC) for k in range(3)]).alias("s")).collect()
    assert {x.g: int(x.s) for x in got} == {g: sum(v for i, v in enumerate(values) if i % 3 == g) for g in range(3)}


def test_values(spark):
    value = lambda a, d, p: one(spark, w.to_value(n(a), F.lit(d), n(p)))
    assert value(10**6, 6, 10**8) == value(10**18, 18, 10**8) == value(10**20, 20, 10**8) == 10**26
    assert value(10**9, 6, 99971505) == 99971505 * 10**21
    wide = spark.createDataFrame([(str(10**60), str(3), str(7))], "a string, b string, d string")
    assert wide.select(w.mul_div_wide("a", "b", "d").alias("x")).first().x == str(3 * 10**60 // 7)


def test_decimal_strings(spark):
    cases = [
        (11290521655, 8, "112.90521655"), (99988821, 8, "0.99988821"), (11200000000, 8, "112"), (0, 18, "0"), (1234, 0, "1234"), (HUGE, 18, "422.166581625087607993"),
        (715108109307684305186400000000000, 26, "7151081.093076843051864"), (RAY, 27, "1"), (-4200000000, 8, "-42"), (-1, 8, "-0.00000001"),
    ]
    for v, d, want in cases:
        assert one(spark, w.to_decimal(n(v), F.lit(d))) == want
