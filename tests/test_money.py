"""Money sums against ``math.fsum``, in any order and partitioning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.money import exact_avg, exact_sum


def _groups(seed=7):
    rnd = random.Random(seed)
    out = {
        "shares": [10 / 3] * 3, "digits": [1.2345678e-9], "zero": [0.0, -0.0], "cancel": [1e15, 1 / 3, -1e15],
        "signs": [0.1, -0.3, 0.2], "small": [2.0 ** -52, 2.0 ** -60 + 1, -1.0], "wide": [1e18, 9.007199254740993e15, 0.5],
        # exactly half-way between two doubles, and a last part that decides
        "tie": [2.0 ** 52 + 1, 0.5], "tie_up": [2.0 ** 52, 0.5, 2.0 ** -52], "tie_down": [2.0 ** 52 + 1, 0.5, -2.0 ** -52],
        "tie_deep": [2.0 ** 50, 0.125, 2.0 ** -52 * (1 + 2.0 ** -52)], "tie_big": [2.0 ** 53, 1.0], "tie_big_up": [2.0 ** 53, 1.0, 1e-15],
        "tie_big_down": [2.0 ** 53 + 2, 1.0, -1e-15], "negative_tie": [-2.0 ** 53, -1.0, -1e-15], "one_less": [1.0, -2.0 ** -52],
    }
    for i in range(150):
        size = rnd.choice([1, 2, 3, 50, 400])
        low, high = rnd.choice([(-2, 6), (-9, 12), (-15, 18)])
        out[f"r{i}"] = [rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.uniform(low, high) for _ in range(size)]
    for i in range(100):  # sums that nearly cancel, and cents
        x = rnd.random() * 10 ** rnd.randint(0, 15)
        out[f"c{i}"] = [x, 1 / rnd.randint(3, 10 ** 6), -x, round(rnd.random() * 100, 2)]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sum_is_the_nearest_double_in_any_order(spark, parts):
    groups = _groups()
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    random.Random(parts).shuffle(rows)
    got = spark.createDataFrame(rows, "g string, x double").repartition(parts).groupBy("g").agg(exact_sum("x").alias("s")).collect()
    assert {r.g: r.s for r in got} == {g: math.fsum(xs) for g, xs in groups.items()}


def test_exact_sum_of_odd_values(spark):
    rows = [("null", None), ("some", None), ("some", 2.5), ("huge", 1e300), ("huge", 1.0), ("tiny", 1e-300),
            ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", -1.0)]
    got = {r.g: r.s for r in spark.createDataFrame(rows, "g string, x double").groupBy("g").agg(exact_sum("x").alias("s")).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"null": None, "some": 2.5, "huge": 1e300, "tiny": 1e-300, "inf": float("inf")}
    empty = spark.createDataFrame([], "x double").agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).first()
    assert empty.s is None and empty.m is None
    assert spark.createDataFrame([(3,), (4,)], "x int").agg(exact_avg(F.col("x")).alias("m")).first().m == 3.5
