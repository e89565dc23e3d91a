"""Exact quantiles against a sort, however the values are spread and tied."""
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starlayer.functions.quantiles import exact_quantiles, rank_of
from starlayer.operators.clean import dwd_drop_outliers

WANTED = [0, 10, 250, 500, 990, 1000]


def brute(values):
    own = sorted(v for v in values if v is not None)
    return [own[rank_of(len(own), p) - 1] if own else None for p in WANTED]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.none() | st.integers(-3, 3) | st.integers(-10**9, 10**9), max_size=60), st.sampled_from([2, 10]))
def test_any_values(spark, values, few):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert exact_quantiles(df, "v", WANTED, accuracy=20, few=few) == brute(values)


@pytest.mark.parametrize("spread", ["even", "tied", "skew"])
def test_many_values_in_several_passes(spark, spread):
    rng = random.Random(7)
    pick = {"even": lambda: rng.randrange(10**7), "tied": lambda: rng.choice([5, 5, 5, 6, 7, rng.randrange(100)]),
            "skew": lambda: int(10 ** rng.uniform(0, 9))}[spread]
    values = [pick() for _ in range(20_000)]
    df = spark.createDataFrame([(Decimal(v) / 100,) for v in values], "v decimal(18,2)").repartition(6)
    assert exact_quantiles(df, "v", WANTED, accuracy=50, few=40) == [Decimal(v) / 100 for v in brute(values)]


def test_outliers_go(spark):
    df = spark.range(1000).select(F.col("id").cast("decimal(18,2)").alias("order_amount")).unionByName(
        spark.createDataFrame([(None,)], "order_amount decimal(18,2)"))
    r = dwd_drop_outliers(df).agg(F.min("order_amount"), F.max("order_amount"), F.count(F.lit(1))).first()
    assert tuple(r) == (9, 989, 981)
    assert dwd_drop_outliers(df.where("order_amount is null")).count() == 0
