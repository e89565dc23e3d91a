"""Distinct counts of coarser grains, from the states of a finer one."""
import random

import pytest
from pyspark.sql import functions as F

from starlayer.operators import distinct


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(4), rng.choice([None, f"NO{rng.randrange(300)}"])) for _ in range(3000)]
    rows += [(9, 9, f"NO{i}") for i in range(100_000)] + [(8, 1, None)]
    return spark.createDataFrame(rows, "day int, shop int, number string")


def test_states_merge_to_the_distinct_counts(fact):
    numbers = distinct.dense_numbers(fact, "number")
    assert tuple(numbers.agg(F.min("number"), F.max("number"), F.count("number")).first()) == (1, 100_000, 100_000)
    base = distinct.distinct_state(fact, ["day", "shop"], "number", numbers).cache()
    assert base.agg(F.max(F.size("members"))).first()[0] <= distinct.BUCKET
    per_day = distinct.merge_states(base, ["day"]).cache()
    for state, by in ((base, ["day", "shop"]), (base, ["day"]), (base, ["shop"]), (per_day, ["day"])):
        want = fact.groupBy(*by).agg(F.countDistinct("number").alias("n")).where("n > 0")
        got = distinct.distinct_count(state, by, "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*by, "n").collect()))
    total = fact.agg(F.countDistinct("number")).first()[0]
    assert distinct.distinct_count(base, [], "n").first().n == total == distinct.distinct_count(per_day, [], "n").first().n
    halves = [distinct.merge_states(base.where(c), ["shop"]) for c in ("day < 3", "day >= 3")]
    both = distinct.distinct_count(halves[0].unionByName(halves[1]), ["shop"], "n")
    want = fact.groupBy("shop").agg(F.countDistinct("number").alias("n")).where("n > 0")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))


def test_no_rows(fact):
    none = fact.limit(0)
    base = distinct.distinct_state(none, ["day"], "number", distinct.dense_numbers(none, "number"))
    assert distinct.distinct_count(base, ["day"], "n").count() == 0
    assert distinct.distinct_count(base, [], "n").first().n == 0
