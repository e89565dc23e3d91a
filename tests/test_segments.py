"""Segmented scans: a key with most of the rows, cut into segments, against the
plain windows and joins."""
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starlayer.functions import segments
from starlayer.operators import clean, dims, joins, metrics

DAY = dt.date(2020, 1, 1)


@pytest.fixture
def small(monkeypatch):
    """Keys are cut from the first row on."""
    monkeypatch.setattr(segments, "LEAST", 1)


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def log(spark):
    """A hot key, a NULL key and small ones, values that often repeat."""
    rng = random.Random(1)
    rows = [(k, DAY + dt.timedelta(days=i), rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 1, 2]))
            for k, n in ((1, 2500), (None, 700), (2, 30), (3, 1), (4, 12)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, d date, v string, w int").repartition(5)


def test_segments_part_a_hot_key_evenly(spark, log, small):
    s = segments.segment(log, ["k"], [F.col("d")], parts=8)
    sizes = {r[0]: [] for r in s.rows.select("k").distinct().collect()}
    for r in s.rows.groupBy("k", segments.SEG).count().collect():
        sizes[r[0]].append(r[2])
    assert s.cut and len(sizes[1]) >= 5 and len(sizes[None]) >= 2 and len(sizes[2]) == len(sizes[3]) == 1
    even = 3243 / 8
    assert max(sizes[1]) < 3 * even
    assert s.rows.count() == log.count()


def test_plain_keys_are_left_alone(log):
    assert not segments.segment(log, ["k"], [F.col("d")], parts=8).cut


def test_rank_equals_row_number(log, small):
    s = segments.segment(log, ["k"], [F.col("d")], parts=8)
    got = segments.rank(s, "n").select("k", "d", "n")
    want = log.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("d"))).select("k", "d", "n")
    assert bag(got) == bag(want)


def test_version_chains_of_a_hot_key(log, small):
    attrs = ["v", "w"]
    w = Window.partitionBy("k").orderBy("d")
    want = (log.withColumn("_c", dims._changed(attrs, w)).filter("_c")
            .select("k", *attrs, F.col("d").alias("effective_date"), F.coalesce(F.lead("d").over(w), F.lit(dims.OPEN_END)).alias("expiry_date"))
            .withColumn("is_current", F.col("expiry_date") == F.lit(dims.OPEN_END)))
    assert bag(dims.scd_versions(log, "k", "d", attrs, parts=8)) == bag(want)
    last = dims.scd3_prev(log, "k", "d", "v").collect()
    runs = {}
    for r in sorted(log.collect(), key=lambda r: r.d):
        if not runs.get(r.k) or runs[r.k][-1][0] != r.v:
            runs.setdefault(r.k, []).append((r.v, r.d))
    assert {(r.k, r.current_v, r.previous_v, r.changed_date) for r in last} == {
        (k, x[-1][0], x[-2][0] if len(x) > 1 else None, x[-1][1]) for k, x in runs.items()}


@pytest.mark.parametrize("cut", [True, False])
def test_as_of_join_equals_the_range_join(spark, log, monkeypatch, cut):
    zipper = dims.zipper_build(log, "k", "d", ["v"]).where("k is null or k <> 4").cache()
    zipper = zipper.where(~((F.col("k") == 1) & (F.dayofmonth("start_date") == 7)))  # gaps
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.choice([None, *[DAY + dt.timedelta(days=rng.randrange(-20, 2600)) for _ in range(9)]]))
            for i in range(3000)]
    rows += [(9000 + i, 1, DAY + dt.timedelta(days=99)) for i in range(2000)] + [(1, 1, DAY)] * 3  # one hot day, equal rows
    fact = spark.createDataFrame(rows, "id int, k int, dt date")
    z = zipper.withColumnRenamed("k", "zk")
    cond = (fact.k == z.zk) & (z.start_date <= fact.dt) & (fact.dt < z.end_date)
    want = bag(fact.join(z, cond, "left").drop("zk"))
    if cut:
        monkeypatch.setattr(segments, "LEAST", 1)
    assert bag(joins.join_zipper_asof(fact, zipper, "k", "k", "dt", parts=8)) == want


def test_as_of_join_compares_no_pairs(spark, log):
    zipper = dims.zipper_build(log, "k", "d", ["v"])
    plan = joins.join_zipper_asof(log.select("k", "d"), zipper, "k", "k", "d")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_sessions_of_a_hot_user(spark, small):
    rng = random.Random(3)
    rows, at = [], dt.datetime(2024, 1, 1)
    for i in range(4000):
        at += dt.timedelta(minutes=rng.choice([0, 1, 5, 30, 31, 45]))
        rows.append((i, 1, at))
    rows += [(5000 + i, None if i % 2 else 2, dt.datetime(2024, 1, 2, 23, 50) + dt.timedelta(minutes=7 * i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp_ntz")
    want = {}
    for user in (1, 2, None):
        own = sorted((r[2], r[0]) for r in rows if r[1] == user)
        groups = []
        for t, _ in own:
            if groups and (t - groups[-1][-1]).total_seconds() <= 1800:
                groups[-1].append(t)
            else:
                groups.append([t])
        for g in groups:
            n, b = want.get(g[0].date(), (0, 0))
            want[g[0].date()] = (n + 1, b + (len(g) == 1))
    got = metrics.sessions_bounce(frame, parts=8)
    assert {r.day: (r.sessions, r.bounces) for r in got.collect()} == want


@pytest.mark.parametrize("n, lo, hi", [(1, "1", "1"), (3, "0.3333", "0.3334"), (6, "0.1666", "0.1667"), (5001, "0.0001999", "0.0002"),
                                       (10_000, "0.0001", "0.0001"), (10_001, "0.00009999", "0.0001"),
                                       (1_000_000, "0.000001", "0.000001")])
def test_bridge_weights_by_largest_remainder(spark, n, lo, hi):
    one = dims.bridge_build(spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("m")), "g", "m")
    r = one.agg(F.sum("weight").alias("s"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert (r.s, r.n, r.lo, r.hi) == (1, n, Decimal(lo), Decimal(hi))


def test_bridge_weights_of_a_cut_group(spark, small):
    df = spark.range(7007).select((F.col("id") % 7 == 6).cast("int").alias("g"), (F.col("id") * 37 % 7007).alias("m"))
    got = {(r.g, r.m): r.weight for r in dims.bridge_build(df, "g", "m", parts=8).collect()}
    for g, n in ((0, 6006), (1, 1001)):
        own = [w for (_, m), w in sorted(got.items()) if _ == g]
        unit = Decimal(10) ** -7
        assert len(own) == n and sum(own) == 1 and own == sorted(own) and own[-1] - own[0] == unit


def test_rejects_of_a_hot_key_equal_the_window(spark, small):
    """One key holds a third of the rows, another third has no key; amounts may be
    bad, times NULL or equal. Kept and rejected rows together are the input."""
    rng = random.Random(5)
    stamp = dt.datetime(2020, 1, 1)
    data = [(("hot", None, f"k{i % 40}")[i % 3], rng.choice([1, 2, None]), i, 1, DAY,
             rng.choice([Decimal("3.00"), Decimal("-1.00"), None, Decimal("0.00")]), "paid", f"N{i}",
             rng.choice([None, stamp, stamp + dt.timedelta(seconds=i % 7)])) for i in range(600)]
    raw = spark.createDataFrame(data, "order_id string, user_id bigint, item_id bigint, merchant_id bigint, order_date date, "
                                      "order_amount decimal(18,2), order_status string, order_no string, created_at timestamp_ntz")
    out = clean.dwd_reject(raw, parts=6)
    std = clean.dwd_standardize(raw)
    valid = clean.dwd_filter_invalid(std)
    w = Window.partitionBy("order_id").orderBy(*clean.dedup_order())
    late = valid.withColumn("_rn", F.row_number().over(w)).where("_rn > 1").drop("_rn")
    assert bag(out.where("reject_reason = 'superseded'").drop("reject_reason")) == bag(late)
    assert bag(out.where("reject_reason = 'null_key'").drop("reject_reason")) == bag(std.where("order_id is null"))
    assert bag(out.drop("reject_reason").unionByName(clean.dwd_trade_order(raw))) == bag(std)
    assert clean.dwd_reject(raw.limit(0), parts=6).count() == 0
