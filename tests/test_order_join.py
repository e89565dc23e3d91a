"""The order chain at size: tasks by counted rows, no second shuffle of the wide
rows, layers read from a stored table, bitmaps only where their members stand."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starlayer.functions import segments
from starlayer.operators import clean, dims, distinct, layers, quality
from starlayer.plans import catalog, sink_plans  # noqa: F401
from starlayer.plans.context import Ctx
from starlayer.sources import sinks, trade

STAMP = dt.datetime(2000, 1, 1)


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of a few lines, with repeated, NULL and dangling keys."""
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("orders"))
    orders = [(k, k % 17, rng.choice("FOP"), 1.0, STAMP + dt.timedelta(days=k % 600), "x") for k in range(300)] + [(None, 1, "F", 1.0, STAMP, "x")]
    lines = [(rng.choice([None, *range(310)]), rng.randrange(120), rng.randrange(9), rng.randrange(1, 4), 1.0, float(i % 400), 0.0, 0.0, "N", "F",
              STAMP + dt.timedelta(days=i % 50, seconds=i)) for i in range(2500)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                                  "o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
                          ).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_key_load_counts_rows_and_sees_a_hot_key(spark, monkeypatch):
    even = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"))
    assert segments.key_load(even, "k") == (2000, False)
    monkeypatch.setattr(segments, "LEAST", 500)
    assert segments.key_load(even, "k") == (2000, False)  # a thousand NULLs are no key
    assert segments.key_load(even.fillna(7), "k") == (3000, True)
    assert segments.key_load(even.limit(0), "k") == (0, False)


def test_tasks_of_the_order_join_follow_the_rows(spark, folder, monkeypatch):
    o, li = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "lineitem"))
    assert trade.join_parts(o, li) == min(8, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(trade, "ROWS_PER_TASK", 100)
    n = trade.join_parts(o, li)
    assert n == -(-li.where("l_orderkey is not null").count() // 100)
    assert plan(trade.trade_order(o, li, parts=n)).count(f", {n}), REPARTITION_BY_NUM") == 2
    assert bag(trade.trade_order(o, li, parts=n)) == bag(trade.trade_order(o, li))
    monkeypatch.setattr(segments, "LEAST", 0)
    assert trade.join_parts(o, li.fillna(5, ["l_orderkey"])) is None


def test_dwd_is_the_same_with_and_without_a_hot_order(spark, folder, monkeypatch):
    dealt = Ctx(spark, folder)
    assert "hashpartitioning(order_id" not in plan(dealt.dwd())
    names = ["dws_subject_rollup", "dwt_item_topic", "dwd_reject", "report_accuracy", "recon_extra", "ods_append_partition",
             "sink_overwrite_partition", "dws_distinct_rollup"]
    got = {n: bag(catalog.queries()[n](spark, folder)) for n in names}
    rows = bag(dealt.dwd())
    assert len(rows) == dealt.trade_order().where("order_amount >= 0 and order_id is not null").select("order_id").distinct().count()
    monkeypatch.setattr(Ctx, "order_parts", lambda self: None)  # as if some order were hot
    other = Ctx(spark, folder)
    assert "hashpartitioning(order_id" in plan(other.dwd())
    assert rows == bag(other.dwd())
    assert got == {n: bag(catalog.queries()[n](spark, folder)) for n in names}


def test_rejects_inside_the_orders_equal_the_rejects_by_key(spark, folder):
    c = Ctx(spark, folder)
    raw = c.trade_order(keep_order_key=True)
    near = clean.dwd_reject(raw, colocate=["_order_key"])
    assert near.columns == clean.dwd_reject(raw.drop("_order_key")).columns
    assert bag(near) == bag(clean.dwd_reject(raw.drop("_order_key")))
    assert "hashpartitioning(order_id" not in plan(near)


def test_batches_are_written_from_a_stored_layer(spark, folder, monkeypatch):
    seen = []
    clustered = sinks.clustered
    monkeypatch.setattr(sinks, "clustered", lambda df, *a: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), clustered(df, *a))[1])
    for name in ("ods_append_partition", "sink_overwrite_partition", "read_partition_window", "archive_split"):
        catalog.queries()[name](spark, folder).count()
    assert len(seen) == 3 + 2 + 1 + 1 and not any("Join" in p for p in seen)


def test_bitmaps_are_not_shuffled(spark):
    fact = spark.range(5000).select((F.col("id") % 7).alias("day"), F.concat(F.lit("N"), F.col("id") % 900).alias("number"))
    numbers = distinct.dense_numbers(fact, "number")
    assert "row_number" not in plan(numbers)  # places are stored with the parts
    state = distinct.distinct_state(fact, ["day"], "number", numbers)
    merged = plan(distinct.merge_states(state, ["day"]))
    assert merged.index("partial_bitmap_construct_agg") < merged.index("Generate") < merged.index("Exchange")
    assert "Exchange" not in merged[:merged.index("Generate")]
    want = fact.groupBy("day").agg(F.countDistinct("number").alias("n"))
    assert bag(distinct.distinct_count(state, ["day"], "n")) == bag(want.select("day", "n"))


def test_dense_keys_follow_the_order_over_parts(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 700).alias("a"), (F.col("id") % 3).alias("b"))
    got = dims._dense_key(df.repartition(13), ["a", "b"], "n").collect()
    rows = sorted({(r.a, r.b) for r in df.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted((r.n, r.a, r.b) for r in got if r.a is not None) == [(i, *x) for i, x in enumerate(rows, 1) if x[0] is not None]
    assert sorted(r.n for r in got) == list(range(1, len(rows) + 1))


def test_item_topic_counts_days_and_orders_without_sets(spark, folder):
    dwd = Ctx(spark, folder).dwd()
    lean = layers.dwt_item_topic(dwd, "2001-08-01", keys_unique=True)
    assert bag(lean) == bag(layers.dwt_item_topic(dwd, "2001-08-01"))
    assert "distinct" not in plan(lean).lower()
    assert "distinct" not in plan(catalog.queries()["dws_subject_rollup"](spark, folder)).lower()


def test_recon_by_parts_equals_recon(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (None, 3)], "k int, v int")
    b = spark.createDataFrame([(2, 9), (2, 8), (3, 1), (None, 1)], "k int, v int")
    for x, y in ((a, b), (b, a), (a.limit(0), b), (b, a.limit(0))):
        assert bag(quality.recon_extra(x, y, ["k"], 5)) == bag(quality.recon_extra(x, y, ["k"]))
