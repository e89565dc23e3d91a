"""Delta-log streams, clustered writes, compaction and the partitioned snapshot."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from starlayer.operators import facts
from starlayer.operators.snapshots import AccumulatingSnapshot
from starlayer.session import scratch_dir
from starlayer.sources import sinks
from starlayer.streaming import stream_ops as so


def local(path):
    return path[5:] if path.startswith("file:") else path


def files(path, suffix=".parquet"):
    out = {}
    for folder, _, names in os.walk(local(path)):
        for n in names:
            if n.endswith(suffix) and not n.startswith((".", "_")):
                out[f"{folder}/{n}"] = os.stat(f"{folder}/{n}").st_mtime_ns
    return out


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


# --- delta log -----------------------------------------------------------------------

def sums(spark, buckets=4):
    def add(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    schema = spark.createDataFrame([], "k int, n long").schema
    return so.DeltaTable(spark, scratch_dir(spark, "delta"), schema, ["k"], add, buckets)


def test_delta_table_compacts_and_survives_retries(spark):
    rng = random.Random(1)
    table, want, written = sums(spark), {}, []
    for b in range(9):
        rows = [(rng.choice([None, *range(30)]), 1) for _ in range(200)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        frame = spark.createDataFrame(rows, "k int, n long")
        table.write(frame, b)
        if b in (3, 6):
            table.write(frame, b)  # a retried batch
        written.append(max(len(so.DeltaTable.cover(r)) for r in table.runs().values()))
        assert {r.k: r.n for r in table.read().collect()} == want
    assert max(written) <= 5 and sum(len(r) for r in table.runs().values()) < 9 * 4


def test_a_batch_writes_only_itself(spark):
    """The table is large, the batch small: what is written follows the batch,
    and buckets that it doesn't meet are left alone."""
    table = sums(spark)
    table.write(spark.range(200_000).select(F.col("id").cast("int").alias("k"), F.lit(1).cast("long").alias("n")), 0)
    before = files(table.base)
    table.write(spark.createDataFrame([(1, 5)], "k int, n long"), 1)
    table.write(spark.createDataFrame([(1, 5)], "k int, n long"), 2)
    after = files(table.base)
    assert set(before) <= set(after)
    new = sum(os.path.getsize(f) for f in set(after) - set(before))
    assert new < sum(os.path.getsize(f) for f in before) / 100
    assert table.read().where("k = 1").first().n == 11


def test_cover_takes_the_widest_runs():
    r = lambda lo, hi: so.Run(lo, hi, 1, f"{lo}-{hi}")
    runs = [r(0, 0), r(1, 1), r(0, 1), r(3, 3), r(4, 4), r(3, 4), r(5, 5)]
    assert [x.path for x in so.DeltaTable.cover(runs)] == ["0-1", "3-4", "5-5"]
    assert [x.path for x in so.DeltaTable.cover(runs, before=4)] == ["0-1", "3-3"]


def test_stream_dedup_with_null_keys(spark):
    src = scratch_dir(spark, "events")
    rows = [(None, 5), (1, 3), (None, 2), (1, 9), (2, 4), (None, 7)]
    for i in range(3):
        spark.createDataFrame(rows[2 * i:2 * i + 2], "event_id long, ts long").coalesce(1).write.mode("append").parquet(src)
    stream = so.read_dir_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
    got = so.stream_dwd_dedup(stream, scratch_dir(spark, "o"), scratch_dir(spark, "k"), "event_id", "ts").read()
    assert bag(got) == sorted(map(repr, [(None, 2), (1, 3), (2, 4)]))


# --- clustered writes and compaction ------------------------------------------------------

def test_clustered_write_splits_hot_values_and_packs_small_ones(spark):
    df = spark.range(400_000).repartition(16).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 60 > 0, (F.col("id") % 60).cast("string")).alias("dt"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"))
    per_file = 20_000
    path = scratch_dir(spark, "clustered")
    back = sinks.sink_overwrite_partition(df, path, target_bytes=per_file * int(df._jdf.schema().defaultSize()))
    per = {}
    for f in files(path):
        per.setdefault(f.split("dt=")[1].split("/")[0], []).append(os.path.getsize(f))
    want = {r.dt or "__HIVE_DEFAULT_PARTITION__": -(-r["count"] // per_file) for r in df.groupBy("dt").count().collect()}
    assert {k: len(v) for k, v in per.items()} == want and want["hot"] == 14 and len(want) == 21
    assert max(per["hot"]) < 1.1 * min(per["hot"])
    assert bag(back.groupBy("dt").count()) == bag(df.groupBy("dt").count())
    tasks = sinks.clustered(df, "dt", per_file * 40, 40).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 1.5 * per_file
    assert sinks.clustered(df.limit(0), "dt").count() == 0


def test_compaction_rewrites_only_small_files(spark):
    path = scratch_dir(spark, "compact")
    df = spark.range(60_000).select((F.col("id") % 2).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    df.repartition(1).write.partitionBy("p").parquet(path)
    large = files(path)
    spark.range(2000).select((F.col("id") % 2).alias("p"), F.lit("small").alias("v")).repartition(8).write.mode("append").partitionBy("p").parquet(path)
    lone = df.where("p = 1").limit(5).select("v")
    before = bag(spark.read.parquet(path).groupBy("p", "v").count())
    assert len(files(path)) == len(large) + 16
    out = sinks.compact_small_files(spark, path, target_bytes=1 << 20)
    after = files(path)
    assert bag(out.groupBy("p", "v").count()) == before and lone.count() == 5
    assert len(after) == len(large) + 2 and all(after[f] == t for f, t in large.items())
    again = files(path)
    sinks.compact_small_files(spark, path, target_bytes=1 << 20)
    assert files(path) == again  # nothing left to do


def test_compaction_plan_fills_bins(spark):
    plan = sinks.compaction_plan(spark.createDataFrame(
        [(f"/t/p=1/{i:02}", 30) for i in range(10)] + [("/t/p=2/a", 10), ("/t/p=1/big", 80)], "path string, bytes long"), 100).collect()
    assert {r.folder for r in plan} == {"/t/p=1"} and len(plan) <= 10
    bins = {}
    for r in plan:
        bins[r.bin] = bins.get(r.bin, 0) + r.bytes
    assert max(bins.values()) < 100 + 30 and len(bins) <= 3


# --- accumulating snapshot -----------------------------------------------------------------

MILESTONES = [("ordered", "ordered", "min"), ("paid", "paid", "min"), ("last_ship", "ship", "max")]
SCHEMA = "k int, process string, ts timestamp_ntz"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def full(spark, events):
    return facts.fact_accumulating(spark.createDataFrame(events, SCHEMA), "k", "process", "ts", MILESTONES)


def test_closed_partitions_stay_untouched(spark):
    table = AccumulatingSnapshot(spark, scratch_dir(spark, "acc"), "k", "process", "ts", MILESTONES)
    one = [(1, "ordered", at(0)), (1, "paid", at(1)), (1, "ship", at(2)), (2, "ordered", at(3)), (3, "ordered", at(3)), (4, "paid", at(4))]
    assert table.apply(spark.createDataFrame(one, SCHEMA)) == [None, at(0).date(), at(3).date()]
    assert {(r.start_part, r.unfinished) for r in table.index().collect()} == {(None, 1), (at(3).date(), 2)}
    before = files(f"{table.base}/data")
    two = [(2, "paid", at(5)), (5, "ordered", at(6)), (1, "paid", at(7)), (1, "ordered", at(8))]  # nothing new for 1
    assert table.apply(spark.createDataFrame(two, SCHEMA)) == [at(3).date(), at(6).date()]
    after = files(f"{table.base}/data")
    kept = {f for f in before if "2024-01-01" in f or "DEFAULT" in f}
    assert len(kept) == 2 and all(after.get(f) == before[f] for f in kept)
    assert bag(table.read().select(*full(spark, one).columns)) == bag(full(spark, one + two))
    # a later shipment reaches a closed partition; a start date arrives for the one without
    three = [(1, "ship", at(9)), (4, "ordered", at(2))]
    assert table.apply(spark.createDataFrame(three, SCHEMA)) == [None, at(0).date(), at(2).date()]
    assert bag(table.read().select(*full(spark, one).columns)) == bag(full(spark, one + two + three))
    assert not [f for f in files(f"{table.base}/data") if "DEFAULT" in f]
    reopened = AccumulatingSnapshot(spark, table.base, "k", "process", "ts", MILESTONES)
    assert reopened.apply(spark.createDataFrame(two + three, SCHEMA)) == []  # applied before


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_equal_a_full_build(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice([None, *range(40)]), rng.choice(["ordered", "paid", "ship", "other"]), at(rng.randrange(12), rng.randrange(24)))
              for _ in range(300)]
    table = AccumulatingSnapshot(spark, scratch_dir(spark, "acc"), "k", "process", "ts", MILESTONES)
    for k in range(0, 300, 100):
        table.apply(spark.createDataFrame(events[k:k + 100], SCHEMA))
    want = full(spark, events)
    assert bag(table.read().select(*want.columns)) == bag(want)
    unfinished = want.where("ordered_ts is null or paid_ts is null or last_ship_ts is null").groupBy("start_dt").count()
    assert bag(table.index()) == bag(unfinished)
