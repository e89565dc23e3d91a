"""Streaming operators over several micro-batches equal the batch answer."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from starlayer.operators import dims
from starlayer.plans.context import Ctx, change_log
from starlayer.plans.stream_plans import _orders_to_changes
from starlayer.session import _local_fallback, scratch_dir
from starlayer.sources.trade import trade_order
from starlayer.streaming import stream_ops as so


def _split(df, col, path):
    """Write one file per value of ``col`` so a file stream sees many batches."""
    import os
    df.repartition(col).write.mode("overwrite").partitionBy(col).parquet(path)
    # the file source takes files in modification-time order: make it the
    # partition order so batches arrive in event-time order
    local = path[5:] if path.startswith("file:") else path
    parts = sorted((d for d in os.listdir(local) if d.startswith(f"{col}=")), key=lambda d: int(d.split("=")[1]))
    for i, d in enumerate(parts):
        for f in os.listdir(os.path.join(local, d)):
            os.utime(os.path.join(local, d, f), (1_600_000_000 + i * 60, 1_600_000_000 + i * 60))
    return path


def test_stream_dws_1d_multi_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = _split(ev.withColumn("wk", F.weekofyear("ts")), "wk", scratch_dir(spark, "ev_split"))
    schema = spark.read.parquet(src).schema
    stream = so.read_dir_stream(spark, src, schema, max_files=1)
    t = so.stream_dws_1d(stream.drop("wk"), scratch_dir(spark, "dws_out"), scratch_dir(spark, "dws_ck"))
    batch = (ev.groupBy(F.col("ts").cast("date").alias("day"), "event_type")
             .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value_sum")))
    assert rows(t.read()) == rows(batch.select(*t.read().columns))


def test_stream_scd2_multi_batch(spark):
    c = Ctx(spark, SF_SMALL)
    log = change_log(c).withColumn("yr", F.year("change_date"))
    src = _split(log, "yr", scratch_dir(spark, "log_split"))
    schema = spark.read.parquet(src).schema
    stream = so.read_dir_stream(spark, src, schema, max_files=1)
    t = so.stream_scd2(stream, scratch_dir(spark, "scd_out"), scratch_dir(spark, "scd_ck"), "customer_key",
                       "change_date", ["priority"])
    full = dims.scd2_build(change_log(c), "customer_key", "change_date", ["priority"])
    got = t.read()
    assert rows(got) == rows(full.select(*got.columns))


def _folder_newest_first(spark, df, by, root, name):
    """The table as a folder of three files, the newest rows arriving first."""
    import os
    path = f"{root}/{name}.parquet"
    cut = df.withColumn("_k", (F.ntile(3).over(Window.orderBy(by)) - 1).cast("int"))
    for k in range(3):
        cut.where(F.col("_k") == 2 - k).drop("_k").coalesce(1).write.mode("append").parquet(path)
    local = path[5:] if path.startswith("file:") else path
    files = sorted((f for f in os.listdir(local) if f.startswith("part-")), key=lambda f: os.path.getmtime(f"{local}/{f}"))
    for i, f in enumerate(files):
        os.utime(f"{local}/{f}", (1_600_000_000 + 60 * i, 1_600_000_000 + 60 * i))


def test_streams_on_folder_tables_with_late_rows(spark):
    root = scratch_dir(spark, "late")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    _folder_newest_first(spark, ev, "ts", root, "events")
    _folder_newest_first(spark, o, "o_orderkey", root, "orders")
    stream = so.read_table_stream(spark, root, "events", max_files=1)
    got = so.stream_dws_1d(stream, scratch_dir(spark, "o"), scratch_dir(spark, "k")).read()
    batch = (ev.groupBy(F.col("ts").cast("date").alias("day"), "event_type")
             .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value_sum")))
    assert rows(got) == rows(batch.select(*got.columns))
    got = so.stream_dwd_dedup(stream.select("event_id", "ts"), scratch_dir(spark, "o"), scratch_dir(spark, "k"), "event_id", "ts").read()
    assert rows(got) == rows(ev.groupBy("event_id").agg(F.min("ts").alias("ts")))
    changes = so.read_table_stream(spark, root, "orders", max_files=1)
    got = so.stream_scd2(changes, scratch_dir(spark, "o"), scratch_dir(spark, "k"), "customer_key", "change_date", ["priority"],
                         prep=_orders_to_changes).read()
    full = dims.scd2_build(change_log(Ctx(spark, SF_SMALL)), "customer_key", "change_date", ["priority"])
    assert rows(got) == rows(full.select(*got.columns))
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    _folder_newest_first(spark, li, "l_shipdate", root, "lineitem")
    raw = trade_order(o, so.read_table_stream(spark, root, "lineitem", max_files=1))
    got = so.stream_dwd_latest(raw, scratch_dir(spark, "o"), scratch_dir(spark, "k")).read()
    assert rows(got.select("order_id", "item_id", "order_amount")) == rows(Ctx(spark, SF_SMALL).dwd().select("order_id", "item_id", "order_amount"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    for master in ("spark://h:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            _local_fallback(master)
