"""Registered queries: streaming operators run to completion with
``availableNow`` over the table files; each must equal its batch answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from starlayer.plans.catalog import register
from starlayer.plans.dim_plans import _SCD2_SQL
from starlayer.plans.sqlbits import ORDER_CHAIN, D, with_
from starlayer.session import scratch_dir
from starlayer.sources.trade import trade_order
from starlayer.streaming import stream_ops as so


@register("stream_dwd_latest", with_(*ORDER_CHAIN) + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount, order_status,
       order_no, created_at FROM dwd""")
def _stream_dwd_latest(c):
    li = so.read_table_stream(c.spark, c.sf_dir, "lineitem")
    raw = trade_order(c.t("orders"), li)
    t = so.stream_dwd_latest(raw, scratch_dir(c.spark, "s_dwd"), scratch_dir(c.spark, "s_dwd_ck"))
    return t.read().select("order_id", "user_id", "item_id", "merchant_id", "order_date", "order_amount",
                           "order_status", "order_no", "created_at")


@register("stream_dws_1d", f"""
SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS events, {D('SUM(CAST(value AS DECIMAL(18,2)))')} AS value_sum
FROM events GROUP BY ALL""")
def _stream_dws_1d(c):
    ev = so.read_table_stream(c.spark, c.sf_dir, "events")
    return so.stream_dws_1d(ev, scratch_dir(c.spark, "s_dws"), scratch_dir(c.spark, "s_dws_ck")).read()


def _orders_to_changes(df):
    o = df.select(F.col("o_custkey").alias("customer_key"), F.col("o_orderdate").cast("date").alias("change_date"),
                  F.col("o_orderpriority").alias("priority"), "o_orderkey")
    w = Window.partitionBy("customer_key", "change_date").orderBy(F.col("o_orderkey").desc())
    return o.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "o_orderkey")


@register("stream_scd2", _SCD2_SQL)
def _stream_scd2(c):
    o = so.read_table_stream(c.spark, c.sf_dir, "orders")
    t = so.stream_scd2(o, scratch_dir(c.spark, "s_scd2"), scratch_dir(c.spark, "s_scd2_ck"), "customer_key",
                       "change_date", ["priority"], prep=_orders_to_changes)
    return t.read()


@register("stream_dwd_dedup", """
SELECT event_id, ts, user_id, event_type, value FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY ts) = 1""")
def _stream_dwd_dedup(c):
    """Event landing with re-delivery dropped (the earliest row per event_id)."""
    ev = so.read_table_stream(c.spark, c.sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = so.stream_dwd_dedup(ev, scratch_dir(c.spark, "s_dedup"), scratch_dir(c.spark, "s_dedup_ck"),
                              "event_id", "ts")
    return out.read()
