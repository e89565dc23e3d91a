"""Registered queries: landing, sinks and storage layout.

Each sink writes into a fresh folder under the session's checkpoint area and
returns the re-read table, so the check sees what was stored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.operators import layers
from starlayer.sources import sinks as s
from starlayer.sources.trade import read_partition_window
from starlayer.plans.catalog import register
from starlayer.plans.sqlbits import ORDER_CHAIN, ORDERS_AS_OF, TRADE_ORDER, D, dws_cte, dwt_cte, ads_cte, with_
from starlayer.session import scratch_dir


_TO_SEL = ("order_id, user_id, item_id, merchant_id, order_date, CAST(order_amount AS DOUBLE) AS order_amount, "
           "order_status, order_no, created_at")


@register("ods_sync", with_(TRADE_ORDER) + f"""
SELECT {_TO_SEL}, TIMESTAMP '2001-08-01 00:00:00' AS etl_time, 'starlayer' AS etl_source FROM trade_order""")
def _ods_sync(c):
    return s.ods_sync(c.trade_order(), c.as_of)


_DWD_SEL = _TO_SEL.replace("order_amount AS DOUBLE", "order_amount AS DOUBLE")


@register("ods_append_partition", with_(*ORDER_CHAIN) + f"""
SELECT {_DWD_SEL}, CASE WHEN order_date < {ORDERS_AS_OF} - INTERVAL 30 DAY THEN DATE '2001-07-01'
                        ELSE {ORDERS_AS_OF} END AS dt FROM dwd""")
def _ods_append_partition(c):
    """History lands as dt=2001-07-01, the last 30 days as dt=as_of — the second
    batch is landed twice (a rerun) and must not duplicate rows."""
    path = scratch_dir(c.spark, "ods_append")
    dwd = c.dwd_table()
    recent = F.col("order_date") >= F.date_sub(F.lit(c.as_of), 30)
    s.ods_append_partition(dwd.filter(~recent), path, "2001-07-01")
    s.ods_append_partition(dwd.filter(recent), path, c.as_of)
    out = s.ods_append_partition(dwd.filter(recent), path, c.as_of)
    return out.select(*dwd.columns, "dt")


@register("sink_overwrite_table", with_(*ORDER_CHAIN, dws_cte(window_days=None), ads_cte()) + f"""
SELECT order_date, merchant_id, order_cnt, {D('gmv')} AS gmv, paid_order_cnt, paid_rate, avg_order_amount
FROM ads""")
def _sink_overwrite_table(c):
    path = scratch_dir(c.spark, "ads")
    s.sink_overwrite_table(c.ads(30), path)  # first version, replaced below
    return s.sink_overwrite_table(c.ads(None), path)


@register("sink_overwrite_partition", with_(*ORDER_CHAIN) + f"""
SELECT {_DWD_SEL}, year(order_date) AS yr FROM dwd
WHERE year(order_date) < 2001 OR order_status = 'paid'""")
def _sink_overwrite_partition(c):
    """Write DWD by year, then overwrite only the 2001 partition with its paid
    rows: other years must be untouched."""
    path = scratch_dir(c.spark, "dwd_by_year")
    d = c.dwd_table().withColumn("yr", F.year("order_date"))
    s.sink_overwrite_partition(d, path, "yr")
    out = s.sink_overwrite_partition(d.filter((F.col("yr") == 2001) & (F.col("order_status") == "paid")), path, "yr")
    return out.select(*c.dwd_table().columns, F.col("yr").cast("int").alias("yr"))


@register("sink_upsert", with_(*ORDER_CHAIN, dws_cte("dws_all", None), dwt_cte()) + f"""
SELECT user_id, active_days, lifetime_order_cnt, {D('lifetime_gmv')} AS lifetime_gmv, last_order_date, dt FROM dwt""")
def _sink_upsert(c):
    """DWT as of 2000-12-31, upserted with the recomputed rows of the users
    touched by the later DWS batch → the full DWT."""
    dws = c.dws(None)
    cut = F.lit("2001-01-01").cast("date")
    prev = layers.dwt_user_topic(dws.filter(F.col("order_date") < cut), c.as_of)
    batch = dws.filter(F.col("order_date") >= cut)
    touched = layers.dwt_incremental(prev, batch, c.as_of).join(batch.select("user_id").distinct(), "user_id",
                                                                "left_semi")
    base = s.sink_overwrite_table(prev, scratch_dir(c.spark, "dwt_prev"))
    return s.sink_upsert(base, touched, ["user_id"], scratch_dir(c.spark, "dwt_next"))


@register("archive_split", with_(*ORDER_CHAIN) + f"""
SELECT order_id, created_at, CASE WHEN CAST(created_at AS DATE) < DATE '2001-02-01' THEN 'cold' ELSE 'hot' END AS tier
FROM dwd""")
def _archive_split(c):
    t = s.archive_split(c.dwd_table().select("order_id", "created_at"), "created_at", c.as_of, 6)
    return s.write_tiers(t, scratch_dir(c.spark, "tiers")).select("order_id", "created_at", "tier")


def _compacted(c):
    """DWD in many small files, compacted to files of 1 MB; the counts of files
    before and after."""
    path = scratch_dir(c.spark, "dwd_small_files")
    c.dwd().repartition(16).write.mode("overwrite").parquet(path)
    before = c.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_before"))
    before = s.sink_overwrite_table(before, scratch_dir(c.spark, "rows_before"))
    files = s.sink_overwrite_table(s.list_files(c.spark, path).agg(F.count(F.lit(1)).alias("files_before")),
                                   scratch_dir(c.spark, "files_before"))
    table = s.compact_small_files(c.spark, path, 1 << 20)
    return path, table, before, files


@register("compact_files")
def _compact_files(c):
    """Files and rows before and after compaction (rows-only check: file counts
    are engine-specific)."""
    from starlayer.functions.joins import with_scalars
    path, table, rows, files = _compacted(c)
    after = s.list_files(c.spark, path).agg(F.count(F.lit(1)).alias("files_after"))
    out = with_scalars(files, after)
    return with_scalars(with_scalars(out, rows), table.agg(F.count(F.lit(1)).alias("rows_after")))


@register("compact_files_content", with_(*ORDER_CHAIN) + f"SELECT {_DWD_SEL} FROM dwd")
def _compact_files_content(c):
    """The rows of the compacted table: the same as before."""
    return _compacted(c)[1]


@register("read_partition_window", with_(*ORDER_CHAIN) + f"""
SELECT {_DWD_SEL}, CAST(date_trunc('month', order_date) AS DATE) AS dt FROM dwd
WHERE date_trunc('month', order_date) BETWEEN DATE '2000-01-01' AND DATE '2000-12-01'""")
def _read_partition_window(c):
    path = scratch_dir(c.spark, "dwd_by_month")
    d = c.dwd_table().withColumn("dt", F.trunc("order_date", "month"))
    s.sink_overwrite_partition(d, path, "dt")
    t = c.spark.read.parquet(path)
    return read_partition_window(t, "2000-01-01", "2000-12-01").select(*c.dwd_table().columns, F.col("dt").cast("date"))
