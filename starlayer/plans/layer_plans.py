"""Registered queries: sources, DWD cleaning and the summary layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.operators import clean, distinct, layers
from starlayer.plans.catalog import register
from starlayer.plans.sqlbits import (
    ORDER_CHAIN, ORDERS_AS_OF, DEDUP_ORDER, TRADE_ORDER, STD, R, D, B,
    ads_cte, dws_cte, dwt_cte, with_,
)
from starlayer.session import scratch_dir

# ---------------------------------------------------------------- sources ---


@register("src_trade_order", with_(TRADE_ORDER) + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount,
       order_status, order_no, created_at FROM trade_order""")
def _src_trade_order(c):
    return c.trade_order()


# ------------------------------------------------------------------- DWD ----

@register("dwd_standardize", with_(TRADE_ORDER, STD) + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount,
       order_status, order_no, created_at FROM std""")
def _dwd_standardize(c):
    return clean.dwd_standardize(c.trade_order())


@register("dwd_filter_invalid", with_(TRADE_ORDER, STD) + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount,
       order_status, order_no, created_at FROM std
WHERE order_id IS NOT NULL AND order_amount >= 0""")
def _dwd_filter_invalid(c):
    return clean.dwd_filter_invalid(clean.dwd_standardize(c.trade_order()))


_DWD_SELECT = f"""SELECT order_id, user_id, item_id, merchant_id, order_date,
       {D('order_amount')} AS order_amount, order_status, order_no, created_at FROM dwd"""


@register("dwd_trade_order", with_(*ORDER_CHAIN) + _DWD_SELECT)
def _dwd_trade_order(c):
    return c.dwd()


@register("dwd_dedup_latest", with_(*ORDER_CHAIN) + _DWD_SELECT)
def _dwd_dedup_latest(c):
    return clean.dwd_dedup_latest(clean.dwd_filter_invalid(clean.dwd_standardize(c.trade_order())))


@register("dwd_reject", with_(TRADE_ORDER, STD) + f"""
, ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY {DEDUP_ORDER}) AS rn
  FROM std WHERE order_id IS NOT NULL AND order_amount >= 0)
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount,
       order_status, order_no, created_at, 'null_key' AS reject_reason FROM std WHERE order_id IS NULL
UNION ALL
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')},
       order_status, order_no, created_at, 'bad_amount' FROM std
WHERE order_id IS NOT NULL AND NOT COALESCE(order_amount >= 0, FALSE)
UNION ALL
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')},
       order_status, order_no, created_at, 'superseded' FROM ranked WHERE rn > 1""")
def _dwd_reject(c):
    by = c.by_order()
    return clean.dwd_reject(c.trade_order(keep_order_key=bool(by)), colocate=by)


STATUS_MAP = {"paid": "paid", "shipped": "shipped", "pending": "pending"}


_BOUNDS = """
, placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY order_amount) AS place, COUNT(*) OVER () AS n FROM dwd WHERE order_amount IS NOT NULL),
bounds AS (SELECT MIN(CASE WHEN place = GREATEST(1, (n * 10 + 999) // 1000) THEN order_amount END) AS low,
                  MIN(CASE WHEN place = GREATEST(1, (n * 990 + 999) // 1000) THEN order_amount END) AS high FROM placed)"""


@register("dwd_enum_standardize", with_(*ORDER_CHAIN) + _BOUNDS + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount,
       CASE LOWER(TRIM(order_status)) WHEN 'paid' THEN 'paid' WHEN 'shipped' THEN 'shipped'
            ELSE 'other' END AS order_status,
       order_no, created_at FROM dwd, bounds
WHERE order_amount BETWEEN low AND high""")
def _dwd_enum_standardize(c):
    """Standard codes of the rows between the first and the last hundredth of
    the amounts; 'pending' is unmapped so that the unknown branch is met."""
    m = {"paid": "paid", "shipped": "shipped"}
    return clean.dwd_enum_standardize(clean.dwd_drop_outliers(c.dwd_table()), m)


@register("dwd_drop_outliers", with_(*ORDER_CHAIN) + _BOUNDS + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount, order_status, order_no, created_at
FROM dwd, bounds WHERE order_amount BETWEEN low AND high""")
def _dwd_drop_outliers(c):
    """Rows between the first and the last hundredth of the amounts."""
    return clean.dwd_drop_outliers(c.dwd_table())


@register("dwd_attach_dim_keys", with_(*ORDER_CHAIN) + f"""
SELECT d.order_id, d.order_date, {D('d.order_amount')} AS order_amount,
       COALESCE(c.c_custkey, -1) AS customer_key,
       COALESCE(p.p_partkey, -1) AS part_key,
       COALESCE(s.s_suppkey, -1) AS supplier_key
FROM dwd d
LEFT JOIN customer c ON d.user_id = c.c_custkey
LEFT JOIN part p ON d.item_id = p.p_partkey
LEFT JOIN supplier s ON d.merchant_id = s.s_suppkey""")
def _dwd_attach_dim_keys(c):
    dims = [
        (c.t("customer"), "user_id", "c_custkey", "c_custkey", "customer_key"),
        (c.t("part"), "item_id", "p_partkey", "p_partkey", "part_key"),
        (c.t("supplier"), "merchant_id", "s_suppkey", "s_suppkey", "supplier_key"),
    ]
    out = clean.dwd_attach_dim_keys(c.dwd(), dims)
    return out.select("order_id", "order_date", "order_amount", "customer_key", "part_key", "supplier_key")


@register("degenerate_keep", with_(*ORDER_CHAIN) + """
SELECT order_date, COUNT(DISTINCT order_no) AS order_cnt, COUNT(*) AS line_cnt
FROM dwd GROUP BY order_date""")
def _degenerate_keep(c):
    return clean.degenerate_keep(c.dwd())


@register("degenerate_prefix_rollup", with_(*ORDER_CHAIN) + f"""
SELECT SUBSTRING(order_no, 1, 4) AS number_prefix, COUNT(DISTINCT order_no) AS order_cnt,
       COUNT(*) AS line_cnt, {D('SUM(order_amount)')} AS gmv
FROM dwd GROUP BY 1""")
def _degenerate_prefix_rollup(c):
    return clean.degenerate_prefix_rollup(c.dwd())


@register("degenerate_drill", with_(*ORDER_CHAIN) + f"""
SELECT order_id, user_id, item_id, merchant_id, order_date, {D('order_amount')} AS order_amount,
       order_status, order_no, created_at FROM dwd WHERE order_no = 'NO00000007'""")
def _degenerate_drill(c):
    return clean.degenerate_drill(c.dwd(), "NO00000007")


@register("ads_masked", with_(*ORDER_CHAIN) + """
SELECT order_id, sha256(CAST(user_id AS VARCHAR)) AS user_id,
       CASE WHEN LENGTH(order_no) <= 4 THEN REPEAT('*', LENGTH(order_no))
            ELSE SUBSTRING(order_no, 1, 2) || REPEAT('*', LENGTH(order_no) - 4) || RIGHT(order_no, 2)
       END AS order_no
FROM dwd""")
def _ads_masked(c):
    return clean.ads_masked(c.dwd().select("order_id", "user_id", "order_no"),
                            hash_cols=["user_id"], mask_cols=["order_no"])


# ----------------------------------------------------------- DWS/DWT/ADS ----

@register("dws_trade_order_1d", with_(*ORDER_CHAIN, dws_cte()) + f"""
SELECT order_date, user_id, merchant_id, order_cnt, {D('gmv')} AS gmv, avg_order_amount,
       paid_order_cnt FROM dws""")
def _dws_trade_order_1d(c):
    return c.dws(30)


@register("dws_trade_order_1d_all", with_(*ORDER_CHAIN, dws_cte(window_days=None)) + f"""
SELECT order_date, user_id, merchant_id, order_cnt, {D('gmv')} AS gmv, avg_order_amount,
       paid_order_cnt FROM dws""")
def _dws_trade_order_1d_all(c):
    return c.dws(None)


@register("dwt_user_topic", with_(*ORDER_CHAIN, dws_cte("dws_all", None), dwt_cte()) + f"""
SELECT user_id, active_days, lifetime_order_cnt, {D('lifetime_gmv')} AS lifetime_gmv,
       last_order_date, dt FROM dwt""")
def _dwt_user_topic(c):
    return c.dwt()


@register("dwt_merchant_topic", with_(*ORDER_CHAIN, dws_cte("dws_all", None),
                                      dwt_cte(subject="merchant_id")) + f"""
SELECT merchant_id, active_days, lifetime_order_cnt, {D('lifetime_gmv')} AS lifetime_gmv,
       last_order_date, dt FROM dwt""")
def _dwt_merchant_topic(c):
    return layers.dwt_merchant_topic(c.dws(None), c.as_of)


_ITEM_DWS = f"""dws_item AS (
  SELECT order_date AS period_date, item_id, COUNT(DISTINCT order_id) AS order_cnt,
         SUM(order_amount) AS gmv,
         COUNT(DISTINCT CASE WHEN order_status = 'paid' THEN order_id END) AS paid_order_cnt
  FROM dwd WHERE order_date <= {ORDERS_AS_OF} GROUP BY order_date, item_id)"""


@register("dwt_item_topic", with_(*ORDER_CHAIN, _ITEM_DWS,
                                  dwt_cte(src="dws_item", subject="item_id", date_col="period_date")) + f"""
SELECT item_id, active_days, lifetime_order_cnt, {D('lifetime_gmv')} AS lifetime_gmv,
       last_order_date, dt FROM dwt""")
def _dwt_item_topic(c):
    return layers.dwt_item_topic(c.dwd(), c.as_of, keys_unique=True)


_ADS_SELECT = f"""SELECT order_date, merchant_id, order_cnt, {D('gmv')} AS gmv, paid_order_cnt,
       paid_rate, avg_order_amount FROM ads"""


@register("ads_trade_summary", with_(*ORDER_CHAIN, dws_cte(), ads_cte()) + _ADS_SELECT)
def _ads_trade_summary(c):
    return c.ads(30)


@register("ads_trade_summary_all", with_(*ORDER_CHAIN, dws_cte(window_days=None), ads_cte()) + _ADS_SELECT)
def _ads_trade_summary_all(c):
    return c.ads(None)


@register("topk_merchants", with_(*ORDER_CHAIN, dws_cte(window_days=None), ads_cte()) + f"""
, m AS (SELECT merchant_id, SUM(gmv) AS gmv, CAST(SUM(order_cnt) AS BIGINT) AS order_cnt
        FROM ads GROUP BY merchant_id)
SELECT merchant_id, {D('gmv')} AS gmv, order_cnt FROM m
ORDER BY gmv DESC, merchant_id LIMIT 10""")
def _topk_merchants(c):
    from starlayer.operators.metrics import topk
    m = c.ads(None).groupBy("merchant_id").agg(F.sum("gmv").alias("gmv"),
                                               F.sum("order_cnt").cast("bigint").alias("order_cnt"))
    return topk(m, [F.col("gmv").desc(), F.col("merchant_id").asc()], 10)


def _rollup_sql(period: str, dims: str = "") -> str:
    pk = {"1d": "order_date", "1w": "CAST(date_trunc('week', order_date) AS DATE)",
          "1m": "CAST(date_trunc('month', order_date) AS DATE)", "td": ORDERS_AS_OF}[period]
    extra = f", {dims}" if dims else ""
    return with_(*ORDER_CHAIN) + f"""
SELECT {pk} AS period_date, merchant_id{extra}, COUNT(DISTINCT order_id) AS order_cnt,
       {D('SUM(order_amount)')} AS gmv,
       COUNT(DISTINCT CASE WHEN order_status = 'paid' THEN order_id END) AS paid_order_cnt
FROM dwd WHERE order_date <= {ORDERS_AS_OF}
GROUP BY {pk}, merchant_id{extra}"""


for _p in ("", "1d", "1w", "1m", "td"):
    def _mk(p):
        key = f"dws_subject_rollup_{p}" if p else "dws_subject_rollup"
        p = p or "1d"

        @register(key, _rollup_sql(p, "order_status"))
        def _q(c):
            return layers.dws_subject_rollup(c.dwd(), "merchant_id", ["order_status"], p, c.as_of, keys_unique=True)
    _mk(_p)


@register("dwt_incremental", with_(*ORDER_CHAIN, dws_cte("dws_all", None), dwt_cte()) + f"""
SELECT user_id, active_days, lifetime_order_cnt, {D('lifetime_gmv')} AS lifetime_gmv,
       last_order_date, dt FROM dwt""")
def _dwt_incremental(c):
    """Incremental DWT (history before 2001-01-01 + batch after) — must equal the
    full recompute, which is what the oracle computes."""
    dws = c.dws(None)
    cut = F.lit("2001-01-01").cast("date")
    prev = layers.dwt_user_topic(dws.filter(F.col("order_date") < cut), "2000-12-31")
    return layers.dwt_incremental(prev, dws.filter(F.col("order_date") >= cut), c.as_of)


@register("layer_verify_ods", with_(TRADE_ORDER) + "SELECT COUNT(*) AS row_count FROM trade_order")
def _layer_verify_ods(c):
    from starlayer.sources.sinks import ods_sync
    return layers.layer_verify_ods(ods_sync(c.trade_order(), c.as_of))


@register("layer_verify_dwd", with_(*ORDER_CHAIN) + """
SELECT COUNT(*) AS row_count, COUNT(DISTINCT order_id) AS distinct_orders,
       CAST(SUM(CASE WHEN order_amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_amount_count
FROM dwd""")
def _layer_verify_dwd(c):
    return layers.layer_verify_dwd(c.dwd())


@register("layer_verify_dws", with_(*ORDER_CHAIN, dws_cte()) + f"""
SELECT COUNT(*) AS row_count, {D('SUM(gmv)')} AS total_gmv, {B('SUM(order_cnt)')} AS total_order_cnt
FROM dws""")
def _layer_verify_dws(c):
    return layers.layer_verify_dws(c.dws(30))


@register("layer_verify_dwt", with_(*ORDER_CHAIN, dws_cte("dws_all", None), dwt_cte()) + f"""
SELECT COUNT(*) AS user_count, {D('SUM(lifetime_gmv)')} AS total_gmv,
       {R('SUM(lifetime_order_cnt)', 'COUNT(lifetime_order_cnt)', 4)} AS avg_orders_per_user
FROM dwt""")
def _layer_verify_dwt(c):
    return layers.layer_verify_dwt(c.dwt())


@register("layer_verify_ads", with_(*ORDER_CHAIN, dws_cte(), ads_cte()) + f"""
SELECT COUNT(*) AS row_count, {D('SUM(gmv)')} AS total_gmv, MIN(order_date) AS min_date,
       MAX(order_date) AS max_date FROM ads""")
def _layer_verify_ads(c):
    return layers.layer_verify_ads(c.ads(30))


@register("daily_gmv", with_(*ORDER_CHAIN) + f"""
SELECT order_date, COUNT(*) AS cnt, {D('SUM(order_amount)')} AS gmv FROM dwd
GROUP BY order_date ORDER BY order_date DESC""")
def _daily_gmv(c):
    return layers.daily_gmv(c.dwd()).orderBy(F.col("order_date").desc())


@register("dws_exact_distinct_guard", with_(*ORDER_CHAIN) + """
, e AS (SELECT order_date, COUNT(DISTINCT order_no) AS exact_cnt FROM dwd GROUP BY order_date),
g AS (SELECT order_date, SUM(c) AS summed_cnt FROM (
        SELECT order_date, user_id, merchant_id, COUNT(DISTINCT order_no) AS c FROM dwd
        GROUP BY ALL) GROUP BY order_date)
SELECT e.order_date, CAST(exact_cnt AS BIGINT) AS exact_cnt, CAST(summed_cnt AS BIGINT) AS summed_cnt,
       CAST(summed_cnt - exact_cnt AS BIGINT) AS overcount
FROM e JOIN g ON e.order_date = g.order_date""")
def _dws_exact_distinct_guard(c):
    return layers.dws_exact_distinct_guard(c.dwd())


@register("dws_distinct_rollup", with_(*ORDER_CHAIN) + """
SELECT 'month' AS grain, CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS value, COUNT(DISTINCT order_no) AS orders
FROM dwd GROUP BY 1, 2 HAVING COUNT(order_no) > 0
UNION ALL SELECT 'merchant', CAST(merchant_id AS VARCHAR), COUNT(DISTINCT order_no) FROM dwd GROUP BY 1, 2 HAVING COUNT(order_no) > 0
UNION ALL SELECT 'all', 'all', COUNT(DISTINCT order_no) FROM dwd""")
def _dws_distinct_rollup(c):
    """Distinct orders by month, by merchant and in all, each from the sets kept
    in the daily summary (date, user, merchant), not from DWD."""
    dwd = c.dwd_table()
    daily = distinct.distinct_state(dwd, ["order_date", "user_id", "merchant_id"], "order_no", distinct.dense_numbers(dwd, "order_no"))
    path = scratch_dir(c.spark, "dws_sets")
    daily.write.parquet(path)
    daily = c.spark.read.parquet(path)
    month = distinct.distinct_count(daily, [F.trunc("order_date", "month").cast("string").alias("value")], "orders")
    shop = distinct.distinct_count(daily, [F.col("merchant_id").cast("string").alias("value")], "orders")
    whole = distinct.distinct_count(daily, [], "orders").withColumn("value", F.lit("all"))
    return (month.withColumn("grain", F.lit("month")).unionByName(shop.withColumn("grain", F.lit("merchant")))
            .unionByName(whole.withColumn("grain", F.lit("all"))).select("grain", "value", "orders"))
