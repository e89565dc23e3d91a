"""Registered queries: reconciliation, edge checks, performance probes and the
quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.operators import quality as q
from starlayer.plans.catalog import register
from starlayer.plans.sqlbits import (
    ORDER_CHAIN, ORDERS_AS_OF, TRADE_ORDER, D, dws_cte, ads_cte, dwt_cte, with_,
)

_TO_COLS = "order_id, user_id, item_id, merchant_id, order_date, order_amount, order_status, order_no, created_at"
_TO_SEL = ("order_id, user_id, item_id, merchant_id, order_date, CAST(order_amount AS DOUBLE) AS order_amount, "
           "order_status, order_no, created_at")


@register("recon_missing", with_(*ORDER_CHAIN) + f"""
SELECT {_TO_SEL} FROM trade_order a
WHERE a.order_id IS NULL OR NOT EXISTS (SELECT 1 FROM dwd b WHERE b.order_id = a.order_id)""")
def _recon_missing(c):
    return q.recon_missing(c.trade_order(), c.dwd(), ["order_id"])


_KEYED = """keyed AS (
  SELECT * FROM dwd UNION ALL BY NAME
  SELECT * REPLACE (order_no || '-' || CAST(item_id AS VARCHAR) AS order_id) FROM trade_order WHERE order_id IS NULL)"""


_EXTRA_SQL = with_(*ORDER_CHAIN, _KEYED) + f"""
SELECT {_TO_SEL} FROM keyed b
WHERE NOT EXISTS (SELECT 1 FROM trade_order a WHERE a.order_id = b.order_id)"""


@register("recon_extra", _EXTRA_SQL)
@register("recon_extra_all", _EXTRA_SQL)
def _recon_extra(c):
    """The whole source against a target that also holds the orders without a
    key, under one made of order number and item: those keys are additional."""
    keyed = c.trade_order().filter(F.col("order_id").isNull()).withColumn(
        "order_id", F.concat_ws("-", "order_no", F.col("item_id").cast("string")))
    return q.recon_extra(c.trade_order(), c.dwd().unionByName(keyed), ["order_id"], c.order_parts())


@register("recon_amount_keys", with_(*ORDER_CHAIN) + f"""
SELECT COALESCE(a.merchant_id, b.merchant_id) AS merchant_id, COALESCE(a.order_date, b.order_date) AS order_date,
       {D('COALESCE(a.amount, 0)')} AS source_amount, {D('COALESCE(b.amount, 0)')} AS target_amount,
       {D('COALESCE(a.amount, 0) - COALESCE(b.amount, 0)')} AS amount_diff
FROM (SELECT merchant_id, order_date, SUM(order_amount) AS amount FROM trade_order GROUP BY ALL) a
FULL OUTER JOIN (SELECT merchant_id, order_date, SUM(order_amount) AS amount FROM dwd GROUP BY ALL) b
  ON a.merchant_id = b.merchant_id AND a.order_date = b.order_date
WHERE ABS(COALESCE(a.amount, 0) - COALESCE(b.amount, 0)) > 0.01""")
def _recon_amount_keys(c):
    """Amounts reconciled per merchant and date."""
    return q.recon_amount(c.trade_order(), c.dwd(), ["merchant_id", "order_date"])


@register("recon_amount", with_(*ORDER_CHAIN) + f"""
SELECT COALESCE(a.user_id, b.user_id) AS user_id,
       {D('COALESCE(a.amount, 0)')} AS source_amount, {D('COALESCE(b.amount, 0)')} AS target_amount,
       {D('COALESCE(a.amount, 0) - COALESCE(b.amount, 0)')} AS amount_diff
FROM (SELECT user_id, SUM(order_amount) AS amount FROM trade_order GROUP BY user_id) a
FULL OUTER JOIN (SELECT user_id, SUM(order_amount) AS amount FROM dwd GROUP BY user_id) b
  ON a.user_id = b.user_id
WHERE ABS(COALESCE(a.amount, 0) - COALESCE(b.amount, 0)) > 0.01""")
def _recon_amount(c):
    return q.recon_amount(c.trade_order(), c.dwd(), "user_id", "order_amount")


@register("recon_count", with_(*ORDER_CHAIN) + """
SELECT (SELECT COUNT(*) FROM trade_order) AS source_count, (SELECT COUNT(*) FROM dwd) AS target_count,
       (SELECT COUNT(*) FROM trade_order) - (SELECT COUNT(*) FROM dwd) AS diff_count""")
def _recon_count(c):
    return q.recon_count(c.trade_order(), c.dwd())


for _tbl in ("raw", "dwd", ""):
    def _mk(tbl):
        # "" = the plain key, on the dirty source (checks on clean tables are 0)
        raw = tbl in ("raw", "")
        src_sql = "trade_order" if raw else "dwd"
        pre = with_(TRADE_ORDER) if raw else with_(*ORDER_CHAIN)
        sfx = f"_{tbl}" if tbl else ""

        def frame(c):
            return c.trade_order() if raw else c.dwd()

        register(f"edge_null_pk{sfx}", pre + f"SELECT COUNT(*) AS null_pk_count FROM {src_sql} WHERE order_id IS NULL")(
            lambda c: q.edge_null_pk(frame(c)))
        register(f"edge_dup_pk{sfx}", pre + f"""SELECT order_id, COUNT(*) AS dup_count FROM {src_sql}
GROUP BY order_id HAVING COUNT(*) > 1""")(lambda c: q.edge_dup_pk(frame(c)))
        register(f"edge_negative{sfx}", pre + f"""SELECT COUNT(*) AS negative_amount_count FROM {src_sql}
WHERE order_amount < 0""")(lambda c: q.edge_negative(frame(c)))
        register(f"edge_zero{sfx}", pre + f"""SELECT COUNT(*) AS zero_amount_count FROM {src_sql}
WHERE order_amount = 0""")(lambda c: q.edge_zero(frame(c)))
        register(f"edge_future_date{sfx}", pre + f"""SELECT COUNT(*) AS future_date_count FROM {src_sql}
WHERE order_date > {ORDERS_AS_OF}""")(lambda c: q.edge_future_date(frame(c), c.as_of))
    _mk(_tbl)


@register("edge_daily_count", with_(*ORDER_CHAIN) + f"""
SELECT order_date, COUNT(*) AS daily_count FROM dwd
WHERE order_date >= {ORDERS_AS_OF} - INTERVAL 30 DAY GROUP BY order_date ORDER BY order_date DESC""")
def _edge_daily_count(c):
    return q.edge_daily_count(c.dwd_window(30), c.as_of)


@register("edge_date_gaps", with_(*ORDER_CHAIN) + """
, b AS (SELECT MIN(order_date) AS lo, MAX(order_date) AS hi FROM dwd),
cal AS (SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS missing_date FROM b)
SELECT missing_date FROM cal WHERE missing_date NOT IN (SELECT order_date FROM dwd)""")
def _edge_date_gaps(c):
    return q.edge_date_gaps(c.dwd())


@register("edge_skew", with_(*ORDER_CHAIN) + """
, per AS (SELECT item_id, COUNT(*) AS row_count FROM dwd GROUP BY item_id),
a AS (SELECT AVG(row_count) AS avg_count FROM per)
SELECT item_id, row_count, ROUND(avg_count, 4) AS avg_count, ROUND(row_count / avg_count, 4) AS skew_ratio
FROM per, a WHERE row_count > avg_count * 1.5""")
def _edge_skew(c):
    return q.edge_skew(c.dwd(), "item_id", 1.5)


@register("perf_row_count", with_(*ORDER_CHAIN) + "SELECT COUNT(*) AS row_count FROM dwd")
def _perf_row_count(c):
    return q.perf_row_count(c.dwd())


@register("perf_table_size")
def _perf_table_size(c):
    return q.perf_table_size(c.t("lineitem"))


@register("perf_full_agg", with_(*ORDER_CHAIN) + f"SELECT COUNT(*) AS c, {D('SUM(order_amount)')} AS s FROM dwd")
def _perf_full_agg(c):
    return q.perf_full_agg(c.dwd())


@register("report_accuracy", with_(*ORDER_CHAIN) + """
, n AS (SELECT (SELECT COUNT(*) FROM trade_order) AS s, (SELECT COUNT(*) FROM dwd) AS t),
sc AS (SELECT s, t, ABS(s - t) AS d, GREATEST(0, 100 - ABS(s - t) * 100.0 / GREATEST(s, 1)) AS score FROM n)
SELECT 'accuracy' AS name, ROUND(CAST(score AS DOUBLE), 2) AS score, score >= 80 AS passed,
       'source ' || s || ' rows vs target ' || t || ' rows, diff ' || d AS notes FROM sc""")
def _report_accuracy(c):
    return q.report_accuracy(q.recon_count(c.trade_order(), c.dwd()))


def _completeness_sql(src: str) -> str:
    return f"""
, per AS (SELECT order_id, COUNT(*) AS n FROM {src} GROUP BY order_id),
k AS (SELECT COALESCE(SUM(CASE WHEN order_id IS NULL THEN n END), 0) AS nn,
             COUNT(CASE WHEN n > 1 THEN 1 END) AS dd FROM per),
sc AS (SELECT nn, dd, CASE WHEN nn = 0 AND dd = 0 THEN 100.0
                           ELSE GREATEST(0.0, 100.0 - (nn + dd) * 5.0) END AS score FROM k)
SELECT 'completeness' AS name, ROUND(CAST(score AS DOUBLE), 2) AS score, score >= 90 AS passed,
       'null keys: ' || nn || ', duplicate keys: ' || dd AS notes FROM sc"""


@register("report_completeness_raw", with_(TRADE_ORDER) + _completeness_sql("trade_order"))
def _report_completeness_raw(c):
    return q.report_completeness(q.completeness_counts(c.trade_order()))


@register("report_completeness", with_(*ORDER_CHAIN) + _completeness_sql("dwd"))
def _report_completeness(c):
    return q.report_completeness(q.completeness_counts(c.dwd()))


_CONSISTENCY_SQL = with_(*ORDER_CHAIN, dws_cte(), ads_cte(), dws_cte("dws_all", None), dwt_cte()) + f"""
, t AS (SELECT
   (SELECT SUM(order_amount) FROM dwd WHERE order_date >= {ORDERS_AS_OF} - INTERVAL 30 DAY) AS dwd_gmv,
   (SELECT COUNT(*) FROM dwd WHERE order_date >= {ORDERS_AS_OF} - INTERVAL 30 DAY) AS dwd_orders,
   (SELECT SUM(gmv) FROM dws) AS dws_gmv, (SELECT SUM(order_cnt) FROM dws) AS dws_orders,
   (SELECT SUM(gmv) FROM ads) AS ads_gmv, (SELECT SUM(order_cnt) FROM ads) AS ads_orders,
   (SELECT SUM(gmv) FROM dws_all) AS dws_all_gmv, (SELECT SUM(order_cnt) FROM dws_all) AS dws_all_orders,
   (SELECT SUM(lifetime_gmv) FROM dwt) AS dwt_gmv, (SELECT SUM(lifetime_order_cnt) FROM dwt) AS dwt_orders),
ch AS (SELECT
   (CASE WHEN dwd_gmv = dws_gmv THEN 1 ELSE 0 END) + (CASE WHEN dwd_orders = dws_orders THEN 1 ELSE 0 END)
 + (CASE WHEN dws_gmv = ads_gmv THEN 1 ELSE 0 END) + (CASE WHEN dws_orders = ads_orders THEN 1 ELSE 0 END)
 + (CASE WHEN dws_all_gmv = dwt_gmv THEN 1 ELSE 0 END)
 + (CASE WHEN dws_all_orders = dwt_orders THEN 1 ELSE 0 END) AS held FROM t)
"""


@register("report_consistency", _CONSISTENCY_SQL + """
SELECT 'consistency' AS name, ROUND(held * 100.0 / 6, 2)::DOUBLE AS score, held * 100.0 / 6 >= 95 AS passed,
       held || ' of 6 layer checks hold' AS notes FROM ch""")
def _report_consistency(c):
    return q.report_consistency(_layer_totals(c))


def _layer_totals(c):
    from starlayer.operators import layers
    dwd = c.dwd_table()
    win = dwd.filter(F.col("order_date") >= F.date_sub(F.lit(c.as_of), 30))
    dws = layers.dws_trade_order_1d(dwd, c.as_of, 30)
    dws_all = layers.dws_trade_order_1d(dwd, c.as_of, None)
    return q.layer_totals(win, dws, layers.ads_trade_summary(dws),
                          layers.dwt_user_topic(dws_all, c.as_of), dws_all)


@register("quality_report", _CONSISTENCY_SQL + """
, n AS (SELECT (SELECT COUNT(*) FROM trade_order) AS s, (SELECT COUNT(*) FROM dwd) AS tt),
acc AS (SELECT 'accuracy' AS name, ROUND(GREATEST(0, 100 - ABS(s - tt) * 100.0 / GREATEST(s, 1))::DOUBLE, 2) AS score,
        GREATEST(0, 100 - ABS(s - tt) * 100.0 / GREATEST(s, 1)) >= 80 AS passed,
        'source ' || s || ' rows vs target ' || tt || ' rows, diff ' || ABS(s - tt) AS notes FROM n),
per AS (SELECT order_id, COUNT(*) AS n FROM dwd GROUP BY order_id),
k AS (SELECT COALESCE(SUM(CASE WHEN order_id IS NULL THEN n END), 0) AS nn,
             COUNT(CASE WHEN n > 1 THEN 1 END) AS dd FROM per),
com AS (SELECT 'completeness' AS name,
        ROUND((CASE WHEN nn = 0 AND dd = 0 THEN 100.0 ELSE GREATEST(0.0, 100.0 - (nn + dd) * 5.0) END)::DOUBLE, 2)
          AS score,
        (CASE WHEN nn = 0 AND dd = 0 THEN 100.0 ELSE GREATEST(0.0, 100.0 - (nn + dd) * 5.0) END) >= 90 AS passed,
        'null keys: ' || nn || ', duplicate keys: ' || dd AS notes FROM k),
con AS (SELECT 'consistency' AS name, ROUND(held * 100.0 / 6, 2)::DOUBLE AS score,
        held * 100.0 / 6 >= 95 AS passed, held || ' of 6 layer checks hold' AS notes FROM ch),
u AS (SELECT * FROM acc UNION ALL SELECT * FROM com UNION ALL SELECT * FROM con)
SELECT * FROM u
UNION ALL SELECT 'overall', NULL, COALESCE(BOOL_AND(passed), FALSE), COUNT(score) || ' dimensions scored' FROM u""")
def _quality_report(c):
    acc = q.report_accuracy(q.recon_count(c.trade_order(), c.dwd_table()))
    com = q.report_completeness(q.completeness_counts(c.dwd_table()))
    con = q.report_consistency(_layer_totals(c))
    return q.quality_report(acc, com, con)


@register("quality_report_full")
def _quality_report_full(c):
    """All four dimensions including the timed one (rows-only check)."""
    acc = q.report_accuracy(q.recon_count(c.trade_order(), c.dwd_table()))
    com = q.report_completeness(q.completeness_counts(c.dwd_table()))
    con = q.report_consistency(_layer_totals(c))
    return q.quality_report(acc, com, con, q.report_performance(c.dwd_table()))
