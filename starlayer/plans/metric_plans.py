"""Registered queries: metric system and domain KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.operators import metrics as m
from starlayer.plans import context as cx
from starlayer.plans.catalog import register
from starlayer.plans.sqlbits import ORDER_CHAIN, ORDERS_AS_OF, LI_MONEY, R, D, with_

GMV = m.AtomicMetric("gmv", "order", "SUM", "order_amount")
ORDERS = m.AtomicMetric("orders", "order", "COUNT", "order_id")
BUYERS = m.AtomicMetric("buyers", "order", "COUNT_DISTINCT", "user_id")
AVG_AMT = m.AtomicMetric("avg_amount", "order", "AVG", "order_amount")
MAX_AMT = m.AtomicMetric("max_amount", "order", "MAX", "order_amount")
MIN_AMT = m.AtomicMetric("min_amount", "order", "MIN", "order_amount")
PAID = ("paid", "order_status = 'paid'")


@register("metric_atomic", with_(*ORDER_CHAIN) + f"""
SELECT merchant_id, {D('SUM(order_amount)')} AS gmv, COUNT(order_id) AS orders,
       COUNT(DISTINCT user_id) AS buyers, {R('SUM(order_amount)', 'COUNT(order_amount)', 2)} AS avg_amount,
       {D('MAX(order_amount)')} AS max_amount, {D('MIN(order_amount)')} AS min_amount
FROM dwd GROUP BY merchant_id""")
def _metric_atomic(c):
    return m.metric_atomic(c.dwd(), ["merchant_id"], [GMV, ORDERS, BUYERS, AVG_AMT, MAX_AMT, MIN_AMT])


@register("metric_derived", with_(*ORDER_CHAIN) + f"""
SELECT merchant_id, {D('SUM(CASE WHEN order_status = ' + "'paid'" + ' THEN order_amount END)')} AS "30d_paid_gmv"
FROM dwd WHERE order_date <= {ORDERS_AS_OF} AND order_date >= {ORDERS_AS_OF} - INTERVAL 29 DAY
GROUP BY merchant_id""")
def _metric_derived(c):
    return m.metric_derived(c.dwd_window(30), ["merchant_id"], m.DerivedMetric(GMV, (PAID,), "30d"), c.as_of)


def _in(p):
    return {"1d": f"order_date = {ORDERS_AS_OF}",
            "7d": f"order_date >= {ORDERS_AS_OF} - INTERVAL 6 DAY AND order_date <= {ORDERS_AS_OF}",
            "30d": f"order_date >= {ORDERS_AS_OF} - INTERVAL 29 DAY AND order_date <= {ORDERS_AS_OF}",
            "mtd": f"order_date >= DATE '2001-08-01' AND order_date <= {ORDERS_AS_OF}",
            "ytd": f"order_date >= DATE '2001-01-01' AND order_date <= {ORDERS_AS_OF}",
            "td": f"order_date <= {ORDERS_AS_OF}"}[p]


@register("metric_set_one_pass", with_(*ORDER_CHAIN) + f"""
SELECT merchant_id, order_status,
  {D(f"SUM(CASE WHEN {_in('7d')} THEN order_amount END)")} AS "7d_gmv",
  COUNT(CASE WHEN {_in('30d')} THEN order_id END) AS "30d_orders",
  COUNT(DISTINCT CASE WHEN {_in('ytd')} THEN user_id END) AS ytd_buyers,
  {R(f"SUM(CASE WHEN {_in('td')} AND order_amount >= 50000 THEN order_amount END)",
     f"COUNT(CASE WHEN {_in('td')} AND order_amount >= 50000 THEN order_amount END)", 2)} AS td_large_avg_amount,
  {D(f"MAX(CASE WHEN {_in('td')} THEN order_amount END)")} AS td_max_amount
FROM dwd WHERE order_date <= {ORDERS_AS_OF} GROUP BY merchant_id, order_status""")
def _metric_set_one_pass(c):
    ms = [m.DerivedMetric(GMV, (), "7d"), m.DerivedMetric(ORDERS, (), "30d"),
          m.DerivedMetric(BUYERS, (), "ytd"),
          m.DerivedMetric(AVG_AMT, (("large", "order_amount >= 50000"),), "td"),
          m.DerivedMetric(MAX_AMT, (), "td")]
    return m.metric_set_one_pass(c.dwd(), ["merchant_id", "order_status"], ms, c.as_of)


@register("metric_periods", with_(*ORDER_CHAIN) + f"""
SELECT merchant_id, {D(f"SUM(CASE WHEN {_in('1d')} THEN order_amount END)")} AS "1d_gmv",
  {D(f"SUM(CASE WHEN {_in('7d')} THEN order_amount END)")} AS "7d_gmv",
  {D(f"SUM(CASE WHEN {_in('mtd')} THEN order_amount END)")} AS mtd_gmv,
  {D(f"SUM(CASE WHEN {_in('td')} THEN order_amount END)")} AS td_gmv
FROM dwd WHERE order_date <= {ORDERS_AS_OF} GROUP BY merchant_id""")
def _metric_periods(c):
    return m.metric_periods(c.dwd(), ["merchant_id"], GMV, c.as_of)


@register("kpi_pv_uv", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS pv, COUNT(DISTINCT user_id) AS uv FROM events
WHERE event_type = 'view' GROUP BY 1""")
def _kpi_pv_uv(c):
    return m.kpi_pv_uv(c.t("events"))


@register("kpi_ctr", f"""
SELECT CAST(ts AS DATE) AS day, COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
       COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS views,
       {R("COUNT(CASE WHEN event_type = 'click' THEN 1 END)", "COUNT(CASE WHEN event_type = 'view' THEN 1 END)", 4)}
         AS ctr
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def _kpi_ctr(c):
    return m.kpi_ctr(c.t("events"))


@register("kpi_dau_mau", """
SELECT CAST(ts AS DATE) AS period, COUNT(DISTINCT user_id) AS active_users, 'day' AS grain FROM events GROUP BY 1
UNION ALL
SELECT CAST(date_trunc('month', ts) AS DATE), COUNT(DISTINCT user_id), 'month' FROM events GROUP BY 1""")
def _kpi_dau_mau(c):
    return m.kpi_dau_mau(c.t("events"))


@register("kpi_retention", f"""
WITH act AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
f AS (SELECT user_id, MIN(day) AS cohort_date FROM act GROUP BY user_id),
j AS (SELECT act.user_id, cohort_date, date_diff('day', cohort_date, day) AS k FROM act JOIN f USING (user_id)),
g AS (SELECT cohort_date, COUNT(DISTINCT CASE WHEN k = 0 THEN user_id END) AS cohort_size,
             COUNT(DISTINCT CASE WHEN k = 1 THEN user_id END) AS retained_d1,
             COUNT(DISTINCT CASE WHEN k = 3 THEN user_id END) AS retained_d3,
             COUNT(DISTINCT CASE WHEN k = 7 THEN user_id END) AS retained_d7 FROM j GROUP BY cohort_date)
SELECT *, {R('retained_d1', 'cohort_size', 4)} AS retention_d1, {R('retained_d3', 'cohort_size', 4)} AS retention_d3,
       {R('retained_d7', 'cohort_size', 4)} AS retention_d7 FROM g""")
def _kpi_retention(c):
    return m.kpi_retention(c.t("events"))


@register("kpi_repurchase_rate", f"""
WITH per AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey, COUNT(*) AS n
             FROM orders GROUP BY ALL),
g AS (SELECT month, COUNT(*) AS buyers, COUNT(CASE WHEN n >= 2 THEN 1 END) AS repeat_buyers FROM per GROUP BY month)
SELECT *, {R('repeat_buyers', 'buyers', 4)} AS repurchase_rate FROM g""")
def _kpi_repurchase_rate(c):
    return m.kpi_repurchase_rate(c.t("orders"))


@register("kpi_refund_rate", with_(LI_MONEY) + f"""
, g AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, COUNT(*) AS lines,
               COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned_lines, SUM(gross) AS amount,
               SUM(CASE WHEN l_returnflag = 'R' THEN gross END) AS returned_amount FROM lim GROUP BY 1)
SELECT month, lines, returned_lines, {D('amount')} AS amount, {D('returned_amount')} AS returned_amount,
       {R('returned_lines', 'lines', 4)} AS line_refund_rate, {R('returned_amount', 'amount', 4)} AS amount_refund_rate
FROM g""")
def _kpi_refund_rate(c):
    return m.kpi_refund_rate(cx.lineitem_money(c))


@register("kpi_conversion_funnel", f"""
WITH v AS (SELECT user_id, MIN(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT e.user_id, MIN(e.ts) AS t1 FROM events e JOIN v ON e.user_id = v.user_id
      WHERE e.event_type = 'click' AND e.ts >= v.t0 GROUP BY e.user_id),
vc AS (SELECT v.user_id, t0, t1 FROM v LEFT JOIN c ON v.user_id = c.user_id),
p AS (SELECT e.user_id, MIN(e.ts) AS t2 FROM events e JOIN vc ON e.user_id = vc.user_id
      WHERE e.event_type = 'purchase' AND e.ts >= vc.t1 GROUP BY e.user_id),
u AS (SELECT vc.*, t2 FROM vc LEFT JOIN p ON vc.user_id = p.user_id),
g AS (SELECT CAST(t0 AS DATE) AS cohort_date, COUNT(t0) AS view_users, COUNT(t1) AS click_users,
             COUNT(t2) AS purchase_users FROM u GROUP BY 1)
SELECT *, {R('click_users', 'view_users', 4)} AS view_to_click_rate,
       {R('purchase_users', 'click_users', 4)} AS click_to_purchase_rate FROM g""")
def _kpi_conversion_funnel(c):
    return m.kpi_conversion_funnel(c.t("events"))


@register("sessions_bounce", f"""
WITH e AS (SELECT user_id, ts, event_id, epoch_us(ts) AS us,
                  LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
f AS (SELECT *, SUM(CASE WHEN prev IS NULL OR us - prev > 1800000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e),
s AS (SELECT user_id, sid, COUNT(*) AS n, CAST(MIN(ts) AS DATE) AS day FROM f GROUP BY user_id, sid),
g AS (SELECT day, COUNT(*) AS sessions, COUNT(CASE WHEN n = 1 THEN 1 END) AS bounces FROM s GROUP BY day)
SELECT day, sessions, bounces, {R('bounces', 'sessions', 4)} AS bounce_rate FROM g""")
def _sessions_bounce(c):
    return m.sessions_bounce(c.t("events"))


@register("new_vs_returning", with_(*ORDER_CHAIN) + f"""
, f AS (SELECT user_id, CAST(date_trunc('month', MIN(order_date)) AS DATE) AS first_month FROM dwd GROUP BY user_id),
j AS (SELECT d.*, CAST(date_trunc('month', order_date) AS DATE) AS month,
             CASE WHEN CAST(date_trunc('month', order_date) AS DATE) = first_month THEN 'new' ELSE 'returning' END
               AS customer_type
      FROM dwd d JOIN f USING (user_id))
SELECT month, customer_type, COUNT(DISTINCT order_no) AS orders, {D('SUM(order_amount)')} AS gmv,
       COUNT(DISTINCT user_id) AS customers FROM j GROUP BY month, customer_type""")
def _new_vs_returning(c):
    return m.new_vs_returning(c.dwd())


@register("average_order_value", with_(*ORDER_CHAIN) + f"""
SELECT order_status, CAST(date_trunc('year', order_date) AS DATE) AS year, {D('SUM(order_amount)')} AS gmv,
       COUNT(DISTINCT order_no) AS orders, {R('SUM(order_amount)', 'COUNT(DISTINCT order_no)', 2)} AS aov
FROM dwd GROUP BY 1, 2""")
def _average_order_value(c):
    d = c.dwd().withColumn("year", F.trunc("order_date", "year"))
    return m.average_order_value(d, ["order_status", "year"])
