"""Registered queries: fact constructions and dimensional join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.operators import clean, facts, joins
from starlayer.operators import dims as dimops
from starlayer.plans import context as cx
from starlayer.plans.catalog import register
from starlayer.operators.snapshots import AccumulatingSnapshot
from starlayer.plans.dim_plans import weights_sql
from starlayer.plans.sqlbits import (
    ORDER_CHAIN, ORDERS_AS_OF, CHANGE_LOG, EVENT_VALUES, SPARSE_DAY, DENSE_DAY, ORDER_LC,
    EVENT_LC, LI_MONEY, ORDER_MS, EVENT_MS, R, D, B, acc_select, versions_sql, with_,
)
from starlayer.session import scratch_dir


@register("fact_transaction", with_(*ORDER_CHAIN) + f"""
SELECT d.order_no, COALESCE(c.c_custkey, -1) AS customer_key, COALESCE(p.p_partkey, -1) AS part_key,
       COALESCE(s.s_suppkey, -1) AS supplier_key, d.created_at, {D('d.order_amount')} AS order_amount,
       CAST(d.created_at AS DATE) AS dt
FROM dwd d LEFT JOIN customer c ON d.user_id = c.c_custkey LEFT JOIN part p ON d.item_id = p.p_partkey
LEFT JOIN supplier s ON d.merchant_id = s.s_suppkey""")
def _fact_transaction(c):
    dims = [(c.t("customer"), "user_id", "c_custkey", "c_custkey", "customer_key"),
            (c.t("part"), "item_id", "p_partkey", "p_partkey", "part_key"),
            (c.t("supplier"), "merchant_id", "s_suppkey", "s_suppkey", "supplier_key")]
    f = clean.dwd_attach_dim_keys(c.dwd(), dims)
    return facts.fact_transaction(f, "order_no", ["customer_key", "part_key", "supplier_key"],
                                  "created_at", ["order_amount"])


def _sparse(c, grain="day"):
    return facts.fact_periodic_sparse(cx.event_values(c), "user_id", "ts", ["value"], "event_id", grain)


@register("fact_periodic_sparse", with_(EVENT_VALUES, SPARSE_DAY) + f"""
SELECT user_id, snapshot_date, {D('value')} AS value, state_ts FROM sp""")
def _fact_periodic_sparse(c):
    return _sparse(c)


@register("fact_periodic_dense", with_(EVENT_VALUES, SPARSE_DAY, DENSE_DAY) + f"""
SELECT user_id, snapshot_date, {D('value')} AS value FROM dense""")
def _fact_periodic_dense(c):
    return facts.fact_periodic_dense(_sparse(c), "user_id", ["value"], c.events_as_of)


for _g, _trunc in (("weekly", "week"), ("monthly", "month")):
    def _mk(g, tr):
        @register(f"fact_periodic_{g}", with_(EVENT_VALUES) + f"""
SELECT user_id, CAST(date_trunc('{tr}', ts) AS DATE) AS snapshot_date, {D('value')} AS value, ts AS state_ts
FROM ev QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, date_trunc('{tr}', ts)
                                   ORDER BY ts DESC, event_id DESC) = 1""")
        def _q(c):
            return _sparse(c, tr)
    _mk(_g, _trunc)


def _order_acc(c):
    return facts.fact_accumulating(cx.order_lifecycle_events(c), "order_key", "process", "ts",
                                   cx.ORDER_MILESTONES)


@register("fact_accumulating", with_(ORDER_LC) + acc_select("order_key", ORDER_MS, "olc"))
def _fact_accumulating(c):
    return _order_acc(c)


@register("fact_accumulating_status", with_(ORDER_LC) + f"""
SELECT end_status, COUNT(*) AS lifecycles FROM ({acc_select('order_key', ORDER_MS, 'olc')})
GROUP BY end_status""")
def _fact_accumulating_status(c):
    return _order_acc(c).groupBy("end_status").agg(F.count(F.lit(1)).alias("lifecycles"))


@register("fact_accumulating_upsert", with_(EVENT_LC) + acc_select("user_id", EVENT_MS, "elc"))
def _fact_accumulating_upsert(c):
    """Weekly batches applied in event-time order; equals the full build."""
    ev = c.t("events").select("user_id", "event_type", "ts")
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
    return facts.fact_accumulating_batches(ev, "user_id", "event_type", "ts", cx.EVENT_MILESTONES, cuts,
                                           checkpoint_every=3)


@register("fact_accumulating_by_start", with_(ORDER_LC) + acc_select("order_key", ORDER_MS, "olc"))
def _fact_accumulating_by_start(c):
    """The order snapshot as a table by month of ``start_dt``, built in batches of
    event time, where a batch rewrites only partitions that it changes."""
    ev = cx.order_lifecycle_events(c)
    table = AccumulatingSnapshot(c.spark, scratch_dir(c.spark, "acc_by_start"), "order_key", "process", "ts", cx.ORDER_MILESTONES,
                                 grain="month")
    year = F.year("ts")
    for batch in (year < 1998, (year >= 1998) & (year < 2000), (year >= 2000) | year.isNull()):
        table.apply(ev.where(batch))
    return table.read().select(*_order_acc(c).columns)


@register("fact_aggregated_td", with_(*ORDER_CHAIN) + f"""
SELECT merchant_id,
  COUNT(CASE WHEN order_date >= DATE '2001-08-01' AND order_date <= {ORDERS_AS_OF} THEN 1 END) AS rows_mtd,
  {D(f"SUM(CASE WHEN order_date >= DATE '2001-08-01' AND order_date <= {ORDERS_AS_OF} THEN order_amount END)")}
    AS gmv_mtd,
  COUNT(CASE WHEN order_date >= DATE '2001-01-01' AND order_date <= {ORDERS_AS_OF} THEN 1 END) AS rows_ytd,
  {D(f"SUM(CASE WHEN order_date >= DATE '2001-01-01' AND order_date <= {ORDERS_AS_OF} THEN order_amount END)")}
    AS gmv_ytd,
  COUNT(*) AS rows_td, {D('SUM(order_amount)')} AS gmv_td
FROM dwd WHERE order_date <= {ORDERS_AS_OF} GROUP BY merchant_id""")
def _fact_aggregated_td(c):
    return facts.fact_aggregated_td(c.dwd(), ["merchant_id"], {"gmv": "order_amount"}, c.as_of)


@register("ratio_of_sums", with_(LI_MONEY) + f"""
SELECT l_returnflag, l_linestatus, {D('SUM(disc_amount)')} AS numerator, {D('SUM(gross)')} AS denominator,
       {R('SUM(disc_amount)', 'SUM(gross)', 6)} AS value
FROM lim GROUP BY l_returnflag, l_linestatus""")
def _ratio_of_sums(c):
    return facts.ratio_of_sums(cx.lineitem_money(c), ["l_returnflag", "l_linestatus"], "disc_amount / gross")


@register("ratio_wrong_vs_right", with_(LI_MONEY) + f"""
, rr AS (SELECT *, CAST({R('disc_amount', 'gross', 6)} AS DECIMAL(28,6)) AS r FROM lim)
SELECT l_returnflag, {R('SUM(r)', 'COUNT(r)', 6)} AS avg_of_ratios,
       {R('SUM(disc_amount)', 'SUM(gross)', 6)} AS ratio_of_sums
FROM rr GROUP BY l_returnflag""")
def _ratio_wrong_vs_right(c):
    return facts.ratio_wrong_vs_right(cx.lineitem_money(c), ["l_returnflag"], "disc_amount", "gross")


@register("semi_additive_last", with_(EVENT_VALUES) + f"""
, last AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, user_id, value FROM ev
           QUALIFY ROW_NUMBER() OVER (PARTITION BY date_trunc('week', ts), user_id
                                      ORDER BY ts DESC, event_id DESC) = 1)
SELECT week_start, {D('SUM(value)')} AS closing_value, COUNT(*) AS entities FROM last GROUP BY week_start""")
def _semi_additive_last(c):
    ev = cx.event_values(c).withColumn("week_start", F.date_trunc("week", "ts").cast("date"))
    return facts.semi_additive_last(ev, "user_id", "ts", "value", ["week_start"], "event_id")


@register("semi_additive_avg", with_(EVENT_VALUES, SPARSE_DAY, DENSE_DAY) + f"""
, per AS (SELECT CAST(date_trunc('week', snapshot_date) AS DATE) AS week_start, user_id,
                 SUM(value) AS s, COUNT(value) AS n FROM dense GROUP BY ALL)
SELECT week_start,
       {D(f"SUM(CAST({R('s', 'n', 4)} AS DECIMAL(28,4)))")} AS avg_value_sum,
       COUNT(*) AS entities
FROM per GROUP BY week_start""")
def _semi_additive_avg(c):
    dense = facts.fact_periodic_dense(_sparse(c), "user_id", ["value"], c.events_as_of) \
        .withColumn("week_start", F.date_trunc("week", "snapshot_date").cast("date"))
    return facts.semi_additive_avg(dense, "user_id", "value", ["week_start"])


@register("flow_sum", with_(ORDER_LC) + f"""
, acc AS ({acc_select('order_key', ORDER_MS, 'olc')})
SELECT CAST(date_trunc('month', start_dt) AS DATE) AS start_month,
       {B('SUM(ordered_to_first_ship_sec)')} AS ordered_to_first_ship_sec_sum,
       COUNT(ordered_to_first_ship_sec) AS ordered_to_first_ship_sec_n,
       {B('SUM(first_ship_to_last_ship_sec)')} AS first_ship_to_last_ship_sec_sum,
       COUNT(first_ship_to_last_ship_sec) AS first_ship_to_last_ship_sec_n
FROM acc GROUP BY 1""")
def _flow_sum(c):
    a = _order_acc(c).withColumn("start_month", F.trunc("start_dt", "month"))
    return facts.flow_sum(a, ["start_month"], ["ordered_to_first_ship_sec", "first_ship_to_last_ship_sec"])


@register("derived_measure", with_(LI_MONEY) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, {D('gross')} AS gross, {D('disc_amount')} AS discount_amount,
       {D('gross - disc_amount')} AS net_amount FROM lim""")
def _derived_measure(c):
    li = c.t("lineitem").withColumn("gross", F.col("l_extendedprice").cast("decimal(18,2)"))
    return facts.derived_measure(li, "gross", "l_discount").select(
        "l_orderkey", "l_linenumber", "l_partkey", "gross", "discount_amount", "net_amount")


@register("fact_per_process", f"""
SELECT event_id, ts, user_id, value, event_type FROM events""")
def _fact_per_process(c):
    ev = c.t("events").select("event_id", "ts", "user_id", "value", "event_type")
    out = facts.fact_per_process(ev, "event_type", scratch_dir(c.spark, "fact_per_process"))
    return out.select("event_id", "ts", "user_id", "value", "event_type")


# --- joins -------------------------------------------------------------------

@register("join_star", with_(*ORDER_CHAIN) + f"""
SELECT r.r_name, c.c_mktsegment, p.p_brand, COUNT(*) AS order_lines, {D('SUM(d.order_amount)')} AS gmv
FROM dwd d JOIN customer c ON d.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON d.item_id = p.p_partkey
JOIN supplier s ON d.merchant_id = s.s_suppkey
GROUP BY r.r_name, c.c_mktsegment, p.p_brand""")
def _join_star(c):
    cust = c.t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nat = c.t("nation").select("n_nationkey", "n_regionkey")
    reg = c.t("region").select("r_regionkey", "r_name")
    geo = cust.join(nat, cust.c_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
    f = joins.join_star(c.dwd(), [(geo, "user_id", "c_custkey"),
                                  (c.t("part").select("p_partkey", "p_brand"), "item_id", "p_partkey"),
                                  (c.t("supplier").select("s_suppkey"), "merchant_id", "s_suppkey")])
    return f.groupBy("r_name", "c_mktsegment", "p_brand").agg(
        F.count(F.lit(1)).alias("order_lines"), F.sum("order_amount").alias("gmv"))


@register("join_zipper_asof", with_(CHANGE_LOG) + f"""
, z AS {versions_sql('change_log', 'customer_key', 'change_date', ['priority'], 'start_date', 'end_date', False)}
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, z.priority AS priority_then, z.start_date
FROM orders o LEFT JOIN z ON o.o_custkey = z.customer_key
  AND z.start_date <= CAST(o.o_orderdate AS DATE) AND CAST(o.o_orderdate AS DATE) < z.end_date""")
def _join_zipper_asof(c):
    z = dimops.zipper_build(cx.change_log(c), "customer_key", "change_date", ["priority"])
    o = c.t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = joins.join_zipper_asof(o, z, "o_custkey", "customer_key", "o_orderdate")
    return j.select("o_orderkey", "o_custkey", "o_orderdate", F.col("priority").alias("priority_then"),
                    "start_date")


_BRIDGE_SQL = f"""bridge AS (
  SELECT l_orderkey, l_partkey, CAST(weight AS DECIMAL(20,12)) AS weight FROM (
    {weights_sql("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "l_orderkey", "l_partkey")}))"""


def _bridge(c):
    return dimops.bridge_build(c.t("lineitem"), "l_orderkey", "l_partkey")


@register("join_bridge_weighted", with_(_BRIDGE_SQL) + f"""
SELECT p.p_brand, {D('SUM(CAST(o.o_totalprice AS DECIMAL(18,2)) * b.weight)')} AS weighted_amount,
       {D('SUM(b.weight)')} AS weighted_count
FROM orders o JOIN bridge b ON o.o_orderkey = b.l_orderkey JOIN part p ON b.l_partkey = p.p_partkey
GROUP BY p.p_brand""")
def _join_bridge_weighted(c):
    return joins.join_bridge_weighted(c.t("orders").select("o_orderkey", "o_totalprice"), _bridge(c),
                                      c.t("part").select("p_partkey", "p_brand"), "o_orderkey",
                                      "l_orderkey", "l_partkey", "p_partkey", ["p_brand"], "o_totalprice")


@register("drill_across", with_(*ORDER_CHAIN) + f"""
, a AS (SELECT o_custkey AS customer_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               COUNT(*) AS order_cnt, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS order_total
        FROM orders GROUP BY ALL),
b AS (SELECT user_id AS customer_key, CAST(date_trunc('month', order_date) AS DATE) AS month,
             COUNT(*) AS line_cnt, SUM(order_amount) AS line_gmv FROM dwd GROUP BY ALL)
SELECT COALESCE(a.customer_key, b.customer_key) AS customer_key, COALESCE(a.month, b.month) AS month,
       a.order_cnt, {D('a.order_total')} AS order_total, b.line_cnt, {D('b.line_gmv')} AS line_gmv
FROM a FULL OUTER JOIN b ON a.customer_key = b.customer_key AND a.month = b.month""")
def _drill_across(c):
    o = c.t("orders").withColumn("_m", F.trunc(F.col("o_orderdate").cast("date"), "month"))
    d = c.dwd().withColumn("_m", F.trunc("order_date", "month"))
    return joins.drill_across([
        (o, ["o_custkey", "_m"], {"order_cnt": F.count(F.lit(1)),
                                  "order_total": F.sum(F.col("o_totalprice").cast("decimal(18,2)"))}),
        (d, ["user_id", "_m"], {"line_cnt": F.count(F.lit(1)), "line_gmv": F.sum("order_amount")}),
    ], ["customer_key", "month"])
