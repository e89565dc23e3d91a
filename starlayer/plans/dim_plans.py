"""Registered queries: dimension constructions and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.operators import dims as d
from starlayer.operators import hierarchy as h
from starlayer.plans import context as cx
from starlayer.plans.catalog import register
from starlayer.session import scratch_dir
from starlayer.sources.sinks import sink_overwrite_table
from starlayer.plans.sqlbits import (
    ORDER_CHAIN, CHANGE_LOG, PART_EDGES, CLOSURE, D, B, versions_sql, with_,
)

_ATTRS = ["priority"]


def _log(c):
    return cx.change_log(c)


@register("scd1_overwrite", with_(CHANGE_LOG) + """
SELECT customer_key, priority, change_date AS updated_date FROM change_log
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_key ORDER BY change_date DESC) = 1""")
def _scd1(c):
    return d.scd1_overwrite(_log(c), "customer_key", "change_date", _ATTRS)


_SCD2_SQL = with_(CHANGE_LOG) + "SELECT * FROM " + versions_sql("change_log", "customer_key", "change_date", _ATTRS)


@register("scd2_build", _SCD2_SQL)
def _scd2_build(c):
    return d.scd2_build(_log(c), "customer_key", "change_date", _ATTRS)


@register("scd2_merge", _SCD2_SQL)
def _scd2_merge(c):
    """Batches cut at 1997-01-01, 1999-01-01, 2001-01-01 applied in order;
    equals the full build (the oracle)."""
    log = _log(c)
    cuts = ["1997-01-01", "1999-01-01", "2001-01-01"]
    dc = F.col("change_date")
    dim = d.scd2_build(log.filter(dc < F.lit(cuts[0]).cast("date")), "customer_key", "change_date", _ATTRS)
    bounds = cuts + [None]
    for lo, hi in zip(bounds, bounds[1:]):
        # each batch is a daily job: the dimension it reads is the stored
        # table of the previous run (a new folder per version)
        dim = sink_overwrite_table(dim, scratch_dir(c.spark, "scd2_dim"))
        pred = dc >= F.lit(lo).cast("date")
        if hi is not None:
            pred = pred & (dc < F.lit(hi).cast("date"))
        dim = d.scd2_merge(dim, log.filter(pred), "customer_key", "change_date", _ATTRS)
    return dim


@register("scd3_prev", with_(CHANGE_LOG) + f"""
, v AS {versions_sql('change_log', 'customer_key', 'change_date', _ATTRS, current=False)}
SELECT customer_key, priority AS current_priority, previous_priority, effective_date AS changed_date
FROM (SELECT *, LAG(priority) OVER (PARTITION BY customer_key ORDER BY effective_date) AS previous_priority
      FROM v)
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_key ORDER BY effective_date DESC) = 1""")
def _scd3(c):
    return d.scd3_prev(_log(c), "customer_key", "change_date", "priority")


_ZIP = versions_sql("change_log", "customer_key", "change_date", _ATTRS, "start_date", "end_date", False)


def _zipper(c):
    return d.zipper_build(_log(c), "customer_key", "change_date", _ATTRS)


@register("zipper_build", with_(CHANGE_LOG) + "SELECT * FROM " + _ZIP)
def _zipper_build(c):
    return _zipper(c)


@register("zipper_snapshot_at", with_(CHANGE_LOG) + f"""
SELECT * FROM {_ZIP} WHERE start_date <= DATE '2000-01-01' AND DATE '2000-01-01' < end_date""")
def _zipper_snapshot_at(c):
    return d.zipper_snapshot_at(_zipper(c), "2000-01-01")


@register("zipper_check", with_(CHANGE_LOG) + f"""
, z AS (SELECT *, LEAD(start_date) OVER (PARTITION BY customer_key ORDER BY start_date, end_date) AS nxt
        FROM {_ZIP})
SELECT customer_key, COUNT(*) AS versions, COUNT(CASE WHEN nxt < end_date THEN 1 END) AS overlaps,
       COUNT(CASE WHEN nxt > end_date THEN 1 END) AS gaps,
       COUNT(CASE WHEN end_date = DATE '9999-12-31' THEN 1 END) AS open_rows,
       COUNT(CASE WHEN nxt < end_date THEN 1 END) = 0 AND COUNT(CASE WHEN nxt > end_date THEN 1 END) = 0
         AND COUNT(CASE WHEN end_date = DATE '9999-12-31' THEN 1 END) = 1 AS ok
FROM z GROUP BY customer_key""")
def _zipper_check(c):
    return d.zipper_check(_zipper(c), "customer_key")


_FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_JUNK_SQL = """junk AS (
  SELECT ROW_NUMBER() OVER (ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST,
                                     l_linenumber NULLS FIRST) AS junk_id,
         l_returnflag, l_linestatus, l_linenumber
  FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem))"""


def _junk(c):
    return d.junk_build(c.t("lineitem"), _FLAGS)


@register("junk_build", with_(_JUNK_SQL) + "SELECT * FROM junk")
def _junk_build(c):
    return _junk(c)


@register("junk_attach", with_(_JUNK_SQL) + """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_quantity, j.junk_id
FROM lineitem l LEFT JOIN junk j ON l.l_returnflag IS NOT DISTINCT FROM j.l_returnflag
 AND l.l_linestatus IS NOT DISTINCT FROM j.l_linestatus AND l.l_linenumber IS NOT DISTINCT FROM j.l_linenumber""")
def _junk_attach(c):
    li = c.t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", *_FLAGS)
    return d.junk_attach(li, _junk(c), _FLAGS)


def _bands():
    # Account-balance band edges and labels.
    return {"segment": F.col("c_mktsegment"),
            "balance_band": d.band("c_acctbal", [0, 2500, 7500], ["negative", "low", "mid", "high"])}


_BAND_SQL = ("CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 2500 THEN 'low' "
             "WHEN c_acctbal < 7500 THEN 'mid' ELSE 'high' END")
_MINI_SQL = f"""mini AS (
  SELECT ROW_NUMBER() OVER (ORDER BY segment NULLS FIRST, balance_band NULLS FIRST) AS mini_id,
         segment, balance_band
  FROM (SELECT DISTINCT c_mktsegment AS segment, {_BAND_SQL} AS balance_band FROM customer))"""


def _mini(c):
    return d.mini_build(c.t("customer"), "c_custkey", _bands())


@register("mini_build", with_(_MINI_SQL) + "SELECT * FROM mini")
def _mini_build(c):
    return _mini(c)


@register("mini_attach", with_(_MINI_SQL) + f"""
SELECT o.o_orderkey, o.o_custkey, m.mini_id
FROM orders o LEFT JOIN (SELECT c_custkey, c_mktsegment AS segment, {_BAND_SQL} AS balance_band FROM customer) cb
  ON o.o_custkey = cb.c_custkey
LEFT JOIN mini m ON cb.segment = m.segment AND cb.balance_band = m.balance_band""")
def _mini_attach(c):
    o = c.t("orders").select("o_orderkey", "o_custkey")
    return d.mini_attach(o, c.t("customer"), "o_custkey", "c_custkey", _bands(), _mini(c))


def weights_sql(src: str, g: str, m: str, extra: str = "") -> str:
    """Equal weights by largest remainder: 10^-4 or the power of ten below a
    thousandth of the share is the unit, the last members take the units left over."""
    return f"""SELECT {g}, {m}{extra},
  CAST((units // n + CASE WHEN place > n - units % n THEN 1 ELSE 0 END) * (1000000000000 // units) AS DECIMAL(30,0))
  * CAST('0.000000000001' AS DECIMAL(12,12)) AS weight
FROM (SELECT *, CAST(POW(10, LEAST(12, GREATEST(4, LENGTH(CAST(n AS VARCHAR)) + 3))) AS BIGINT) AS units
      FROM (SELECT *, COUNT(*) OVER (PARTITION BY {g}) AS n, ROW_NUMBER() OVER (PARTITION BY {g} ORDER BY {m}) AS place FROM {src}))"""


def _weights_sql(src: str, g: str, m: str, extra: str = "") -> str:
    return f"SELECT {g}, {m}{extra}, {D('weight')} AS weight FROM ({weights_sql(src, g, m, extra)})"


@register("bridge_build", _weights_sql("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)",
                                       "l_orderkey", "l_partkey"))
def _bridge_build(c):
    return d.bridge_build(c.t("lineitem"), "l_orderkey", "l_partkey")


@register("bridge_build_m2n", with_(*ORDER_CHAIN) + _weights_sql(
    "(SELECT user_id, item_id, MIN(order_date) AS effective_date FROM dwd GROUP BY user_id, item_id)",
    "user_id", "item_id", ", effective_date"))
def _bridge_build_m2n(c):
    return d.bridge_build_m2n(c.dwd(), "user_id", "item_id", "order_date")


_ARR_SQL = """arr AS (
  SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(event_type))) AS event_types
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def _arr(c):
    e = c.t("events").withColumn("day", F.col("ts").cast("date"))
    return d.array_field_build(e, ["user_id", "day"], "event_type", "event_types")


@register("array_field_build", with_(_ARR_SQL) + "SELECT * FROM arr")
def _array_field_build(c):
    return _arr(c)


@register("array_field_filter", with_(_ARR_SQL) + "SELECT * FROM arr WHERE list_contains(event_types, 'purchase')")
def _array_field_filter(c):
    return d.array_field_filter(_arr(c), "event_types", "purchase")


@register("array_field_json_filter", with_(_ARR_SQL) + """
SELECT user_id, day, CAST(to_json(event_types) AS VARCHAR) AS event_types FROM arr WHERE list_contains(event_types, 'purchase')""")
def _array_field_json_filter(c):
    """The short field kept as a JSON array, filtered by what it contains."""
    return d.array_from_json_filter(_arr(c).withColumn("event_types", F.to_json("event_types")), "event_types", "purchase")


@register("dim_date", """
WITH b AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders),
cal AS (SELECT CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month, weekofyear(date) AS iso_week,
       isodow(date) AS iso_dow, CAST(date_trunc('week', date) AS DATE) AS week_start,
       CAST(date_trunc('month', date) AS DATE) AS month_start, isodow(date) >= 6 AS is_weekend
FROM cal""")
def _dim_date(c):
    b = c.t("orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("lo"),
                          F.max(F.col("o_orderdate").cast("date")).alias("hi"))
    return d.dim_date(b)


_CONF_SRC = """src AS (
  SELECT o_custkey AS customer_key, o_orderpriority AS last_activity, CAST(o_orderdate AS DATE) AS seen_at,
         'orders' AS source FROM orders
  UNION ALL
  SELECT o.o_custkey, 'RETURN ' || l.l_returnflag, CAST(l.l_shipdate AS DATE), 'returns'
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R')"""


def _conf_sources(c):
    o = c.t("orders").select(F.col("o_custkey").alias("customer_key"),
                             F.col("o_orderpriority").alias("last_activity"),
                             F.col("o_orderdate").cast("date").alias("seen_at"), F.lit("orders").alias("source"))
    li = c.t("lineitem").filter(F.col("l_returnflag") == "R")
    oo = c.t("orders").select("o_orderkey", "o_custkey")
    r = li.join(oo, li.l_orderkey == oo.o_orderkey).select(
        F.col("o_custkey").alias("customer_key"),
        F.concat(F.lit("RETURN "), F.col("l_returnflag")).alias("last_activity"),
        F.col("l_shipdate").cast("date").alias("seen_at"), F.lit("returns").alias("source"))
    return o, r


_CONF_PICK = """QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_key
                             ORDER BY seen_at DESC, source DESC, last_activity DESC NULLS LAST) = 1"""


@register("dim_conformed", with_(_CONF_SRC) + "SELECT * FROM src " + _CONF_PICK)
def _dim_conformed(c):
    o, r = _conf_sources(c)
    return d.dim_conformed([o, r], "customer_key", "seen_at", ["last_activity"])


@register("dim_conformed_increment", with_(_CONF_SRC) + "SELECT * FROM src " + _CONF_PICK)
def _dim_conformed_increment(c):
    """Full build up to 2000-01-01, then the later rows applied as an increment
    — equals the full build."""
    o, r = _conf_sources(c)
    cut = F.lit("2000-01-01").cast("date")
    base = d.dim_conformed([o.filter(F.col("seen_at") < cut), r.filter(F.col("seen_at") < cut)],
                           "customer_key", "seen_at", ["last_activity"])
    return d.dim_conformed([base, o.filter(F.col("seen_at") >= cut), r.filter(F.col("seen_at") >= cut)],
                           "customer_key", "seen_at", ["last_activity"])


# --- hierarchies ---------------------------------------------------------------

_GEO_SQL = """geo AS (
  SELECT 'R' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)"""


@register("hier_flatten", with_(_GEO_SQL) + """
, w AS (SELECT g0.node_id, g0.node_id AS a0, g1.node_id AS a1, g2.node_id AS a2, g3.node_id AS a3,
               g3.parent_id AS up
        FROM geo g0 LEFT JOIN geo g1 ON g0.parent_id = g1.node_id LEFT JOIN geo g2 ON g1.parent_id = g2.node_id
        LEFT JOIN geo g3 ON g2.parent_id = g3.node_id),
p AS (SELECT node_id, list_reverse(list_filter([a0, a1, a2, a3], lambda x: x IS NOT NULL)) AS path, up FROM w)
SELECT node_id, len(path) AS depth, path[1] AS level_1, path[2] AS level_2, path[3] AS level_3,
       path[4] AS level_4, up IS NOT NULL AS deeper_than_k FROM p""")
def _hier_flatten(c):
    return h.hier_flatten(cx.geo_edges(c), depth=4)


@register("hier_flatten_deep", with_(PART_EDGES).replace("WITH ", "WITH RECURSIVE ") + """
, walk AS (SELECT node_id, [node_id] AS path FROM pe WHERE parent_id IS NULL
           UNION ALL SELECT e.node_id, list_append(w.path, e.node_id)
                     FROM pe e JOIN walk w ON e.parent_id = w.node_id)
SELECT node_id, len(path) AS depth, path[1] AS level_1, path[2] AS level_2, path[3] AS level_3,
       path[4] AS level_4, len(path) > 4 AS deeper_than_k FROM walk""")
def _hier_flatten_deep(c):
    """Nodes far below the last level keep their root."""
    return h.hier_flatten(cx.part_edges(c), depth=4)


def _closure(c):
    return h.hier_closure(cx.part_edges(c))


@register("hier_closure", with_(PART_EDGES).replace("WITH ", "WITH RECURSIVE ") + ", " + CLOSURE + """
SELECT ancestor, descendant, distance FROM clo""")
def _hier_closure(c):
    return _closure(c)


_PATH_SQL = with_(PART_EDGES).replace("WITH ", "WITH RECURSIVE ") + ", " + CLOSURE + """
, paths AS (SELECT descendant AS node_id,
                   '/' || string_agg(CAST(ancestor AS VARCHAR), '/' ORDER BY distance DESC) || '/' AS path
            FROM clo GROUP BY descendant)
"""


@register("hier_path", _PATH_SQL + "SELECT * FROM paths")
def _hier_path(c):
    return h.hier_path(_closure(c))


@register("hier_path_filter", _PATH_SQL + "SELECT * FROM paths WHERE starts_with(path, '/1/2/')")
def _hier_path_filter(c):
    return h.hier_path_filter(h.hier_path(_closure(c)), "/1/2/")


_ROLLUP_SQL = f"""
, pre AS (SELECT l_partkey, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS q,
                 SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS g, COUNT(*) AS n FROM lineitem GROUP BY l_partkey),
r AS (SELECT clo.ancestor, SUM(q) AS quantity, SUM(g) AS gross, SUM(n) AS fact_rows,
             COUNT(*) AS descendants_with_facts
      FROM clo JOIN pre ON clo.descendant = pre.l_partkey GROUP BY clo.ancestor)
"""


def _rollup(c, clo=None):
    li = c.t("lineitem").select("l_partkey", F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
                                F.col("l_extendedprice").cast("decimal(18,2)").alias("gross"))
    return h.hier_rollup(li, clo if clo is not None else _closure(c), "l_partkey", {"quantity": "qty", "gross": "gross"})


@register("hier_rollup", with_(PART_EDGES).replace("WITH ", "WITH RECURSIVE ") + ", " + CLOSURE + _ROLLUP_SQL + f"""
SELECT ancestor, {D('quantity')} AS quantity, {D('gross')} AS gross, {B('fact_rows')} AS fact_rows,
       descendants_with_facts FROM r""")
def _hier_rollup(c):
    return _rollup(c)


@register("join_hierarchy_bridge", with_(PART_EDGES).replace("WITH ", "WITH RECURSIVE ") + ", " + CLOSURE
          + _ROLLUP_SQL + f"""
, dep AS (SELECT descendant AS node, MAX(distance) + 1 AS depth FROM clo GROUP BY descendant)
SELECT r.ancestor, dep.depth, {D('quantity')} AS quantity, {D('gross')} AS gross, {B('fact_rows')} AS fact_rows
FROM r JOIN dep ON r.ancestor = dep.node WHERE dep.depth <= 3""")
def _join_hierarchy_bridge(c):
    """Totals of the top three levels of the part hierarchy through the closure."""
    clo = _closure(c)
    r = _rollup(c, clo)
    dep = h.hier_depth(clo).withColumnRenamed("descendant", "ancestor")
    return (r.join(dep, "ancestor").filter(F.col("depth") <= 3)
            .select("ancestor", "depth", "quantity", "gross", "fact_rows"))
