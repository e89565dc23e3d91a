"""DuckDB SQL fragments for the oracle side (views of the driver tables are
pre-registered under their table names)."""

from __future__ import annotations

ORDERS_AS_OF = "DATE '2001-08-01'"
EVENTS_AS_OF = "DATE '2024-01-30'"


def R(num: str, den: str, scale: int = 2) -> str:
    """ROUND(num / NULLIF(den, 0), scale) with the division done in DOUBLE."""
    return f"ROUND(CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0), {scale})"


def D(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def B(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


TRADE_ORDER = """trade_order AS (
  SELECT
    CASE WHEN l.l_orderkey % 97 = 0 THEN NULL
         ELSE CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) END AS order_id,
    o.o_custkey AS user_id,
    l.l_partkey AS item_id,
    l.l_suppkey AS merchant_id,
    CAST(o.o_orderdate AS DATE) AS order_date,
    CAST(CASE WHEN l.l_partkey % 53 = 0 THEN -l.l_extendedprice ELSE l.l_extendedprice END
         AS DECIMAL(18,2)) AS order_amount,
    CASE o.o_orderstatus WHEN 'F' THEN ' PAID' WHEN 'O' THEN 'Shipped ' WHEN 'P' THEN 'pending' END
      AS order_status,
    'NO' || LPAD(CAST(l.l_orderkey AS VARCHAR), CAST(GREATEST(8, LENGTH(CAST(l.l_orderkey AS VARCHAR))) AS INTEGER), '0') AS order_no,
    l.l_shipdate AS created_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

STD = """std AS (
  SELECT order_id, user_id, item_id, merchant_id, CAST(order_date AS DATE) AS order_date,
         CAST(order_amount AS DECIMAL(18,2)) AS order_amount,
         LOWER(TRIM(order_status)) AS order_status, order_no, created_at
  FROM trade_order)"""

DEDUP_ORDER = ("created_at DESC NULLS LAST, item_id ASC NULLS LAST, merchant_id ASC NULLS LAST, "
               "order_amount ASC NULLS LAST")

DWD = f"""dwd AS (
  SELECT * FROM std
  WHERE order_id IS NOT NULL AND order_amount >= 0
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY {DEDUP_ORDER}) = 1)"""


def dws_cte(name: str = "dws", window_days: int | None = 30, src: str = "dwd") -> str:
    where = "" if window_days is None else \
        f"WHERE order_date >= {ORDERS_AS_OF} - INTERVAL {window_days} DAY"
    return f"""{name} AS (
  SELECT order_date, user_id, merchant_id,
         COUNT(DISTINCT order_id) AS order_cnt,
         SUM(order_amount) AS gmv,
         {R('SUM(order_amount)', 'COUNT(order_amount)', 2)} AS avg_order_amount,
         COUNT(DISTINCT CASE WHEN order_status = 'paid' THEN order_id END) AS paid_order_cnt
  FROM {src} {where}
  GROUP BY order_date, user_id, merchant_id)"""


def ads_cte(name: str = "ads", src: str = "dws") -> str:
    return f"""{name} AS (
  SELECT order_date, merchant_id,
         CAST(SUM(order_cnt) AS BIGINT) AS order_cnt,
         SUM(gmv) AS gmv,
         CAST(SUM(paid_order_cnt) AS BIGINT) AS paid_order_cnt,
         {R('SUM(paid_order_cnt) * 100', 'SUM(order_cnt)', 2)} AS paid_rate,
         {R('SUM(gmv)', 'SUM(order_cnt)', 2)} AS avg_order_amount
  FROM {src} GROUP BY order_date, merchant_id)"""


def dwt_cte(name: str = "dwt", src: str = "dws_all", subject: str = "user_id",
            date_col: str = "order_date") -> str:
    return f"""{name} AS (
  SELECT {subject}, COUNT(DISTINCT {date_col}) AS active_days,
         CAST(SUM(order_cnt) AS BIGINT) AS lifetime_order_cnt,
         SUM(gmv) AS lifetime_gmv, MAX({date_col}) AS last_order_date,
         {ORDERS_AS_OF} AS dt
  FROM {src} GROUP BY {subject})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORDER_CHAIN = (TRADE_ORDER, STD, DWD)


CHANGE_LOG = """change_log AS (
  SELECT o_custkey AS customer_key, CAST(o_orderdate AS DATE) AS change_date, o_orderpriority AS priority
  FROM orders
  QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1)"""

EVENT_VALUES = """ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events)"""

SPARSE_DAY = """sp AS (
  SELECT user_id, CAST(ts AS DATE) AS snapshot_date, value, ts AS state_ts FROM ev
  QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1)"""

DENSE_DAY = f"""dense AS (
  SELECT user_id, CAST(UNNEST(generate_series(snapshot_date, upto, INTERVAL 1 DAY)) AS DATE) AS snapshot_date,
         value
  FROM (SELECT user_id, snapshot_date, value,
               COALESCE(LEAD(snapshot_date) OVER (PARTITION BY user_id ORDER BY snapshot_date) - 1,
                        {EVENTS_AS_OF}) AS upto
        FROM sp WHERE snapshot_date <= {EVENTS_AS_OF}))"""

ORDER_LC = """olc AS (
  SELECT order_key,
         MIN(CASE WHEN process = 'ordered' THEN ts END) AS ordered_ts,
         MIN(CASE WHEN process = 'ship' THEN ts END) AS first_ship_ts,
         MAX(CASE WHEN process = 'ship' THEN ts END) AS last_ship_ts,
         MIN(CASE WHEN process = 'return' THEN ts END) AS returned_ts
  FROM (SELECT o_orderkey AS order_key, 'ordered' AS process, o_orderdate AS ts FROM orders
        UNION ALL SELECT l_orderkey, 'ship', l_shipdate FROM lineitem
        UNION ALL SELECT l_orderkey, 'return', l_shipdate FROM lineitem WHERE l_returnflag = 'R')
  GROUP BY order_key)"""


def acc_select(key: str, names: list[str], src: str) -> str:
    cols = ", ".join(f"{n}_ts" for n in names)
    durs = ", ".join(f"(epoch_us({b}_ts) - epoch_us({a}_ts)) // 1000000 AS {a}_to_{b}_sec" for a, b in zip(names, names[1:]))
    bad = " OR ".join(f"COALESCE({b}_ts < {a}_ts, FALSE)" for a, b in zip(names, names[1:]))
    allp = " AND ".join(f"{n}_ts IS NOT NULL" for n in names)
    return (f"SELECT {key}, {cols}, {durs}, CASE WHEN {bad} THEN 'abnormal' WHEN {allp} THEN 'complete' "
            f"ELSE 'in_progress' END AS end_status, CAST({names[0]}_ts AS DATE) AS start_dt FROM {src}")


ORDER_MS = ["ordered", "first_ship", "last_ship", "returned"]
EVENT_MS = ["signup", "view", "click", "purchase"]

EVENT_LC = """elc AS (
  SELECT user_id,
         MIN(CASE WHEN event_type = 'signup' THEN ts END) AS signup_ts,
         MIN(CASE WHEN event_type = 'view' THEN ts END) AS view_ts,
         MIN(CASE WHEN event_type = 'click' THEN ts END) AS click_ts,
         MIN(CASE WHEN event_type = 'purchase' THEN ts END) AS purchase_ts
  FROM events GROUP BY user_id)"""

LI_MONEY = """lim AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,4)), 2)
              AS DECIMAL(18,2)) AS disc_amount
  FROM lineitem)"""

PART_EDGES = """pe AS (
  SELECT p_partkey AS node_id, CASE WHEN p_partkey <= 1 THEN NULL ELSE p_partkey // 2 END AS parent_id
  FROM part)"""

CLOSURE = """clo(ancestor, descendant, distance) AS (
  SELECT node_id, node_id, 0 FROM pe
  UNION ALL
  SELECT pe.parent_id, clo.descendant, clo.distance + 1
  FROM clo JOIN pe ON clo.ancestor = pe.node_id WHERE pe.parent_id IS NOT NULL)"""


def versions_sql(src: str, key: str, date_col: str, attrs: list[str], start="effective_date",
                 end="expiry_date", current: bool = True) -> str:
    """Version chain in DuckDB: NULL-safe change detection then LEAD."""
    a = ", ".join(attrs)
    chg = " OR ".join(f"LAG({x}) OVER w IS DISTINCT FROM {x}" for x in attrs)
    cur = f", {end} = DATE '9999-12-31' AS is_current" if current else ""
    return f"""(SELECT *{cur} FROM (
  SELECT {key}, {a}, CAST({date_col} AS DATE) AS {start},
         COALESCE(CAST(LEAD({date_col}) OVER (PARTITION BY {key} ORDER BY {date_col}) AS DATE),
                  DATE '9999-12-31') AS {end}
  FROM (SELECT *, (LAG(1) OVER w IS NULL OR {chg}) AS chg FROM {src}
        WINDOW w AS (PARTITION BY {key} ORDER BY {date_col}))
  WHERE chg))"""
