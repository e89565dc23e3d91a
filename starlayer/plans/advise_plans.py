"""Registered queries: profiling, modelling advice and text classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlayer.functions import lexicon as L
from starlayer.operators import advise as a
from starlayer.operators import classify as k
from starlayer.operators import dims as dimops
from starlayer.operators import hierarchy as h
from starlayer.plans import context as cx
from starlayer.plans.catalog import register
from starlayer.plans.sqlbits import (
    TRADE_ORDER, CHANGE_LOG, PART_EDGES, CLOSURE, LI_MONEY, R, versions_sql, with_,
)

def _profile_sql(src: str, cols: list[tuple[str, bool]]) -> str:
    parts = []
    for c, numeric in cols:
        mn = f"CAST(MIN({c}) AS DOUBLE)" if numeric else "NULL::DOUBLE"
        mx = f"CAST(MAX({c}) AS DOUBLE)" if numeric else "NULL::DOUBLE"
        ms = "NULL::VARCHAR" if numeric else f"CAST(MIN({c}) AS VARCHAR)"
        xs = "NULL::VARCHAR" if numeric else f"CAST(MAX({c}) AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, "
                     f"COUNT(DISTINCT {c}) AS distinct_count, {mn} AS min_num, {mx} AS max_num, "
                     f"{ms} AS min_str, {xs} AS max_str FROM {src}")
    return "\nUNION ALL ".join(parts)


_ALL_TYPES = [("order_id", False), ("user_id", True), ("item_id", True), ("merchant_id", True), ("order_date", False),
              ("order_amount", True), ("order_status", False), ("order_no", False), ("created_at", False)]


@register("profile_columns", with_(TRADE_ORDER) + _profile_sql("trade_order", _ALL_TYPES))
def _profile_columns(c):
    return a.profile_columns(c.trade_order())


@register("profile_columns_all", with_(TRADE_ORDER) + _profile_sql("trade_order", _ALL_TYPES))
def _profile_columns_all(c):
    """Every column of the table."""
    return a.profile_columns(c.trade_order())


@register("profile_columns_approx")
def _profile_columns_approx(c):
    """HyperLogLog++ distinct counts for very large tables (rows-only check)."""
    return a.profile_columns(c.t("lineitem"), exact=False)


def _change_stats_sql(attrs=("priority",)) -> str:
    v = versions_sql("change_log", "customer_key", "change_date", list(attrs), current=False)
    return f"""
, v AS {v},
per AS (SELECT customer_key, COUNT(*) AS n FROM v GROUP BY customer_key),
s AS (SELECT COUNT(*) AS keys, CAST(SUM(n) AS BIGINT) AS versions FROM per),
st AS (SELECT *, {R('versions - keys', 'keys', 4)} AS avg_changes_per_key FROM s)
"""


@register("advise_scd", with_(CHANGE_LOG) + _change_stats_sql() + """
SELECT 'priority' AS attribute, keys, versions, avg_changes_per_key,
       CASE WHEN avg_changes_per_key < 0.1 THEN 'low' WHEN avg_changes_per_key >= 1.0 THEN 'high' ELSE 'medium' END
         AS change_frequency,
       CASE WHEN avg_changes_per_key < 0.1 THEN 1 WHEN avg_changes_per_key >= 1.0 THEN 1 ELSE 2 END AS scd_type,
       CASE WHEN avg_changes_per_key < 0.1 THEN 3 WHEN avg_changes_per_key >= 1.0 THEN 4 ELSE 5 END AS rule
FROM st""")
def _advise_scd(c):
    return a.advise_scd(cx.change_log(c), "customer_key", "change_date", "priority")


@register("advise_scd_history", with_(CHANGE_LOG) + _change_stats_sql() + """
SELECT 'priority_history' AS attribute, keys, versions, avg_changes_per_key,
       CASE WHEN avg_changes_per_key < 0.1 THEN 'low' WHEN avg_changes_per_key >= 1.0 THEN 'high' ELSE 'medium' END
         AS change_frequency, 2 AS scd_type, 2 AS rule
FROM st""")
def _advise_scd_history(c):
    """Attribute name carries a history keyword → type 2 (rule 2)."""
    log = cx.change_log(c).withColumnRenamed("priority", "priority_history")
    return a.advise_scd(log, "customer_key", "change_date", "priority_history")


@register("advise_zipper", with_(CHANGE_LOG) + _change_stats_sql() + """
SELECT keys, versions, avg_changes_per_key,
       CASE WHEN avg_changes_per_key <= 0 THEN 1.0 ELSE avg_changes_per_key END AS expansion_ratio,
       (CASE WHEN avg_changes_per_key <= 0 THEN 1.0 ELSE avg_changes_per_key END) <= 100 AS use_zipper,
       CASE WHEN (CASE WHEN avg_changes_per_key <= 0 THEN 1.0 ELSE avg_changes_per_key END) > 100 THEN 2 ELSE 3 END
         AS rule,
       (CASE WHEN avg_changes_per_key <= 0 THEN 1.0 ELSE avg_changes_per_key END) <= 100 AND keys < 100
         AS small_dimension_note
FROM st""")
def _advise_zipper(c):
    return a.advise_zipper(cx.change_log(c), "customer_key", "change_date", ["priority"])


@register("advise_degenerate", with_(TRADE_ORDER) + """
, p AS (""" + _profile_sql("trade_order", [("order_no", False), ("order_id", False), ("user_id", True),
                                          ("created_at", False)]) + """)
SELECT column_name, row_count, null_count, distinct_count,
       distinct_count = row_count AND null_count = 0 AS measured_key,
       column_name IN ('order_no', 'order_id') OR (distinct_count = row_count AND null_count = 0) AS is_degenerate,
       CASE WHEN column_name IN ('order_no', 'order_id') THEN 1
            WHEN distinct_count = row_count AND null_count = 0 THEN 2 ELSE 3 END AS rule
FROM p""")
def _advise_degenerate(c):
    return a.advise_degenerate(c.trade_order(), ["order_no", "order_id", "user_id", "created_at"])


def _junk_sql(cols: list[str]) -> str:
    card = " * ".join(f"GREATEST(COUNT(DISTINCT {x}), 1)" for x in cols)
    mx = "GREATEST(" + ", ".join(f"COUNT(DISTINCT {x})" for x in cols) + ")" if len(cols) > 1 \
        else f"COUNT(DISTINCT {cols[0]})"
    return f"""
, s AS (SELECT {len(cols)} AS flags, {mx} AS max_cardinality, CAST({card} AS BIGINT) AS combinations FROM lineitem)
SELECT flags, max_cardinality, combinations,
       NOT (max_cardinality > 20 OR flags < 3 OR combinations > 10000) AS use_junk,
       CASE WHEN max_cardinality > 20 THEN 1 WHEN flags < 3 THEN 2 WHEN combinations > 10000 THEN 3 ELSE 4 END AS rule
FROM s"""


@register("advise_junk", "WITH x AS (SELECT 1)" + _junk_sql(["l_returnflag", "l_linestatus", "l_linenumber"]))
def _advise_junk(c):
    return a.advise_junk(c.t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@register("advise_junk_wide", "WITH x AS (SELECT 1)" + _junk_sql(["l_returnflag", "l_linestatus", "l_quantity"]))
def _advise_junk_wide(c):
    """l_quantity has 50 values → rule 1 (a flag with more than 20 values)."""
    return a.advise_junk(c.t("lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])


@register("advise_mini", with_(CHANGE_LOG) + _change_stats_sql() + """
, r AS (SELECT COUNT(DISTINCT c_custkey) AS dimension_rows FROM customer)
SELECT 2 AS attributes, dimension_rows, avg_changes_per_key,
       CASE WHEN avg_changes_per_key < 0.1 THEN 'low' WHEN avg_changes_per_key >= 1.0 THEN 'high' ELSE 'medium' END
         AS change_frequency,
       (avg_changes_per_key >= 0.1 OR dimension_rows >= 10000) AS use_mini,
       CASE WHEN avg_changes_per_key < 0.1 AND dimension_rows < 10000 THEN 2 ELSE 3 END AS rule
FROM r, st""")
def _advise_mini(c):
    return a.advise_mini(c.t("customer"), "c_custkey", ["segment", "balance_band"], cx.change_log(c),
                         "customer_key", "change_date", ["priority"])


def _multi_sql(src: str, x: str, y: str) -> str:
    return f"""WITH pairs AS (SELECT DISTINCT {x} AS a, {y} AS b FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
pa AS (SELECT a, COUNT(*) AS n FROM pairs GROUP BY a), pb AS (SELECT b, COUNT(*) AS n FROM pairs GROUP BY b),
s AS (SELECT (SELECT SUM(n) FROM pa) AS pairs, (SELECT COUNT(*) FROM pa) AS a_keys,
             (SELECT COUNT(*) FROM pb) AS b_keys, (SELECT MAX(n) FROM pa) AS max_b_per_a,
             (SELECT MAX(n) FROM pb) AS max_a_per_b),
t AS (SELECT *, {R('pairs', 'a_keys', 4)} AS avg_values_per_owner,
             CASE WHEN max_b_per_a <= 1 THEN 'n:1' WHEN max_a_per_b <= 1 THEN '1:n' ELSE 'm:n' END AS relationship
      FROM s)
SELECT '{x}' AS owner, '{y}' AS value, CAST(pairs AS BIGINT) AS pairs, a_keys, b_keys, avg_values_per_owner,
       max_b_per_a, max_a_per_b, relationship,
       CASE WHEN relationship = 'n:1' THEN 'none' WHEN relationship = '1:n' AND avg_values_per_owner <= 5
            THEN 'array' ELSE 'bridge_table' END AS strategy,
       CASE WHEN relationship = 'n:1' THEN 1 WHEN relationship = '1:n' AND avg_values_per_owner <= 5 THEN 2
            WHEN relationship = '1:n' THEN 3 ELSE 4 END AS rule
FROM t"""


@register("advise_multivalue", _multi_sql("lineitem", "l_orderkey", "l_partkey"))
def _advise_multivalue(c):
    return a.advise_multivalue(c.t("lineitem"), "l_orderkey", "l_partkey")


@register("advise_multivalue_1n", _multi_sql("orders", "o_custkey", "o_orderkey"))
def _advise_multivalue_1n(c):
    """customer → orders is 1:n with about ten per customer → bridge (rule 3)."""
    return a.advise_multivalue(c.t("orders"), "o_custkey", "o_orderkey")


@register("advise_multivalue_n1", _multi_sql("orders", "o_orderkey", "o_custkey"))
def _advise_multivalue_n1(c):
    """order → customer is n:1 → no special handling (rule 1)."""
    return a.advise_multivalue(c.t("orders"), "o_orderkey", "o_custkey")


_REC = with_(PART_EDGES).replace("WITH ", "WITH RECURSIVE ") + ", " + CLOSURE


@register("advise_hierarchy", _REC + """
, s AS (SELECT MAX(distance) + 1 AS depth, COUNT(DISTINCT descendant) AS nodes FROM clo)
SELECT depth, nodes, CASE WHEN depth <= 1 THEN 'none' WHEN depth <= 4 THEN 'flatten' ELSE 'bridge' END AS strategy,
       CASE WHEN depth <= 1 THEN 1 WHEN depth <= 4 THEN 2 ELSE 3 END AS rule FROM s""")
def _advise_hierarchy(c):
    return a.advise_hierarchy(h.hier_closure(cx.part_edges(c)))


@register("advise_hierarchy_shallow", """
WITH RECURSIVE geo AS (
  SELECT 'R' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
clo(ancestor, descendant, distance) AS (
  SELECT node_id, node_id, 0 FROM geo
  UNION ALL SELECT geo.parent_id, clo.descendant, clo.distance + 1 FROM clo JOIN geo ON clo.ancestor = geo.node_id
  WHERE geo.parent_id IS NOT NULL),
s AS (SELECT MAX(distance) + 1 AS depth, COUNT(DISTINCT descendant) AS nodes FROM clo)
SELECT depth, nodes, CASE WHEN depth <= 1 THEN 'none' WHEN depth <= 4 THEN 'flatten' ELSE 'bridge' END AS strategy,
       CASE WHEN depth <= 1 THEN 1 WHEN depth <= 4 THEN 2 ELSE 3 END AS rule FROM s""")
def _advise_hierarchy_shallow(c):
    return a.advise_hierarchy(h.hier_closure(cx.geo_edges(c)))


def _fact_type_sql(src: str, key: str, proc: str, ts: str, end: str) -> str:
    return f"""WITH e AS (SELECT {key} AS k, {proc} AS p, {ts} AS ts FROM {src}),
pk AS (SELECT k, COUNT(DISTINCT p) AS np, COUNT(DISTINCT ts) AS nt, BOOL_OR(p = '{end}') AS reached FROM e GROUP BY k),
ks AS (SELECT COUNT(*) AS keys, COUNT(CASE WHEN np >= 2 AND nt >= 2 THEN 1 END) AS keys_with_intervals,
              COUNT(CASE WHEN reached THEN 1 END) AS keys_at_end FROM pk),
g AS (SELECT COUNT(DISTINCT p) AS processes, COUNT(*) AS rows, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM e),
s AS (SELECT *, {R('keys_with_intervals', 'keys', 4)} AS interval_share, {R('rows', 'days', 2)} AS rows_per_day
      FROM g, ks),
r AS (SELECT *, CASE WHEN processes = 0 THEN 0
                     WHEN (processes >= 2 AND interval_share > 0.5 AND keys_at_end > 0)
                       OR (processes >= 4 AND interval_share > 0.5) THEN 1
                     WHEN processes = 1 AND rows_per_day >= 1000 THEN 3
                     WHEN processes >= 2 AND NOT interval_share > 0.5 THEN 4 ELSE 5 END AS rule FROM s)
SELECT processes, keys, interval_share, keys_at_end, rows_per_day,
       CASE WHEN rule = 1 THEN 'accumulating_snapshot' WHEN rule = 2 THEN 'periodic_snapshot' ELSE 'transaction' END
         AS fact_type,
       CAST(CASE rule WHEN 0 THEN 0.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 WHEN 3 THEN 0.9 WHEN 4 THEN 0.7 ELSE 0.6 END
            AS DOUBLE) AS confidence, rule
FROM r"""


@register("advise_fact_type", _fact_type_sql("events", "user_id", "event_type", "ts", "purchase"))
def _advise_fact_type(c):
    return a.advise_fact_type(c.t("events"), "user_id", "event_type", "ts", end_process="purchase")


@register("advise_fact_type_singles", _fact_type_sql("events", "event_id", "event_type", "ts", "purchase"))
def _advise_fact_type_singles(c):
    """Several processes, none of them on one key: no intervals (rule 4)."""
    return a.advise_fact_type(c.t("events"), "event_id", "event_type", "ts", end_process="purchase")


@register("advise_fact_type_ships", _fact_type_sql("""(SELECT l_orderkey AS order_key, 'ship' AS process,
  l_shipdate AS ts FROM lineitem)""", "order_key", "process", "ts", "return"))
def _advise_fact_type_ships(c):
    """One process: rule 3 or 5, by the rows of a day."""
    ships = c.t("lineitem").select(F.col("l_orderkey").alias("order_key"), F.lit("ship").alias("process"), F.col("l_shipdate").alias("ts"))
    return a.advise_fact_type(ships, "order_key", "process", "ts", end_process="return")


@register("advise_fact_type_orders", _fact_type_sql("""(SELECT o_orderkey AS order_key, 'ordered' AS process,
  o_orderdate AS ts FROM orders UNION ALL SELECT l_orderkey, 'ship', l_shipdate FROM lineitem
  UNION ALL SELECT l_orderkey, 'return', l_shipdate FROM lineitem WHERE l_returnflag = 'R')""",
                                                    "order_key", "process", "ts", "return"))
def _advise_fact_type_orders(c):
    return a.advise_fact_type(cx.order_lifecycle_events(c), "order_key", "process", "ts", end_process="return")


@register("advise_additivity", with_(LI_MONEY) + """
, q AS (SELECT COUNT(*) AS row_count,
               COUNT(CASE WHEN COALESCE(ABS(CAST(l_discount AS DOUBLE)
                    - CASE WHEN gross <> 0 THEN CAST(disc_amount AS DOUBLE) / CAST(gross AS DOUBLE) END) > 0.001, TRUE)
                    THEN 1 END) AS b0 FROM lim)
SELECT 'l_discount' AS measure, row_count, b0 AS quotient_violations, false AS declared_state,
       CASE WHEN b0 = 0 THEN 'non_additive' ELSE 'additive' END AS additivity, CASE WHEN b0 = 0 THEN 1 ELSE 3 END AS rule
FROM q
UNION ALL SELECT 'l_quantity', row_count, NULL, false, 'additive', 3 FROM q
UNION ALL SELECT 'l_tax', row_count, NULL, true, 'semi_additive', 2 FROM q""")
def _advise_additivity(c):
    return a.advise_additivity(cx.lineitem_money(c), ["l_discount", "l_quantity", "l_tax"],
                               {"l_discount": ("disc_amount", "gross")}, state_measures=("l_tax",))


# --- classification ------------------------------------------------------------------

def _values(d: dict) -> str:
    rows = []
    for rank, (name, kws) in enumerate(d.items()):
        for kw in kws:
            rows.append(f"('{name}', {rank}, '{kw.lower()}')")
    return "VALUES " + ", ".join(rows)


def _evidence_values() -> str:
    words = [(p, r, w) for r, (p, kws) in enumerate(L.PROCESS_KEYWORDS.items()) for w in kws]
    return "VALUES " + ", ".join(f"('{p}', {r}, '{w}', {i})" for i, (p, r, w) in enumerate(words))


def _entity_sql(col: str) -> str:
    return " + ".join(f"CASE WHEN contains({col}, '{e}') THEN 1 ELSE 0 END" for e in L.ENTITY_HINTS)


def _process_sql(src: str, id_col: str, text_col: str, known: list[str] | None = None) -> str:
    known = known or []
    kn = ", ".join(f"'{x}'" for x in known) or "NULL"
    extra = [x for x in known if x not in L.PROCESS_KEYWORDS]
    procs = list(L.PROCESS_KEYWORDS) + extra
    plist = "VALUES " + ", ".join(f"('{p}')" for p in procs)
    return f"""WITH lex(process, rank, kw) AS ({_values(L.PROCESS_KEYWORDS)}),
t AS (SELECT {id_col} AS id, COALESCE({text_col}, '') AS txt FROM {src}),
hits AS (SELECT t.id, lex.process, COUNT(*) AS hits FROM t JOIN lex ON contains(lower(t.txt), lex.kw)
         GROUP BY t.id, lex.process),
ent AS (SELECT id, {_entity_sql('txt')} AS entity_hits FROM t),
cand AS (SELECT t.id, p.process, COALESCE(h.hits, 0) AS hits
         FROM t CROSS JOIN ({plist}) p(process) LEFT JOIN hits h ON h.id = t.id AND h.process = p.process),
c1 AS (SELECT id, process, hits, LEAST(0.5 + 0.15 * CAST(hits AS DOUBLE), 0.95) AS c,
              process IN ({kn}) AS known FROM cand WHERE hits > 0 OR process IN ({kn})),
c2 AS (SELECT id, process, hits, CASE WHEN known AND hits = 0 THEN 0.7 WHEN known THEN LEAST(c + 0.2, 0.99)
                                      ELSE c END AS c FROM c1),
c3 AS (SELECT c2.id, process, hits, entity_hits,
              CASE WHEN entity_hits > 0 THEN GREATEST(c - 0.05 * CAST(entity_hits AS DOUBLE), 0.3) ELSE c END AS c
       FROM c2 JOIN ent ON c2.id = ent.id)
SELECT id AS {id_col}, process, hits, entity_hits, ROUND(c, 4) AS confidence FROM c3 WHERE c >= 0.5"""


@register("tag_business_process", _process_sql("documents", "doc_id", "text"))
def _tag_business_process(c):
    return k.tag_business_process(c.t("documents"), "doc_id", "text").drop("evidence_keywords")


@register("tag_business_process_evidence", f"""WITH lex(process, rank, kw, place) AS ({_evidence_values()})
SELECT t.doc_id, lex.process, string_agg(lex.kw, '|' ORDER BY lex.place) AS evidence
FROM documents t JOIN lex ON contains(lower(t.text), lower(lex.kw))
JOIN ({_process_sql("documents", "doc_id", "text")}) c ON c.doc_id = t.doc_id AND c.process = lex.process
GROUP BY t.doc_id, lex.process""")
def _tag_business_process_evidence(c):
    """The keywords that speak for each process of a document."""
    tags = k.tag_business_process(c.t("documents"), "doc_id", "text")
    return tags.select("doc_id", "process", F.array_join("evidence_keywords", "|").alias("evidence"))


@register("tag_business_process_events", _process_sql("events", "event_id", "event_type"))
def _tag_business_process_events(c):
    return k.tag_business_process(c.t("events"), "event_id", "event_type").drop("evidence_keywords")


@register("process_known_boost", _process_sql("documents", "doc_id", "text", ["下单", "支付", "评价"]))
def _process_known_boost(c):
    return k.process_known_boost(c.t("documents"), "doc_id", "text", ["下单", "支付", "评价"]).drop("evidence_keywords")


def _domain_sql(src: str, id_col: str, text_col: str) -> str:
    return f"""WITH lex(domain, rank, kw) AS ({_values(L.DOMAIN_KEYWORDS)}),
t AS (SELECT {id_col} AS id, COALESCE({text_col}, '') AS txt FROM {src}),
h AS (SELECT t.id, lex.domain, lex.rank, COUNT(*) AS hits FROM t JOIN lex ON contains(lower(t.txt), lex.kw)
      GROUP BY t.id, lex.domain, lex.rank),
b AS (SELECT id, domain, hits FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY hits DESC, rank) = 1),
tags AS (SELECT t.id AS {id_col}, COALESCE(b.domain, 'uncategorized') AS domain, COALESCE(b.hits, 0) AS hits
         FROM t LEFT JOIN b ON t.id = b.id)
"""


@register("tag_data_domain", _domain_sql("documents", "doc_id", "text") + "SELECT * FROM tags")
def _tag_data_domain(c):
    return k.tag_data_domain(c.t("documents"), "doc_id", "text")


@register("tag_data_domain_pages", _domain_sql("pages", "page_id", "html") + "SELECT * FROM tags")
def _tag_data_domain_pages(c):
    return k.tag_data_domain(c.t("pages"), "page_id", "html")


_DOM_RANK = "CASE domain " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(L.DOMAIN_KEYWORDS)) + \
    f" ELSE {len(L.DOMAIN_KEYWORDS)} END"


@register("domain_summary", _domain_sql("pages", "page_id", "html") + f"""
, per AS (SELECT domain, COUNT(*) AS rows, {_DOM_RANK} AS r FROM tags GROUP BY domain),
best AS (SELECT domain FROM per WHERE domain <> 'uncategorized' ORDER BY rows DESC, r LIMIT 1),
agg AS (SELECT COUNT(CASE WHEN domain <> 'uncategorized' THEN 1 END) AS domains,
               COALESCE(SUM(CASE WHEN domain = 'uncategorized' THEN rows END), 0) AS unc FROM per)
SELECT per.domain, per.rows, per.domain IN (SELECT domain FROM best) AS is_primary, agg.domains,
       agg.domains >= 3 AS warning, CAST(agg.unc AS BIGINT) AS uncategorized_errors FROM per, agg""")
def _domain_summary(c):
    return k.domain_summary(k.tag_data_domain(c.t("pages"), "page_id", "html"))


# --- bus matrix ------------------------------------------------------------------------

_BUS_DIMS = ["customer", "part", "supplier", "date", "return_reason"]


def _bus_long(c):
    """One scan of lineitem ⋈ orders: every line is an order and a shipment,
    returned lines also a return."""
    li = c.t("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_orderkey",
                                F.col("l_shipdate").cast("date").alias("shipped"), F.col("l_returnflag").alias("reason"))
    o = c.t("orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("ordered"))
    keys = {"customer": "customer", "part": "part", "supplier": "supplier"}
    uses = {"order": (F.lit(True), keys | {"date": "ordered"}), "ship": (F.lit(True), keys | {"date": "shipped"}),
            "return": (F.col("reason") == "R", keys | {"date": "shipped", "return_reason": "reason"})}
    return k.bus_matrix_wide(li.join(o, li.l_orderkey == o.o_orderkey), uses, _bus_dims(c))


def _bus_dims(c):
    b = c.t("orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("lo"),
                          F.max(F.col("o_orderdate").cast("date")).alias("hi"))
    return {"customer": c.t("customer").select("c_custkey"), "part": c.t("part").select("p_partkey"),
            "supplier": c.t("supplier").select("s_suppkey"), "date": dimops.dim_date(b).select("date"),
            "return_reason": c.t("lineitem").filter(F.col("l_returnflag") == "R").select("l_returnflag")}


_BUS_SQL = """WITH j AS (SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
f AS (SELECT 'order' AS process, o_custkey AS customer, l_partkey AS part, l_suppkey AS supplier,
             CAST(o_orderdate AS DATE) AS date, NULL::VARCHAR AS return_reason FROM j
      UNION ALL SELECT 'ship', o_custkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE), NULL FROM j
      UNION ALL SELECT 'return', o_custkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE), l_returnflag FROM j
                WHERE l_returnflag = 'R'),
b AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM orders),
procs AS (SELECT DISTINCT process FROM f),
long AS (
  SELECT p.process, 'customer' AS dimension, (SELECT COUNT(DISTINCT customer) FROM f WHERE f.process = p.process
     AND customer IN (SELECT c_custkey FROM customer)) AS resolved_keys FROM procs p
  UNION ALL SELECT p.process, 'part', (SELECT COUNT(DISTINCT part) FROM f WHERE f.process = p.process
     AND part IN (SELECT p_partkey FROM part)) FROM procs p
  UNION ALL SELECT p.process, 'supplier', (SELECT COUNT(DISTINCT supplier) FROM f WHERE f.process = p.process
     AND supplier IN (SELECT s_suppkey FROM supplier)) FROM procs p
  UNION ALL SELECT p.process, 'date', (SELECT COUNT(DISTINCT date) FROM f, b WHERE f.process = p.process
     AND date BETWEEN b.lo AND b.hi) FROM procs p
  UNION ALL SELECT p.process, 'return_reason', (SELECT COUNT(DISTINCT return_reason) FROM f
     WHERE f.process = p.process AND return_reason IN (SELECT l_returnflag FROM lineitem WHERE l_returnflag = 'R'))
     FROM procs p)
"""


@register("bus_matrix_long", _BUS_SQL + "SELECT process, dimension, resolved_keys, resolved_keys > 0 AS used FROM long")
def _bus_matrix_long(c):
    return _bus_long(c)


@register("bus_matrix", _BUS_SQL + """
SELECT process, BOOL_OR(CASE WHEN dimension = 'customer' THEN resolved_keys > 0 END) AS customer,
       BOOL_OR(CASE WHEN dimension = 'part' THEN resolved_keys > 0 END) AS part,
       BOOL_OR(CASE WHEN dimension = 'supplier' THEN resolved_keys > 0 END) AS supplier,
       BOOL_OR(CASE WHEN dimension = 'date' THEN resolved_keys > 0 END) AS date,
       BOOL_OR(CASE WHEN dimension = 'return_reason' THEN resolved_keys > 0 END) AS return_reason
FROM long GROUP BY process""")
def _bus_matrix(c):
    return k.bus_matrix(_bus_long(c), _BUS_DIMS)


@register("bus_matrix_shared", _BUS_SQL + """
, n AS (SELECT COUNT(*) AS np FROM procs)
SELECT dimension, COUNT(CASE WHEN resolved_keys > 0 THEN 1 END) AS processes_using,
       COUNT(CASE WHEN resolved_keys > 0 THEN 1 END) = MAX(np) AS shared,
       CASE WHEN COUNT(CASE WHEN resolved_keys > 0 THEN 1 END) = 1
            THEN MAX(CASE WHEN resolved_keys > 0 THEN process END) END AS only_process
FROM long, n GROUP BY dimension""")
def _bus_matrix_shared(c):
    return k.bus_matrix_shared(_bus_long(c))
