"""Shared derivations of the driver tables used by the registered queries.

Each method returns a lazy DataFrame; nothing is cached or collected here, so
Catalyst sees one plan from the parquet scans to the query output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from starlayer.operators import clean, layers
from starlayer.sources.tables import read_table
from starlayer.sources.trade import EVENTS_AS_OF, ORDERS_AS_OF, join_parts, trade_order


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = ORDERS_AS_OF
        self.events_as_of = EVENTS_AS_OF

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # --- order warehouse chain -------------------------------------------
    def order_parts(self) -> int | None:
        """Tasks of the order join, counted once; None: some order may be hot."""
        if not hasattr(self, "_order_parts"):
            self._order_parts = join_parts(self.t("orders"), self.t("lineitem"))
        return self._order_parts

    def trade_order(self, keep_order_key: bool = False) -> DataFrame:
        return trade_order(self.t("orders"), self.t("lineitem"), keep_order_key, self.order_parts())

    def by_order(self) -> list[str]:
        """The column that steps per order line may stay dealt by: the join's
        order key, unless an order may be hot."""
        return [] if self.order_parts() is None else ["_order_key"]

    def dwd(self, since=None) -> DataFrame:
        """DWD from the raw tables. ``since`` keeps order dates >= since *before*
        the dedup: order_id determines the order and so its date, hence
        filtering before or after the latest-row window gives the same rows,
        but before it the filter reaches the orders scan and prunes the
        lineitem side (runtime filter) instead of deduplicating all history.

        The dedup window reuses the join's order-key partitioning
        (``colocate``), so the wide rows are not shuffled again. Where an order
        may be hot, it gets its own exchange on order_id: the join then stays
        splittable by AQE's skew-join handling.
        """
        by = self.by_order()
        raw = self.trade_order(keep_order_key=bool(by))
        if since is not None:
            raw = raw.filter(F.col("order_date") >= F.lit(since))
        return clean.dwd_trade_order(raw, colocate=by).drop(*by)

    def dwd_window(self, days: int) -> DataFrame:
        import datetime as _dt
        return self.dwd(since=self.as_of - _dt.timedelta(days=days))

    def dwd_table(self) -> DataFrame:
        """DWD written once as a table under the checkpoint folder and read
        back — for queries that consume the layer several times (reports),
        as a warehouse would read its persisted DWD layer."""
        if getattr(self, "_dwd_table", None) is None:
            from starlayer.session import scratch_dir
            path = scratch_dir(self.spark, "dwd")
            self.dwd().write.mode("overwrite").parquet(path)
            self._dwd_table = self.spark.read.parquet(path)
        return self._dwd_table

    def dws(self, window_days: int | None = 30) -> DataFrame:
        src = self.dwd() if window_days is None else self.dwd_window(window_days)
        return layers.dws_trade_order_1d(src, self.as_of, window_days, keys_unique=True)

    def dwt(self) -> DataFrame:
        return layers.dwt_user_topic(self.dws(None), self.as_of)

    def ads(self, window_days: int | None = 30) -> DataFrame:
        return layers.ads_trade_summary(self.dws(window_days))


def finish(df: DataFrame) -> DataFrame:
    """Output boundary of a registered query: decimals leave as double so that
    both engines' results hash alike."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DecimalType):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# --- fixtures derived from the driver tables (see FIXTURES.md §3) -------------

def _rn_first(df: DataFrame, keys, order) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def change_log(c: "Ctx") -> DataFrame:
    """(customer_key, change_date, priority): last order per customer and day."""
    o = c.t("orders").select(F.col("o_custkey").alias("customer_key"),
                             F.col("o_orderdate").cast("date").alias("change_date"),
                             F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return _rn_first(o, ["customer_key", "change_date"], [F.col("o_orderkey").desc()]).drop("o_orderkey")


def event_values(c: "Ctx") -> DataFrame:
    """events with the value as exact money."""
    return c.t("events").select("event_id", "ts", "user_id", "event_type",
                                F.col("value").cast("decimal(18,2)").alias("value"))


ORDER_MILESTONES = [("ordered", "ordered", "min"), ("first_ship", "ship", "min"),
                    ("last_ship", "ship", "max"), ("returned", "return", "min")]
EVENT_MILESTONES = ["signup", "view", "click", "purchase"]


def order_lifecycle_events(c: "Ctx") -> DataFrame:
    o = c.t("orders").select(F.col("o_orderkey").alias("order_key"), F.lit("ordered").alias("process"),
                             F.col("o_orderdate").alias("ts"))
    # shipping and return of a line leave one scan
    both = F.array(F.lit("ship"), F.when(F.col("l_returnflag") == "R", F.lit("return")))
    li = c.t("lineitem").select(F.col("l_orderkey").alias("order_key"), F.explode(F.array_compact(both)).alias("process"),
                                F.col("l_shipdate").alias("ts"))
    return o.unionByName(li)


def part_edges(c: "Ctx") -> DataFrame:
    """Deep hierarchy: part k → parent floor(k/2), root 1; part 0 is a root of its own."""
    p = c.t("part")
    return p.select(F.col("p_partkey").alias("node_id"),
                    F.when(F.col("p_partkey") <= 1, F.lit(None).cast("bigint"))
                    .otherwise(F.floor(F.col("p_partkey") / 2).cast("bigint")).alias("parent_id"))


def geo_edges(c: "Ctx") -> DataFrame:
    """Shallow hierarchy: region → nation → customer, string node ids."""
    r = c.t("region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node_id"),
                             F.lit(None).cast("string").alias("parent_id"))
    n = c.t("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"),
                             F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    cu = c.t("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"),
                                F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent_id"))
    return r.unionByName(n).unionByName(cu)


def lineitem_money(c: "Ctx") -> DataFrame:
    li = c.t("lineitem")
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = F.round(gross * F.col("l_discount").cast("decimal(18,4)"), 2).cast("decimal(18,2)")
    return li.withColumn("gross", gross).withColumn("disc_amount", disc)
