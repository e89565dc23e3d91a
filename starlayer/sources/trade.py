"""Order sources: the canonical ``trade_order`` (S01), the deterministic
synthetic generators (S02, S03) and the partition-window reader (S11)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlayer.functions.exprs import MONEY, lit_date
from starlayer.functions.segments import key_load

# Column order of the canonical source every layer is written against.
TRADE_ORDER_COLUMNS = [
    "order_id", "user_id", "item_id", "merchant_id", "order_date",
    "order_amount", "order_status", "order_no", "created_at",
]

ORDERS_AS_OF = _dt.date(2001, 8, 1)
EVENTS_AS_OF = _dt.date(2024, 1, 30)


def zero_pad(value: Column, width: int) -> Column:
    """Digits padded to ``width``; a longer number keeps all its digits."""
    digits = value.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


#: rows of the larger side in a task of the order join
ROWS_PER_TASK = 500_000


def join_parts(orders: DataFrame, lineitem: DataFrame) -> int | None:
    """Tasks of the order join by its counted rows. None: an order may have more
    lines than a task should hold, and the join stays as the planner deals it,
    which may split such an order.

    Tasks are made by rows, not by shuffled bytes: narrow keys compress so well
    that a task of some MB may sort tens of millions of rows."""
    (a, hot), (b, twice) = key_load(lineitem, "l_orderkey"), key_load(orders, "o_orderkey")
    if hot or twice:
        return None
    spark = lineitem.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-max(a, b) // ROWS_PER_TASK))


def trade_order(orders: DataFrame, lineitem: DataFrame, keep_order_key: bool = False, parts: int | None = None) -> DataFrame:
    """S01 — item-grain order source from ``lineitem ⋈ orders``.

    Both sides are large at scale, so this is a shuffle (sort-merge) join on the
    order key; only the nine needed columns are read from parquet.
    ``keep_order_key`` also returns the join key as ``_order_key`` so a later
    per-order step can reuse the join's partitioning instead of reshuffling.
    ``parts`` deals both sides into that many tasks, whatever the rows' width
    (:func:`join_parts` counts them).
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_extendedprice", "l_shipdate")
    if parts is not None:
        o, li = o.repartition(parts, "o_orderkey"), li.repartition(parts, "l_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    amount = F.when(F.col("l_partkey") % 53 == 0, -F.col("l_extendedprice")) \
        .otherwise(F.col("l_extendedprice"))
    status = (F.when(F.col("o_orderstatus") == "F", F.lit(" PAID"))
              .when(F.col("o_orderstatus") == "O", F.lit("Shipped "))
              .when(F.col("o_orderstatus") == "P", F.lit("pending")))
    return j.select(
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                             F.col("l_linenumber").cast("string"))).alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("merchant_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        amount.cast(MONEY).alias("order_amount"),
        status.alias("order_status"),
        F.concat(F.lit("NO"), zero_pad(F.col("l_orderkey"), 8)).alias("order_no"),
        F.col("l_shipdate").alias("created_at"),
        *([F.col("l_orderkey").alias("_order_key")] if keep_order_key else []),
    )


def synth_orders_from(numbers: DataFrame, n_col: str = "n", *, seed: int = 42,
                      as_of=ORDERS_AS_OF, variant: str = "v1") -> DataFrame:
    """S02/S03 — deterministic synthetic orders, one per value of ``n_col``.

    ``variant='v1'`` is the generator with a seed multiplier for the user and
    thresholds 2/7 for the status; ``'v2'`` is the fixed-multiplier variant
    (7/11/13/17, thresholds 3/7). ``as_of`` replaces the wall clock: dates count
    back from it, timestamps back from its midnight.
    """
    # Multipliers, moduli and offsets of the two generators.
    if variant == "v1":
        user_mul, item_mul, amount_mul, pending_lt = seed, 7, 37, 2
    elif variant == "v2":
        user_mul, item_mul, amount_mul, pending_lt = 7, 11, 17, 3
    else:
        raise ValueError("variant must be 'v1' or 'v2'")
    n = F.col(n_col).cast("bigint")

    def code(prefix: str, value: Column, width: int) -> Column:
        return F.concat(F.lit(prefix), zero_pad(value, width))

    bucket = (n * 11) % 10
    a = lit_date(as_of)
    return numbers.select(
        code("O", n, 6).alias("order_id"),
        code("U", (n * user_mul) % 1000 + 1, 4).alias("user_id"),
        code("I", (n * item_mul) % 500 + 1, 4).alias("item_id"),
        code("M", (n * 13) % 50 + 1, 3).alias("merchant_id"),
        F.date_sub(a, ((n * 3) % 60).cast("int")).alias("order_date"),
        F.round(((n * amount_mul) % 1000 + 10).cast(MONEY), 2).alias("order_amount"),
        F.when(bucket < pending_lt, "pending").when(bucket < 7, "paid")
         .otherwise("shipped").alias("order_status"),
        code("NO", n, 8).alias("order_no"),
        (a.cast("timestamp_ntz") - F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), ((n * 5) % 86400).cast("decimal(18,6)"))
         ).alias("created_at"),
    )


def synth_orders(spark: SparkSession, row_count: int, *, seed: int = 42,
                 as_of=ORDERS_AS_OF, variant: str = "v1") -> DataFrame:
    """S02 with ``spark.range``: n in 1..row_count; row_count must be 1..100000."""
    if variant == "v1" and not 1 <= row_count <= 100000:
        raise ValueError("row_count must be between 1 and 100000")
    return synth_orders_from(spark.range(1, row_count + 1).withColumnRenamed("id", "n"),
                             seed=seed, as_of=as_of, variant=variant)


def read_partition_window(df: DataFrame, start, end, dt_col: str = "dt") -> DataFrame:
    """S11 — rows with ``start <= dt <= end``; on a ``partitionBy(dt)`` table
    this is a partition filter, so only those directories are listed and read."""
    c = F.col(dt_col)
    return df.filter((c >= lit_date(start)) & (c <= lit_date(end)))
