"""Summary layers: DWS day grain, DWT topics, ADS, general subject rollups,
incremental DWT, layer verification probes and the distinct-count guard
(G01–G13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.functions.exprs import lit_date, ratio


def _order_cnt(key: str, unique: bool):
    # Orders are counted once by default; a caller whose rows are unique by key
    # (after C04) may say so and spare the distinct aggregation's shuffle.
    return F.count(key) if unique else F.countDistinct(key)


def dws_trade_order_1d(dwd: DataFrame, as_of=None, window_days: int | None = 30,
                       keys_unique: bool = False) -> DataFrame:
    """G01 — by date, user, merchant: orders, gmv, average amount, paid orders.

    ``window_days`` keeps ``order_date >= as_of - window_days``; ``None`` keeps
    all rows (the input of a lifetime DWT). The filter reaches the scan.
    """
    src = dwd
    if window_days is not None:
        src = src.filter(F.col("order_date") >= F.date_sub(lit_date(as_of), window_days))
    paid_key = F.when(F.col("order_status") == "paid", F.col("order_id"))
    return (src.groupBy("order_date", "user_id", "merchant_id")
            .agg(_order_cnt("order_id", keys_unique).alias("order_cnt"),
                 F.sum("order_amount").alias("gmv"),
                 ratio(F.sum("order_amount"), F.count("order_amount"), 2).alias("avg_order_amount"),
                 (F.count(paid_key) if keys_unique else F.countDistinct(paid_key)).alias("paid_order_cnt")))


def dwt_topic(dws: DataFrame, subject: str = "user_id", as_of=None,
              date_col: str = "order_date", days_unique: bool = False) -> DataFrame:
    """G02/G03 — lifetime topic by subject: active days, orders, gmv, last date.

    ``days_unique``: ``dws`` has one row per subject and date, so its dates are
    counted without a set of them."""
    return (dws.groupBy(subject)
            .agg((F.count(date_col) if days_unique else F.countDistinct(date_col)).alias("active_days"),
                 F.sum("order_cnt").cast("bigint").alias("lifetime_order_cnt"),
                 F.sum("gmv").alias("lifetime_gmv"),
                 F.max(date_col).alias("last_order_date"))
            .withColumn("dt", lit_date(as_of)))


def dwt_user_topic(dws: DataFrame, as_of) -> DataFrame:
    """G02."""
    return dwt_topic(dws, "user_id", as_of)


def dwt_merchant_topic(dws: DataFrame, as_of) -> DataFrame:
    """G03 (merchant)."""
    return dwt_topic(dws, "merchant_id", as_of)


def dwt_item_topic(dwd: DataFrame, as_of, keys_unique: bool = False) -> DataFrame:
    """G03 (item) — needs a DWS at item grain first (G05)."""
    dws = dws_subject_rollup(dwd, "item_id", period="1d", as_of=as_of, keys_unique=keys_unique)
    return dwt_topic(dws, "item_id", as_of, date_col="period_date", days_unique=True)


def ads_trade_summary(dws: DataFrame) -> DataFrame:
    """G04 — by date and merchant: ratios of sums with a zero guard, rounded 2."""
    return (dws.groupBy("order_date", "merchant_id")
            .agg(F.sum("order_cnt").alias("_cnt"), F.sum("gmv").alias("gmv"),
                 F.sum("paid_order_cnt").alias("_paid"))
            .select("order_date", "merchant_id",
                    F.col("_cnt").cast("bigint").alias("order_cnt"), "gmv",
                    F.col("_paid").cast("bigint").alias("paid_order_cnt"),
                    ratio(F.col("_paid"), F.col("_cnt"), 2, factor=100).alias("paid_rate"),
                    ratio(F.col("gmv"), F.col("_cnt"), 2).alias("avg_order_amount")))


def period_key(period: str, as_of, date_col: str = "order_date"):
    """Period label column for G05: day, ISO week start, month start, or as_of."""
    d = F.col(date_col)
    p = period.lower()
    if p == "1d":
        return d
    if p == "1w":
        return F.date_trunc("week", d).cast("date")
    if p == "1m":
        return F.trunc(d, "month")
    if p == "td":
        return lit_date(as_of)
    raise ValueError(f"unknown period {period!r}")


def dws_subject_rollup(dwd: DataFrame, subject: str, dims=(), period: str = "1d",
                       as_of=None, keys_unique: bool = False, metrics: dict | None = None) -> DataFrame:
    """G05 — any subject × extra dims × period (1d/1w/1m/td) × metrics.

    ``metrics`` maps output names to aggregate columns; by default orders, gmv
    and paid orders.

    ``td`` keeps every row up to ``as_of``; the other periods keep rows up to
    ``as_of`` when it is given.
    """
    src = dwd
    if as_of is not None:
        src = src.filter(F.col("order_date") <= lit_date(as_of))
    paid_key = F.when(F.col("order_status") == "paid", F.col("order_id"))
    if metrics is None:
        metrics = {"order_cnt": _order_cnt("order_id", keys_unique), "gmv": F.sum("order_amount"),
                   "paid_order_cnt": _order_cnt(paid_key, keys_unique)}
    return (src.groupBy(period_key(period, as_of).alias("period_date"), subject, *dims)
            .agg(*[m.alias(name) for name, m in metrics.items()]))


def dwt_incremental(dwt_prev: DataFrame, dws_batch: DataFrame, as_of,
                    subject: str = "user_id", date_col: str = "order_date") -> DataFrame:
    """G06 — yesterday's DWT merged with a new DWS batch whose dates are not in
    the old one: additive columns add, last date = greatest. Equals a full
    recompute (tested). One shuffle of each side on the subject key."""
    b = (dws_batch.groupBy(subject)
         .agg(F.countDistinct(date_col).alias("b_days"),
              F.sum("order_cnt").cast("bigint").alias("b_cnt"),
              F.sum("gmv").alias("b_gmv"), F.max(date_col).alias("b_last")))
    p = dwt_prev.select(subject, "active_days", "lifetime_order_cnt", "lifetime_gmv",
                        "last_order_date")
    j = p.join(b, subject, "full_outer")
    gmv = F.when(F.col("lifetime_gmv").isNull(), F.col("b_gmv")) \
        .when(F.col("b_gmv").isNull(), F.col("lifetime_gmv")) \
        .otherwise(F.col("lifetime_gmv") + F.col("b_gmv"))
    return j.select(
        subject,
        (F.coalesce("active_days", F.lit(0)) + F.coalesce("b_days", F.lit(0))).cast("bigint").alias("active_days"),
        (F.coalesce("lifetime_order_cnt", F.lit(0)) + F.coalesce("b_cnt", F.lit(0))).cast("bigint")
        .alias("lifetime_order_cnt"),
        gmv.cast("decimal(28,2)").alias("lifetime_gmv"),
        F.greatest("last_order_date", "b_last").alias("last_order_date"),
        lit_date(as_of).alias("dt"),
    )


# --- layer verification probes (one aggregation each) -----------------------

def layer_verify_ods(ods: DataFrame) -> DataFrame:
    """G07."""
    return ods.agg(F.count(F.lit(1)).alias("row_count"))


def layer_verify_dwd(dwd: DataFrame) -> DataFrame:
    """G08."""
    return dwd.agg(F.count(F.lit(1)).alias("row_count"),
                   F.countDistinct("order_id").alias("distinct_orders"),
                   F.sum(F.when(F.col("order_amount") < 0, 1).otherwise(0)).cast("bigint")
                   .alias("negative_amount_count"))


def layer_verify_dws(dws: DataFrame) -> DataFrame:
    """G09."""
    return dws.agg(F.count(F.lit(1)).alias("row_count"), F.sum("gmv").alias("total_gmv"),
                   F.sum("order_cnt").cast("bigint").alias("total_order_cnt"))


def layer_verify_dwt(dwt: DataFrame) -> DataFrame:
    """G10."""
    return dwt.agg(F.count(F.lit(1)).alias("user_count"),
                   F.sum("lifetime_gmv").alias("total_gmv"),
                   ratio(F.sum("lifetime_order_cnt"), F.count("lifetime_order_cnt"), 4)
                   .alias("avg_orders_per_user"))


def layer_verify_ads(ads: DataFrame) -> DataFrame:
    """G11."""
    return ads.agg(F.count(F.lit(1)).alias("row_count"), F.sum("gmv").alias("total_gmv"),
                   F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"))


def daily_gmv(df: DataFrame, date_col: str = "order_date",
              amount: str = "order_amount") -> DataFrame:
    """G12 — count and gmv per date over the whole table."""
    return df.groupBy(date_col).agg(F.count(F.lit(1)).alias("cnt"), F.sum(amount).alias("gmv"))


def dws_exact_distinct_guard(dwd: DataFrame, number: str = "order_no") -> DataFrame:
    """G13 — per date: exact distinct numbers next to the (wrong) sum of
    per-(date, user, merchant) distinct counts, and the overcount.

    One pass: the distinct (date, user, merchant, number) tuples are built once
    (partial aggregation before the shuffle); the summed count is the number of
    such tuples per date and the exact count their distinct numbers per date.
    """
    t = dwd.select("order_date", "user_id", "merchant_id", number).dropna(subset=[number]).distinct()
    g = t.groupBy("order_date").agg(F.countDistinct(number).cast("bigint").alias("exact_cnt"),
                                    F.count(F.lit(1)).cast("bigint").alias("summed_cnt"))
    return g.select("order_date", "exact_cnt", "summed_cnt",
                    (F.col("summed_cnt") - F.col("exact_cnt")).cast("bigint").alias("overcount"))
