"""DWD cleaning: standardise, filter, latest-row dedup, rejects, enumerations,
dimension keys, degenerate numbers and masking (C01–C11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlayer.functions.exprs import MONEY
from starlayer.functions.joins import bounded_broadcast
from starlayer.functions.quantiles import exact_quantiles
from starlayer.functions.segments import Segmented, carry, segment
from starlayer.sources.trade import TRADE_ORDER_COLUMNS

# Total order for "latest row per order_id": newest created_at first, then
# columns that make the order unique over the fixture rows.
def dedup_order():
    return [F.col("created_at").desc_nulls_last(), F.col("item_id").asc_nulls_last(),
            F.col("merchant_id").asc_nulls_last(), F.col("order_amount").asc_nulls_last()]


def dedup_order_reversed():
    """The same order backwards, as plain ascending columns with NULLs first
    (what segments are cut along): the row that stays comes last."""
    return [F.col("created_at"), F.bitwise_not("item_id"), F.bitwise_not("merchant_id"), -F.col("order_amount")]


def dwd_standardize(df: DataFrame) -> DataFrame:
    """C02 — casts and status normalisation; ``try_cast`` keeps bad raw values
    as NULL instead of failing the job under ANSI mode."""
    return df.select(
        "order_id", "user_id", "item_id", "merchant_id",
        F.col("order_date").try_cast("date").alias("order_date"),
        F.col("order_amount").try_cast(MONEY).alias("order_amount"),
        F.lower(F.trim(F.col("order_status"))).alias("order_status"),
        "order_no",
        F.col("created_at").try_cast("timestamp_ntz").alias("created_at"),
        *[c for c in df.columns if c not in TRADE_ORDER_COLUMNS],
    )


def dwd_filter_invalid(df: DataFrame, key: str = "order_id",
                       amount: str = "order_amount") -> DataFrame:
    """C03 — non-null key and amount >= 0 (a NULL amount is dropped too)."""
    return df.filter(F.col(key).isNotNull() & (F.col(amount) >= 0))


def dwd_dedup_latest(df: DataFrame, key: str = "order_id", order=None, colocate=()) -> DataFrame:
    """C04 — latest row per key under a total order.

    ``row_number() == 1`` lets Catalyst insert a partial window-group-limit
    before the shuffle, so only one candidate per key and partition moves.
    ``colocate`` names columns that ``key`` functionally determines (e.g. the
    order key inside an order-line id): partitioning by them as well lets the
    window reuse an existing hash partitioning on those columns (no exchange).
    """
    w = Window.partitionBy(*colocate, key).orderBy(*(order or dedup_order()))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dwd_trade_order(raw: DataFrame, colocate=()) -> DataFrame:
    """C01 — the whole DWD step: standardise → filter → dedup."""
    return dwd_dedup_latest(dwd_filter_invalid(dwd_standardize(raw)), colocate=colocate)


def dwd_reject(raw: DataFrame, key: str = "order_id", parts: int | None = None, colocate=()) -> DataFrame:
    """C05 — rows C03/C04 remove with a reason; kept + rejected = input.

    One pass: rows are tagged ``null_key`` or ``bad_amount``, the others stand in
    the order of the dedup within their key, and all that have a better one are
    ``superseded``. A key (NULL too) with more rows than a task should hold is cut
    into segments along that order, each with the row after it, so no window
    task gets a whole hot key. Of rows that are equal in the order one counts as
    kept, whichever.

    ``colocate`` names columns that ``key`` determines and that the rows are
    dealt by, none of whose groups is hot: the windows then stay inside them,
    without a count per key and without a shuffle.
    """
    std = dwd_standardize(raw)
    bad = ~F.coalesce(F.col("order_amount") >= 0, F.lit(False))
    tagged = std.withColumn("_why", F.when(F.col(key).isNull(), "null_key").when(bad, "bad_amount"))
    if colocate:
        s = Segmented(tagged, [*colocate, key, "_why"], dedup_order_reversed(), False)
    else:
        s = carry(segment(tagged, [key, "_why"], dedup_order_reversed(), parts), after=True)
    marked = s.rows.withColumn("_older", F.lead(F.lit(True)).over(s.window()).isNotNull())
    reason = F.coalesce(F.col("_why"), F.when(F.col("_older"), "superseded"))
    out = s.own(marked.withColumn("reject_reason", reason))
    return out.where("reject_reason is not null").drop("_why", "_older", *colocate)


def dwd_enum_standardize(df: DataFrame, mapping: dict[str, str], col: str = "order_status",
                         unknown: str = "other", amount: str | None = "order_amount",
                         lower=None, upper=None) -> DataFrame:
    """C06 — raw code → standard value through a mapping frame; unknown codes
    become ``unknown``; rows whose amount lies outside [lower, upper] are dropped.

    The mapping is a literal map in the plan: no join, no shuffle of the fact.
    """
    raw = F.lower(F.trim(F.col(col)))
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    out = df.withColumn(col, F.coalesce(F.try_element_at(known, raw), F.lit(unknown)) if mapping else F.lit(unknown))
    if amount is not None:
        if lower is not None:
            out = out.filter(F.col(amount) >= F.lit(lower))
        if upper is not None:
            out = out.filter(F.col(amount) <= F.lit(upper))
    return out


def outlier_bounds(df: DataFrame, amount: str = "order_amount", lo: float = 0.01,
                   hi: float = 0.99, accuracy: int = 10000) -> DataFrame:
    """Approximate quantile bounds (one pass, bounded memory) for C06."""
    return df.agg(F.percentile_approx(F.col(amount).cast("double"), [lo, hi], accuracy).alias("b")) \
        .select(F.col("b")[0].alias("lower"), F.col("b")[1].alias("upper"))


def dwd_drop_outliers(df: DataFrame, amount: str = "order_amount", low: int = 10, high: int = 990) -> DataFrame:
    """C06 — rows whose amount lies between two quantiles of the data itself
    (thousandths of the non-NULL amounts; the bounds themselves stay). A NULL
    amount is dropped; a column without values leaves no rows.

    The quantiles are exact: a sketch brackets them, counting settles them.
    ``df`` is read several times; pass a stored table.
    """
    lower, upper = exact_quantiles(df, amount, [low, high])
    if lower is None:
        return df.limit(0)
    return df.filter(F.col(amount).between(F.lit(lower), F.lit(upper)))


def dwd_attach_dim_keys(fact: DataFrame, dims, unknown_key: int = -1) -> DataFrame:
    """C07 — put dimension keys on the fact; unknown member → ``unknown_key``.

    ``dims`` holds (dimension frame, natural key in the fact, natural key in the
    dimension, surrogate key column in the dimension, output column). Each join
    is a left join; a small dimension is broadcast behind a size check, a large
    one shuffles on the key.
    """
    out = fact
    for i, (dim, fact_nk, dim_nk, sk, out_col) in enumerate(dims):
        nk, sv = f"_nk{i}", f"_sk{i}"
        d = dim.select(F.col(dim_nk).alias(nk), F.col(sk).alias(sv))
        out = (out.join(bounded_broadcast(d), out[fact_nk] == d[nk], "left")
               .withColumn(out_col, F.coalesce(F.col(sv), F.lit(unknown_key)).cast("bigint"))
               .drop(nk, sv))
    return out


def degenerate_keep(dwd: DataFrame, number: str = "order_no",
                    by: str = "order_date") -> DataFrame:
    """C08 — the business number stays on the fact; orders = COUNT DISTINCT."""
    return dwd.groupBy(by).agg(F.countDistinct(number).alias("order_cnt"),
                               F.count(F.lit(1)).alias("line_cnt"))


def degenerate_prefix_rollup(dwd: DataFrame, number: str = "order_no", n: int = 4,
                             amount: str = "order_amount") -> DataFrame:
    """C09 — analyse by the first ``n`` characters of the number."""
    return (dwd.groupBy(F.substring(number, 1, n).alias("number_prefix"))
            .agg(F.countDistinct(number).alias("order_cnt"),
                 F.count(F.lit(1)).alias("line_cnt"),
                 F.sum(amount).alias("gmv")))


def degenerate_drill(dwd: DataFrame, value: str, number: str = "order_no") -> DataFrame:
    """C10 — all fact rows of one number (a pushed-down equality filter)."""
    return dwd.filter(F.col(number) == F.lit(value))


def ads_masked(df: DataFrame, hash_cols=(), mask_cols=(), keep: int = 2) -> DataFrame:
    """C11 — hash identifiers (sha-256 hex) and mask the middle of strings,
    keeping ``keep`` characters at each end."""
    out = df
    for c in hash_cols:
        out = out.withColumn(c, F.sha2(F.col(c).cast("string"), 256))
    for c in mask_cols:
        s = F.col(c).cast("string")
        n = F.length(s)
        masked = F.concat(F.substring(s, 1, keep),
                          F.repeat(F.lit("*"), F.greatest(n - 2 * keep, F.lit(0))),
                          F.substring(s, -keep, keep))
        out = out.withColumn(c, F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(masked))
    return out
