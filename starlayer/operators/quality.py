"""Reconciliation, edge checks, performance probes and the scored quality
report (J05–J07, Q01–Q21).

Several scalars are produced by *one* aggregation over a tagged union of the
inputs rather than by joining single-row frames.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlayer.functions.exprs import lit_date
from starlayer.functions.joins import with_scalars


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- reconciliation ----------------------------------------------------------

def recon_missing(source: DataFrame, target: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """J05 — source rows whose key is not in the target (NULL keys count as
    missing: an equality never matches NULL). ``left_anti`` on the keys.

    ``parts`` deals both sides by the keys into that many tasks, where neither
    has a hot or NULL key; keys then need no pass that makes them distinct."""
    t = target.select(*keys).dropna()
    if parts is None:
        t = t.distinct()
    else:
        source, t = source.repartition(parts, *keys), t.repartition(parts, *keys)
    return source.join(t, [source[k] == t[k] for k in keys], "left_anti")


def recon_extra(source: DataFrame, target: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """J06 — target rows whose key is not in the source."""
    return recon_missing(target, source, keys, parts)


def recon_amount(source: DataFrame, target: DataFrame, by: str | list[str] = "user_id",
                 measure: str = "order_amount", tolerance: float = 0.01) -> DataFrame:
    """J07 — sums of both sides per key (one column or several), full outer, keep
    |diff| > tolerance. Each side is pre-aggregated (partial aggregation before
    the shuffle)."""
    by = [by] if isinstance(by, str) else list(by)
    a = source.groupBy(*by).agg(F.sum(measure).alias("_a"))
    b = target.groupBy(*by).agg(F.sum(measure).alias("_b"))
    j = a.join(b, by, "full_outer")
    sa, sb = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return (j.select(*by, sa.alias("source_amount"), sb.alias("target_amount"),
                     (sa - sb).alias("amount_diff"))
            .filter(F.abs(F.col("amount_diff")) > F.lit(tolerance)))


def _two_counts(a: DataFrame, b: DataFrame, a_pred=None, b_pred=None) -> DataFrame:
    """count(a), count(b) in a single aggregation over a tagged union."""
    ta = a.select(F.lit(1).alias("_s"), F.lit(0).alias("_t"))
    tb = b.select(F.lit(0).alias("_s"), F.lit(1).alias("_t"))
    u = ta.unionByName(tb)
    return u.agg(F.sum("_s").cast("bigint").alias("source_count"),
                 F.sum("_t").cast("bigint").alias("target_count"))


def recon_count(source: DataFrame, target: DataFrame) -> DataFrame:
    """Q01 — source count, target count, difference (one row)."""
    return _two_counts(source, target).withColumn(
        "diff_count", (F.col("source_count") - F.col("target_count")).cast("bigint"))


# --- edge checks ---------------------------------------------------------------

def edge_null_pk(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Q05."""
    return df.agg(F.count(F.when(F.col(key).isNull(), 1)).alias("null_pk_count"))


def edge_dup_pk(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Q06 — keys seen more than once and how often (the NULL key is a group)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("dup_count")).filter("dup_count > 1")


def edge_negative(df: DataFrame, amount: str = "order_amount") -> DataFrame:
    """Q07."""
    return df.agg(F.count(F.when(F.col(amount) < 0, 1)).alias("negative_amount_count"))


def edge_zero(df: DataFrame, amount: str = "order_amount") -> DataFrame:
    """Q08."""
    return df.agg(F.count(F.when(F.col(amount) == 0, 1)).alias("zero_amount_count"))


def edge_daily_count(df: DataFrame, as_of, days: int = 30, date_col: str = "order_date") -> DataFrame:
    """Q09 — rows per day over the last ``days`` days (filter reaches the scan)."""
    return (df.filter(F.col(date_col) >= F.date_sub(lit_date(as_of), days))
            .groupBy(date_col).agg(F.count(F.lit(1)).alias("daily_count")))


def edge_date_gaps(df: DataFrame, date_col: str = "order_date", start=None, end=None) -> DataFrame:
    """Q10 — calendar days between the first and last observed date (or the
    given bounds) on which no row exists.

    The calendar is generated from a one-row min/max aggregate; its size is
    the number of days in the range, not the number of rows.
    """
    d = F.col(date_col).cast("date")
    bounds = df.agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    lo = lit_date(start) if start is not None else F.col("_lo")
    hi = lit_date(end) if end is not None else F.col("_hi")
    cal = bounds.select(F.explode(F.sequence(lo, hi)).alias("missing_date"))
    seen = df.select(d.alias("missing_date")).distinct()
    return cal.join(seen, "missing_date", "left_anti")


def edge_future_date(df: DataFrame, as_of, date_col: str = "order_date") -> DataFrame:
    """Q11."""
    return df.agg(F.count(F.when(F.col(date_col) > lit_date(as_of), 1)).alias("future_date_count"))


def edge_skew(df: DataFrame, key: str, factor: float = 2.0) -> DataFrame:
    """Q21 — keys whose row count exceeds ``factor`` × the average per key.

    Per-key counts are a partial+final aggregate; the average is a one-row
    aggregate of those counts attached as a scalar subquery (no join).
    """
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    j = with_scalars(per, per.agg(F.avg("row_count").alias("avg_count")))
    return (j.filter(F.col("row_count") > F.col("avg_count") * F.lit(factor))
            .select(key, "row_count", F.round("avg_count", 4).alias("avg_count"),
                    F.round(F.col("row_count") / F.col("avg_count"), 4).alias("skew_ratio")))


# --- performance probes ----------------------------------------------------------

def perf_row_count(df: DataFrame) -> DataFrame:
    """Q12."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def perf_table_size(df: DataFrame) -> DataFrame:
    """Q13 — size in MB (2 decimals) from the files behind a parquet frame."""
    files = df.select(F.col("_metadata.file_path").alias("p"),
                      F.col("_metadata.file_size").alias("s")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"),
                     F.round(F.sum("s") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"))


def perf_full_agg(df: DataFrame, amount: str = "order_amount") -> DataFrame:
    """Q14 — whole-table count + sum (the timed probe's shape)."""
    return df.agg(F.count(F.lit(1)).alias("c"), F.sum(amount).alias("s"))


def perf_explain(df: DataFrame, date_col: str, since) -> DataFrame:
    """Q15 — plan of a filtered count and whether the date filter reached the
    parquet scan (``PushedFilters``). Planning only; no job runs."""
    q = df.filter(F.col(date_col) >= lit_date(since)).groupBy().count()
    plan = q._jdf.queryExecution().executedPlan().toString()
    pushed = [ln.strip() for ln in plan.splitlines() if "PushedFilters" in ln]
    ok = any(date_col in ln for ln in pushed)
    spark = df.sparkSession
    return spark.createDataFrame([(plan, "\n".join(pushed), ok)],
                                 "plan string, pushed_filters string, filter_pushed boolean")


def time_action(df: DataFrame) -> float:
    """Wall time in ms of one action over ``df`` (the row comes back: 1 row)."""
    t0 = time.perf_counter()
    df.collect()
    return (time.perf_counter() - t0) * 1000.0


# --- scored report -------------------------------------------------------------

def report_accuracy(counts: DataFrame, pass_mark: float = 80.0) -> DataFrame:
    """Q16 — score = max(0, 100 − 100·|src − tgt| / max(src, 1)), round 2."""
    s, t = F.col("source_count"), F.col("target_count")
    diff = F.abs(s - t)
    score = F.greatest(F.lit(0.0), F.lit(100.0) - diff.cast("double") * 100.0
                       / F.greatest(s, F.lit(1)).cast("double"))
    return counts.select(
        F.lit("accuracy").alias("name"),
        F.round(score, 2).alias("score"),
        (score >= pass_mark).alias("passed"),
        F.concat(F.lit("source "), s.cast("string"), F.lit(" rows vs target "), t.cast("string"),
                 F.lit(" rows, diff "), diff.cast("string")).alias("notes"))


def completeness_counts(df: DataFrame, key: str = "order_id") -> DataFrame:
    """NULL keys and duplicated keys (groups with count > 1) in one pass over
    the per-key aggregate: the NULL group carries the NULL count."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("null_cnt"),
        F.count(F.when(F.col("n") > 1, 1)).cast("bigint").alias("dup_cnt"))


def report_completeness(counts: DataFrame, pass_mark: float = 90.0) -> DataFrame:
    """Q17 — 100 if no NULL and no duplicate key, else max(0, 100 − 5·(n + d))."""
    n, d = F.col("null_cnt"), F.col("dup_cnt")
    score = F.when((n == 0) & (d == 0), F.lit(100.0)) \
        .otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - (n + d).cast("double") * 5.0))
    return counts.select(
        F.lit("completeness").alias("name"), F.round(score, 2).alias("score"),
        (score >= pass_mark).alias("passed"),
        F.concat(F.lit("null keys: "), n.cast("string"), F.lit(", duplicate keys: "),
                 d.cast("string")).alias("notes"))


def layer_totals(dwd: DataFrame, dws: DataFrame, ads: DataFrame, dwt: DataFrame | None = None,
                 dws_all: DataFrame | None = None) -> DataFrame:
    """Totals of each layer in one row (one aggregation over a tagged union).

    ``dwd`` must cover the same window as ``dws`` / ``ads``; ``dwt`` is the
    lifetime topic built from ``dws_all``.
    """
    parts = [
        dwd.select(F.lit("dwd").alias("_l"), F.col("order_amount").cast("decimal(28,2)").alias("_g"),
                   F.lit(1).cast("bigint").alias("_n")),
        dws.select(F.lit("dws").alias("_l"), F.col("gmv").cast("decimal(28,2)").alias("_g"),
                   F.col("order_cnt").cast("bigint").alias("_n")),
        ads.select(F.lit("ads").alias("_l"), F.col("gmv").cast("decimal(28,2)").alias("_g"),
                   F.col("order_cnt").cast("bigint").alias("_n")),
    ]
    if dwt is not None and dws_all is not None:
        parts.append(dwt.select(F.lit("dwt").alias("_l"),
                                F.col("lifetime_gmv").cast("decimal(28,2)").alias("_g"),
                                F.col("lifetime_order_cnt").cast("bigint").alias("_n")))
        parts.append(dws_all.select(F.lit("dws_all").alias("_l"), F.col("gmv").cast("decimal(28,2)").alias("_g"),
                                    F.col("order_cnt").cast("bigint").alias("_n")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    aggs = []
    for lyr in ["dwd", "dws", "ads", "dwt", "dws_all"]:
        aggs.append(F.sum(F.when(F.col("_l") == lyr, F.col("_g"))).alias(f"{lyr}_gmv"))
        aggs.append(F.sum(F.when(F.col("_l") == lyr, F.col("_n"))).alias(f"{lyr}_orders"))
    return u.agg(*aggs)


def report_consistency(totals: DataFrame, pass_mark: float = 95.0) -> DataFrame:
    """Q18 — share of conservation checks that hold across layers × 100.

    Checks: DWD→DWS gmv and orders, DWS→ADS gmv and orders, and (when present)
    DWS→DWT lifetime gmv and orders. A check whose inputs are absent is skipped
    (NULL), not failed.
    """
    pairs = [("dwd", "dws"), ("dws", "ads"), ("dws_all", "dwt")]
    checks = []
    for a, b in pairs:
        for m in ("gmv", "orders"):
            x, y = F.col(f"{a}_{m}"), F.col(f"{b}_{m}")
            checks.append(F.when(x.isNull() | y.isNull(), F.lit(None).cast("int"))
                          .when(x == y, F.lit(1)).otherwise(F.lit(0)))
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in checks), F.lit(0))
    held = sum((F.coalesce(c, F.lit(0)) for c in checks), F.lit(0))
    score = F.when(present > 0, held.cast("double") * 100.0 / present.cast("double"))
    return totals.select(
        F.lit("consistency").alias("name"), F.round(score, 2).alias("score"),
        (F.coalesce(score, F.lit(0.0)) >= pass_mark).alias("passed"),
        F.concat(held.cast("string"), F.lit(" of "), present.cast("string"),
                 F.lit(" layer checks hold")).alias("notes"))


def performance_score(elapsed_ms: float, full_ms: float = 100.0, zero_ms: float = 1000.0) -> float:
    """Q19 scoring rule: clamp(100 − (ms − full)/((zero − full)/100), 0, 100)."""
    step = (zero_ms - full_ms) / 100.0
    return max(0.0, min(100.0, 100.0 - (elapsed_ms - full_ms) / step))


def report_performance(df: DataFrame, amount: str = "order_amount", pass_mark: float = 50.0,
                       full_ms: float = 100.0, zero_ms: float = 1000.0) -> DataFrame:
    """Q19 — time the count+sum probe on the driver and score it."""
    ms = time_action(perf_full_agg(df, amount))
    score = round(performance_score(ms, full_ms, zero_ms), 2)
    spark = df.sparkSession
    return spark.createDataFrame(
        [("performance", float(score), bool(score >= pass_mark), f"full aggregate took {ms:.1f} ms")],
        "name string, score double, passed boolean, notes string")


def quality_report(*dimension_rows: DataFrame) -> DataFrame:
    """Q20 — the dimension rows plus an ``overall`` row = all passed (rows whose
    score is NULL, i.e. skipped, are excluded from the verdict)."""
    u = dimension_rows[0]
    for d in dimension_rows[1:]:
        u = u.unionByName(d)
    overall = u.agg(F.bool_and(F.when(F.col("score").isNotNull(), F.col("passed"))).alias("passed"),
                    F.count(F.col("score")).alias("_n")) \
        .select(F.lit("overall").alias("name"), F.lit(None).cast("double").alias("score"),
                F.coalesce("passed", F.lit(False)).alias("passed"),
                F.concat(F.col("_n").cast("string"), F.lit(" dimensions scored")).alias("notes"))
    return u.unionByName(overall)
