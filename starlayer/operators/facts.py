"""Fact-table constructions (F01–F15): transaction, periodic snapshots (sparse,
dense, weekly, monthly), accumulating snapshots with batch upsert,
period-to-date aggregates, non- and semi-additive measures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlayer.functions.exprs import MONEY, in_period, lit_date, ratio
from starlayer.session import ensure_checkpoint_dir
from starlayer.sources.sinks import clustered


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- transaction -------------------------------------------------------------

def fact_transaction(df: DataFrame, number: str, dim_keys: list[str], event_time: str,
                     measures: list[str], dt_col: str = "dt") -> DataFrame:
    """F01 — one row per event: business number, dimension keys, event time,
    measures and the ``dt`` partition value (date of the event)."""
    return df.select(number, *dim_keys, event_time, *measures,
                     F.col(event_time).cast("date").alias(dt_col))


# --- periodic snapshots ----------------------------------------------------------

def fact_periodic_sparse(df: DataFrame, entity: str, ts: str, value_cols: list[str],
                         tie: str | None = None, grain: str = "day") -> DataFrame:
    """F02/F04 — last state per entity per period (day, week or month).

    ``row_number() == 1`` over (entity, period) ordered by update time desc
    (then ``tie`` desc) — a partial window-group-limit runs before the shuffle.
    """
    if grain == "day":
        p = F.col(ts).cast("date")
    elif grain == "week":
        p = F.date_trunc("week", F.col(ts)).cast("date")
    elif grain == "month":
        p = F.trunc(F.col(ts).cast("date"), "month")
    else:
        raise ValueError(grain)
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(entity, "snapshot_date").orderBy(*order)
    return (df.withColumn("snapshot_date", p)
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(entity, "snapshot_date", *value_cols, F.col(ts).alias("state_ts")))


def fact_periodic_weekly(df, entity, ts, value_cols, tie=None):
    """F04 (week end state)."""
    return fact_periodic_sparse(df, entity, ts, value_cols, tie, "week")


def fact_periodic_monthly(df, entity, ts, value_cols, tie=None):
    """F04 (month end state)."""
    return fact_periodic_sparse(df, entity, ts, value_cols, tie, "month")


def fact_periodic_dense(sparse: DataFrame, entity: str, value_cols: list[str], as_of,
                        date_col: str = "snapshot_date") -> DataFrame:
    """F03 — one row per entity and day from its first state to ``as_of``,
    carrying the last state forward.

    Instead of joining a calendar × entity grid, each sparse state is expanded
    over the days until the entity's next state (``lead``); the output is
    produced directly from the sparse rows, with no join and no skewed group.
    """
    w = Window.partitionBy(entity).orderBy(date_col)
    nxt = F.lead(date_col).over(w)
    upto = F.coalesce(F.date_sub(nxt, 1), lit_date(as_of))
    s = sparse.filter(F.col(date_col) <= lit_date(as_of)).withColumn("_upto", upto)
    return s.select(entity, F.explode(F.sequence(F.col(date_col), F.col("_upto"))).alias(date_col),
                    *value_cols)


# --- accumulating snapshots --------------------------------------------------------

def _milestone_aggs(process_col: str, ts_col: str, milestones):
    aggs = []
    for m in milestones:
        name, proc, how = (m, m, "min") if isinstance(m, str) else m
        v = F.when(F.col(process_col) == proc, F.col(ts_col))
        aggs.append((F.min(v) if how == "min" else F.max(v)).alias(f"{name}_ts"))
    return aggs


def _names(milestones):
    return [m if isinstance(m, str) else m[0] for m in milestones]


def accumulating_status(milestones) -> Column:
    """F06 — ``complete`` = all milestones present and in order; ``abnormal`` =
    two consecutive present milestones out of order; else ``in_progress``."""
    names = _names(milestones)
    cols = [F.col(f"{n}_ts") for n in names]
    bad = F.lit(False)
    for a, b in zip(cols, cols[1:]):
        bad = bad | F.coalesce(b < a, F.lit(False))
    allp = F.lit(True)
    for c in cols:
        allp = allp & c.isNotNull()
    return F.when(bad, "abnormal").when(allp, "complete").otherwise("in_progress")


def _finish_accumulating(df: DataFrame, key, milestones) -> DataFrame:
    names = _names(milestones)
    keys = [key] if isinstance(key, str) else list(key)
    durs = [F.expr(f"timestampdiff(SECOND, `{a}_ts`, `{b}_ts`)").cast("bigint")
            .alias(f"{a}_to_{b}_sec") for a, b in zip(names, names[1:])]
    return df.select(*keys, *[f"{n}_ts" for n in names], *durs,
                     accumulating_status(milestones).alias("end_status"),
                     F.col(f"{names[0]}_ts").cast("date").alias("start_dt"))


def fact_accumulating(events: DataFrame, key, process_col: str, ts_col: str, milestones) -> DataFrame:
    """F05/F06 — one row per life cycle: a timestamp per milestone, seconds
    between consecutive milestones, ``end_status`` and ``start_dt``.

    ``milestones`` lists names (first time of that process) or
    ``(name, process, 'min'|'max')``. One grouped aggregate with partial
    aggregation: each key's events collapse map-side before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    acc = events.groupBy(*keys).agg(*_milestone_aggs(process_col, ts_col, milestones))
    return _finish_accumulating(acc, key, milestones)


def fact_accumulating_upsert(current: DataFrame | None, batch_events: DataFrame, key, process_col: str,
                             ts_col: str, milestones) -> DataFrame:
    """F07 — apply one batch: new keys are inserted, a first-time milestone is
    filled only while still NULL, a last-time (``max``) one takes the later
    time, durations and status are recomputed.

    Batches cut by event time arrive in order, so the first value seen is the
    minimum and the result equals a full build.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = _names(milestones)
    b = batch_events.groupBy(*keys).agg(*_milestone_aggs(process_col, ts_col, milestones))
    if current is None:
        return _finish_accumulating(b, key, milestones)
    cur = current.select(*keys, *[F.col(f"{n}_ts").alias(f"_o_{n}") for n in names])
    nb = b.select(*keys, *[F.col(f"{n}_ts").alias(f"_n_{n}") for n in names])
    j = cur.join(nb, keys, "full_outer")
    last = {m[0] for m in milestones if not isinstance(m, str) and m[2] == "max"}
    merged = j.select(*keys, *[(F.greatest if n in last else F.coalesce)(F.col(f"_o_{n}"), F.col(f"_n_{n}")).alias(f"{n}_ts")
                               for n in names])
    return _finish_accumulating(merged, key, milestones)


def fact_accumulating_batches(events: DataFrame, key, process_col: str, ts_col: str, milestones,
                              cuts: list, checkpoint_every: int = 4) -> DataFrame:
    """Apply F07 batch by batch over event-time windows delimited by ``cuts``.

    Lineage is cut with a reliable ``checkpoint()`` (to the shared checkpoint
    folder) every ``checkpoint_every`` batches so the plan stays bounded.
    """
    bounds = [None] + list(cuts) + [None]
    cur = None
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        pred = F.lit(True)
        if lo is not None:
            pred = pred & (F.col(ts_col) >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            pred = pred & (F.col(ts_col) < F.lit(hi).cast("timestamp_ntz"))
        cur = fact_accumulating_upsert(cur, events.filter(pred), key, process_col, ts_col, milestones)
        if checkpoint_every and (i + 1) % checkpoint_every == 0:
            ensure_checkpoint_dir(events.sparkSession)
            cur = cur.checkpoint()
    return cur


# --- aggregated facts ----------------------------------------------------------------

def fact_aggregated_td(df: DataFrame, by: list[str], measures: dict[str, str], as_of,
                       periods=("mtd", "ytd", "td"), date_col: str = "order_date") -> DataFrame:
    """F08 — period-to-date aggregates in one scan: for each period code a
    conditional sum per measure (``<measure>_<period>``) and a row count."""
    src = df.filter(F.col(date_col) <= lit_date(as_of))
    aggs = []
    for p in periods:
        cond = in_period(date_col, p, as_of)
        aggs.append(F.count(F.when(cond, 1)).alias(f"rows_{p}"))
        for out, col in measures.items():
            aggs.append(F.sum(F.when(cond, F.col(col))).alias(f"{out}_{p}"))
    return src.groupBy(*by).agg(*aggs)


_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def parse_ratio(formula: str) -> tuple[str, str]:
    """A non-additive measure is ``numerator / denominator`` — exactly one '/'."""
    if formula is None or not formula.strip():
        raise ValueError("empty ratio formula")
    if formula.count("/") != 1:
        raise ValueError("ratio formula must contain exactly one '/'")
    num, den = (x.strip() for x in formula.split("/"))
    if not num or not den:
        raise ValueError("ratio formula needs a numerator and a denominator")
    return num, den


def ratio_of_sums(df: DataFrame, by: list[str], formula: str, name: str = "value",
                  scale: int = 6) -> DataFrame:
    """F09 — SUM(numerator) / NULLIF(SUM(denominator), 0), stored with its parts."""
    num, den = parse_ratio(formula)
    n = F.expr(num) if not _IDENT.match(num) else F.col(num)
    d = F.expr(den) if not _IDENT.match(den) else F.col(den)
    return (df.groupBy(*by).agg(F.sum(n).alias("numerator"), F.sum(d).alias("denominator"))
            .withColumn(name, ratio(F.col("numerator"), F.col("denominator"), scale)))


def ratio_wrong_vs_right(df: DataFrame, by: list[str], num: str, den: str, scale: int = 6) -> DataFrame:
    """F10 — average of row ratios (wrong) next to the ratio of sums (right)."""
    row_ratio = ratio(F.col(num), F.col(den), scale, as_double=False)
    return (df.withColumn("_r", row_ratio).groupBy(*by)
            .agg(ratio(F.sum("_r"), F.count("_r"), scale).alias("avg_of_ratios"),
                 ratio(F.sum(num), F.sum(den), scale).alias("ratio_of_sums")))


def semi_additive_last(df: DataFrame, entity: str, ts: str, value: str, by: list[str],
                       tie: str | None = None) -> DataFrame:
    """F11 — closing value: last value per entity within each group (``by``
    includes the period), then summed over entities. ``max_by`` with a
    (time, tie) struct gives a deterministic last value in one aggregate."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    last = df.groupBy(*by, entity).agg(F.max_by(F.col(value), order).alias("_last"))
    return last.groupBy(*by).agg(F.sum("_last").alias("closing_value"),
                                 F.count(F.lit(1)).alias("entities"))


def semi_additive_avg(dense: DataFrame, entity: str, value: str, by: list[str]) -> DataFrame:
    """F12 — average over the days of the period per entity (dense snapshot),
    then summed over entities."""
    per = dense.groupBy(*by, entity).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    avg = ratio(F.col("_s"), F.col("_n"), 4, as_double=False)
    return per.groupBy(*by).agg(F.sum(avg).alias("avg_value_sum"),
                                F.count(F.lit(1)).alias("entities"))


def flow_sum(df: DataFrame, by: list[str], flow_cols: list[str]) -> DataFrame:
    """F13 — flows (durations, quantities) are additive over time: SUM."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(f"{c}_sum") for c in flow_cols],
                               *[F.count(c).alias(f"{c}_n") for c in flow_cols])


def derived_measure(df: DataFrame, gross: str, discount_rate: str, name: str = "net_amount") -> DataFrame:
    """F14 — paid amount = amount − discount, computed in decimal."""
    g = F.col(gross).cast(MONEY)
    disc = F.round(g * F.col(discount_rate).cast("decimal(18,4)"), 2).cast(MONEY)
    return df.withColumn("discount_amount", disc).withColumn(name, (g - disc).cast(MONEY))


def fact_per_process(df: DataFrame, process_col: str, path: str | None = None) -> DataFrame:
    """F15 — one transaction fact per process: written ``partitionBy(process)``
    (each process is its own folder; readers prune to theirs)."""
    if path is None:
        return df
    clustered(df, process_col).write.mode("overwrite").partitionBy(process_col).parquet(path)
    return df.sparkSession.read.parquet(path)

