"""Metric system (M01–M04), domain KPIs (M05–M14) and top-k.

Atomic metric = measure + one of six aggregates; derived metric = atomic +
modifiers (predicates) + period. A metric set is compiled into *one*
``groupBy().agg(...)`` so any number of metrics costs a single scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlayer.functions.exprs import in_period, lit_date, period_start, ratio
from starlayer.functions.segments import carry, segment

# The six legal aggregations of an atomic metric.
VALID_AGGREGATIONS = ("SUM", "COUNT", "COUNT_DISTINCT", "AVG", "MAX", "MIN")


@dataclass(frozen=True)
class AtomicMetric:
    name: str
    process: str
    aggregation: str
    measure: str

    def __post_init__(self):
        agg = (self.aggregation or "").upper()
        if agg not in VALID_AGGREGATIONS:
            raise ValueError(f"illegal aggregation {self.aggregation!r}; legal: {sorted(VALID_AGGREGATIONS)}")
        if not self.measure or not self.measure.strip():
            raise ValueError("measure field must not be empty")
        object.__setattr__(self, "aggregation", agg)


@dataclass(frozen=True)
class DerivedMetric:
    atomic: AtomicMetric
    modifiers: tuple = field(default_factory=tuple)  # (label, SQL predicate) pairs
    period: str = "1d"

    @property
    def name(self) -> str:
        """period + modifiers + atomic name, as the naming rule composes it."""
        return " ".join([self.period] + [m[0] for m in self.modifiers] + [self.atomic.name])

    @property
    def column(self) -> str:
        return re.sub(r"[^0-9A-Za-z_]+", "_", self.name).strip("_").lower()


def metric_expr(atomic: AtomicMetric, pred: Column | None = None) -> Column:
    """Aggregate expression of an atomic metric restricted to ``pred``."""
    v = F.col(atomic.measure)
    if pred is not None:
        v = F.when(pred, v)
    a = atomic.aggregation
    if a == "SUM":
        return F.sum(v)
    if a == "COUNT":
        return F.count(v)
    if a == "COUNT_DISTINCT":
        return F.countDistinct(v)
    if a == "AVG":
        return ratio(F.sum(v), F.count(v), 2)
    if a == "MAX":
        return F.max(v)
    return F.min(v)


def _pred(dm: DerivedMetric, as_of, date_col: str) -> Column:
    p = in_period(date_col, dm.period, as_of)
    for _label, sql in dm.modifiers:
        p = p & F.expr(sql)
    return p


def metric_atomic(df: DataFrame, by: list[str], metrics: list[AtomicMetric]) -> DataFrame:
    """M01 — atomic metrics per group, one aggregation."""
    return df.groupBy(*by).agg(*[metric_expr(m).alias(m.name) for m in metrics])


def metric_set_one_pass(df: DataFrame, by: list[str], metrics: list[DerivedMetric], as_of,
                        date_col: str = "order_date") -> DataFrame:
    """M02/M03 — many derived metrics × group columns in a single scan.

    The scan is first limited to the union of the periods (pushed to parquet),
    then every metric is a conditional aggregate in one ``agg``.
    """
    starts = [period_start(m.period, as_of) for m in metrics if m.period.lower() != "td"]
    src = df.filter(F.col(date_col) <= lit_date(as_of))
    if len(starts) == len(metrics) and starts:
        src = src.filter(F.col(date_col) >= F.least(*starts) if len(starts) > 1 else F.col(date_col) >= starts[0])
    return src.groupBy(*by).agg(*[metric_expr(m.atomic, _pred(m, as_of, date_col)).alias(m.column)
                                  for m in metrics])


def metric_derived(df: DataFrame, by: list[str], metric: DerivedMetric, as_of,
                   date_col: str = "order_date") -> DataFrame:
    """M02 — one derived metric."""
    return metric_set_one_pass(df, by, [metric], as_of, date_col)


def metric_periods(df: DataFrame, by: list[str], atomic: AtomicMetric, as_of,
                   periods=("1d", "7d", "mtd", "td"), date_col: str = "order_date") -> DataFrame:
    """M04 — one atomic metric over several periods ending at ``as_of``."""
    ms = [DerivedMetric(atomic, (), p) for p in periods]
    return metric_set_one_pass(df, by, ms, as_of, date_col)


# --- domain KPIs over the event stream -------------------------------------------

def _day(ts: str = "ts") -> Column:
    return F.col(ts).cast("date")


def kpi_pv_uv(events: DataFrame, view: str = "view") -> DataFrame:
    """M05 — per day: view events and distinct viewing users."""
    v = events.filter(F.col("event_type") == view)
    return v.groupBy(_day().alias("day")).agg(F.count(F.lit(1)).alias("pv"),
                                              F.countDistinct("user_id").alias("uv"))


def kpi_ctr(events: DataFrame) -> DataFrame:
    """M06 — per day: clicks / views as a ratio of sums."""
    e = events.filter(F.col("event_type").isin("view", "click"))
    g = e.groupBy(_day().alias("day")).agg(
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("views"))
    return g.withColumn("ctr", ratio(F.col("clicks"), F.col("views"), 4))


def kpi_dau_mau(events: DataFrame) -> DataFrame:
    """M07 — distinct active users per day and per month (``grain`` column)."""
    d = events.groupBy(_day().alias("period")).agg(F.countDistinct("user_id").alias("active_users")) \
        .withColumn("grain", F.lit("day"))
    m = events.groupBy(F.trunc(_day(), "month").alias("period")) \
        .agg(F.countDistinct("user_id").alias("active_users")).withColumn("grain", F.lit("month"))
    return d.unionByName(m)


def kpi_retention(events: DataFrame, days=(1, 3, 7)) -> DataFrame:
    """M08 — cohort = first active day; share of the cohort active again on
    day 1, 3 and 7. Distinct (user, day) activity is aggregated first, so a user
    counts once a day without COUNT DISTINCT; the per-user first day is a grouped
    min joined back on the user."""
    act = events.select("user_id", _day().alias("day")).distinct()
    first = act.groupBy("user_id").agg(F.min("day").alias("cohort_date"))
    j = act.join(first, "user_id").withColumn("k", F.datediff("day", "cohort_date"))
    aggs = [F.count(F.when(F.col("k") == 0, 1)).alias("cohort_size")]
    for n in days:
        aggs.append(F.count(F.when(F.col("k") == n, 1)).alias(f"retained_d{n}"))
    g = j.groupBy("cohort_date").agg(*aggs)
    for n in days:
        g = g.withColumn(f"retention_d{n}", ratio(F.col(f"retained_d{n}"), F.col("cohort_size"), 4))
    return g


def kpi_repurchase_rate(orders: DataFrame, cust: str = "o_custkey", date_col: str = "o_orderdate") -> DataFrame:
    """M09 — per month: buyers with ≥ 2 orders / buyers (two-level groupBy)."""
    per = orders.groupBy(F.trunc(F.col(date_col).cast("date"), "month").alias("month"), cust) \
        .agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("month").agg(F.count(F.lit(1)).alias("buyers"),
                                 F.count(F.when(F.col("n") >= 2, 1)).alias("repeat_buyers"))
    return g.withColumn("repurchase_rate", ratio(F.col("repeat_buyers"), F.col("buyers"), 4))


def kpi_refund_rate(lines: DataFrame, amount: str = "gross", flag: str = "l_returnflag",
                    date_col: str = "l_shipdate") -> DataFrame:
    """M10 — per month: returned lines / lines and returned amount / amount."""
    r = F.col(flag) == "R"
    g = lines.groupBy(F.trunc(F.col(date_col).cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(r, 1)).alias("returned_lines"),
        F.sum(amount).alias("amount"), F.sum(F.when(r, F.col(amount))).alias("returned_amount"))
    return (g.withColumn("line_refund_rate", ratio(F.col("returned_lines"), F.col("lines"), 4))
            .withColumn("amount_refund_rate", ratio(F.col("returned_amount"), F.col("amount"), 4)))


def kpi_conversion_funnel(events: DataFrame, steps=("view", "click", "purchase")) -> DataFrame:
    """M11 — users reaching each step at or after the previous step's first
    time, per cohort of first-step day.

    The first step is a grouped ``min`` (partial aggregation absorbs hot users);
    each further one joins its own events, read once, to the users so far and
    takes the first that is late enough. A scan and a shuffle per step: the
    grouping keeps the partitioning of the join.
    """
    e = events.select("user_id", "event_type", "ts")
    cur = e.filter(F.col("event_type") == steps[0]).groupBy("user_id").agg(F.min("ts").alias("t0"))
    for i, s in enumerate(steps[1:], start=1):
        nxt = e.filter(F.col("event_type") == s).select("user_id", F.col("ts").alias("_ts"))
        late = F.min(F.when(F.col("_ts") >= F.col(f"t{i - 1}"), F.col("_ts")))
        # the times are per user, so grouping by the user alone is the same
        cur = cur.join(nxt, "user_id", "left").groupBy("user_id").agg(
            *[F.any_value(f"t{k}").alias(f"t{k}") for k in range(i)], late.alias(f"t{i}"))
    aggs = [F.count(F.col(f"t{i}")).alias(f"{s}_users") for i, s in enumerate(steps)]
    g = cur.groupBy(F.col("t0").cast("date").alias("cohort_date")).agg(*aggs)
    for a, b in zip(steps, steps[1:]):
        g = g.withColumn(f"{a}_to_{b}_rate", ratio(F.col(f"{b}_users"), F.col(f"{a}_users"), 4))
    return g


def sessions_bounce(events: DataFrame, gap_minutes: int = 30, user: str = "user_id",
                    ts: str = "ts", tie: str = "event_id", parts: int | None = None) -> DataFrame:
    """M12 — sessions (a user's events with gaps ≤ ``gap_minutes``) and bounce
    rate (one-event sessions / sessions) per session-start day.

    An event starts a session when its gap to the one before is too long, and is
    a session of its own when the gap after it is too: both are counted on the
    day of the start, no session is put together. A user with more events than a
    task should hold is cut into segments along time, each with the event before
    and after it. Events without time belong to no day and are left out.
    """
    gap = gap_minutes * 60 * 1_000_000
    e = events.select(user, ts, tie).where(F.col(ts).isNotNull())
    s = carry(segment(e, [user], [F.col(ts), F.col(tie)], parts), before=True, after=True)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    before, after = F.lag(at).over(s.window()), F.lead(at).over(s.window())
    cut = s.own(s.rows.withColumn("_new", before.isNull() | (at - before > gap))
                .withColumn("_last", after.isNull() | (after - at > gap)))
    g = cut.where("_new").groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count(F.when(F.col("_last"), 1)).alias("bounces"))
    return g.withColumn("bounce_rate", ratio(F.col("bounces"), F.col("sessions"), 4))


def new_vs_returning(dwd: DataFrame, user: str = "user_id", date_col: str = "order_date",
                     number: str = "order_no", amount: str = "order_amount") -> DataFrame:
    """M13 — per month: orders and gmv of first-time vs returning customers.
    A customer is new in the month of their first order. Lines are summed per
    (user, month, order) first; the first month, a grouped min joined back on
    the user, and the distinct counts read those sums only."""
    per = dwd.groupBy(user, F.trunc(date_col, "month").alias("month"), number).agg(F.sum(amount).alias(amount))
    j = per.join(per.groupBy(user).agg(F.min("month").alias("_first")), user)
    j = j.withColumn("customer_type", F.when(F.col("month") == F.col("_first"), "new").otherwise("returning"))
    return j.groupBy("month", "customer_type").agg(F.countDistinct(number).alias("orders"),
                                                   F.sum(amount).alias("gmv"),
                                                   F.countDistinct(user).alias("customers"))


def average_order_value(dwd: DataFrame, by: list[str], number: str = "order_no",
                        amount: str = "order_amount") -> DataFrame:
    """M14 — gmv / orders at any grouping (ratio of sums)."""
    g = dwd.groupBy(*by).agg(F.sum(amount).alias("gmv"), F.countDistinct(number).alias("orders"))
    return g.withColumn("aov", ratio(F.col("gmv"), F.col("orders"), 2))


def topk(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Top-k report: ``orderBy(...).limit(k)`` is planned as a
    TakeOrderedAndProject — each partition keeps k rows, one task merges them."""
    return df.orderBy(*order).limit(k)
