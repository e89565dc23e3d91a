"""Join shapes of the dimensional model (J01–J03, J08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlayer.functions.joins import bounded_broadcast
from starlayer.functions.segments import carry, segment


def join_star(fact: DataFrame, dims: list[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """J01 — fact ⋈ conformed dimensions on equi keys.

    ``dims`` holds (dimension, fact key, dimension key). Dimensions are
    broadcast only when the optimizer's size estimate proves them small;
    otherwise the planner shuffles (and AQE may still broadcast at runtime).
    """
    out = fact
    for dim, fk, dk in dims:
        d = bounded_broadcast(dim)
        out = out.join(d, out[fk] == d[dk], how)
    return out


def join_zipper_asof(fact: DataFrame, zipper: DataFrame, fact_key: str, zip_key: str,
                     fact_date: str, parts: int | None = None) -> DataFrame:
    """J02 — point-in-time join: key equal and ``start_date <= dt < end_date``.
    Every fact row stays, with NULLs where no version holds.

    Facts and versions are laid into one sequence by (key, time), where a fact
    takes the last version before it: one shuffle and one sort, linear in the
    rows of a key, however many versions it has. A key with more rows than a
    task should hold is cut into segments, each with the version that holds at
    its start. Versions of a key must not overlap (``zipper_check``); ones
    without key or start hold for no fact, nor do any for a NULL key or date.
    """
    cols = [c for c in zipper.columns if c != zip_key]
    f_row = F.struct(*[F.col(f"`{c}`") for c in fact.columns])
    z_row = F.struct(*[F.col(f"`{c}`") for c in cols])
    facts = fact.select(F.col(fact_key).alias("_key"), F.col(fact_date).cast("date").alias("_at"), f_row.alias("_fact"))
    facts = facts.withColumn("_tie", F.xxhash64("_fact"))
    held = zipper.where(F.col(zip_key).isNotNull() & F.col("start_date").isNotNull()).select(
        F.col(zip_key).alias("_key"), F.col("start_date").alias("_at"), z_row.alias("_version"), F.lit(None).cast("long").alias("_tie"))
    both = facts.unionByName(held, allowMissingColumns=True)
    # a version stands before the facts of its day; the tie only parts segments
    order = [F.col("_at"), F.col("_fact").isNotNull(), F.col("_tie")]
    s = carry(segment(both, ["_key"], order, parts), of=F.col("_version").isNotNull())
    w = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an exchange of its own: a union of two key-partitioned sides is not partitioned by the key
    rows = s.rows if s.cut else s.rows.repartition("_key")
    out = s.own(rows.withColumn("_version", F.last("_version", ignorenulls=True).over(w))).where(F.col("_fact").isNotNull())
    holds = (F.col("_version.start_date") <= F.col("_at")) & (F.col("_at") < F.col("_version.end_date"))
    return out.select(*[F.col(f"_fact.`{c}`").alias(c) for c in fact.columns],
                      *[F.when(holds, F.col(f"_version.`{c}`")).alias(c) for c in cols])


def join_bridge_weighted(fact: DataFrame, bridge: DataFrame, dim: DataFrame, fact_key: str,
                         bridge_group: str, bridge_member: str, dim_key: str, group_by: list[str],
                         measure: str, weight: str = "weight") -> DataFrame:
    """J03 — fact ⋈ bridge ⋈ dimension with measure × weight, so the totals
    over any dimension grouping add up to the fact total (no double count)."""
    b = bridge.select(F.col(bridge_group).alias("_g"), F.col(bridge_member).alias("_m"), weight)
    j = fact.join(b, fact[fact_key] == b["_g"])
    d = bounded_broadcast(dim)
    j = j.join(d, j["_m"] == d[dim_key])
    return j.groupBy(*group_by).agg(
        F.sum(F.col(measure).cast("decimal(18,2)") * F.col(weight)).alias("weighted_amount"),
        F.sum(F.col(weight)).alias("weighted_count"))


def drill_across(facts: list[tuple[DataFrame, list[str], dict]], keys: list[str]) -> DataFrame:
    """J08 — combine several facts by conformed dimensions: aggregate each
    fact to the shared keys first, then full outer join the small results.

    ``facts`` holds (frame, key columns in that frame, {out_name: agg Column}).
    """
    out = None
    for df, fkeys, aggs in facts:
        a = df.groupBy(*[F.col(k).alias(n) for k, n in zip(fkeys, keys)]).agg(
            *[c.alias(n) for n, c in aggs.items()])
        out = a if out is None else out.join(a, keys, "full_outer")
    return out
