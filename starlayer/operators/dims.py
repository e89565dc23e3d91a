"""Dimension constructions (D01–D16): SCD 1/2/3, zipper tables, junk and mini
dimensions, weighted bridges, array fields, the date dimension and conformed
dimensions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlayer.functions.exprs import lit_date
from starlayer.functions.joins import bounded_broadcast
from starlayer.functions.segments import SIDE, Segmented, carry, rank, segment
from starlayer.session import ensure_checkpoint_dir, scratch_dir

OPEN_END = _dt.date(9999, 12, 31)


def _changed(attrs: list[str], w) -> Column:
    """True on the first row of a key and whenever any attribute differs from
    the previous row (NULL-safe: NULL → NULL is no change)."""
    first = F.lag(F.lit(1)).over(w).isNull()
    diff = F.lit(False)
    for a in attrs:
        diff = diff | ~F.lag(F.col(a)).over(w).eqNullSafe(F.col(a))
    return first | diff


def scd_versions(log: DataFrame, key: str, date_col: str, attrs: list[str],
                 start: str = "effective_date", end: str = "expiry_date",
                 current: str | None = "is_current", tie: str | None = None, parts: int | None = None) -> DataFrame:
    """Version chain from a change log: one row per run of equal attribute
    values, ``[start, end)`` half-open, the open end 9999-12-31.

    A key with more rows than a task should hold is cut into segments along its
    dates: the row before a segment decides whether its first row is a change,
    and the first change after it ends its last version. Other keys take both
    windows in one shuffle and one sort.
    """
    order = [F.col(date_col)] + ([F.col(tie)] if tie else [])
    cols = list(dict.fromkeys([key, *attrs, date_col, *([tie] if tie else [])]))
    s = carry(segment(log.select(*cols), [key], order, parts))
    v = s.rows.withColumn("_chg", _changed(attrs, s.window())).filter("_chg")
    if s.cut:
        # changes are written once: their borders and their ends read them
        path = scratch_dir(log.sparkSession, "versions")
        v.where(F.col(SIDE) == 0).drop(SIDE, "_chg").write.parquet(path)
        s = carry(Segmented(log.sparkSession.read.parquet(path), [key], order, True), before=False, after=True)
        v = s.rows
    nxt = F.lead(F.col(date_col)).over(s.window())
    out = s.own(v.withColumn("_next", nxt)).select(
        key, *attrs, F.col(date_col).cast("date").alias(start),
        F.coalesce(F.col("_next").cast("date"), F.lit(OPEN_END)).alias(end))
    if current:
        out = out.withColumn(current, F.col(end) == F.lit(OPEN_END))
    return out


def scd1_overwrite(log: DataFrame, key: str, date_col: str, attrs: list[str],
                   tie: str | None = None) -> DataFrame:
    """D01 — current value only (latest row per key)."""
    order = [F.col(date_col).desc()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    return (log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(key, *attrs, F.col(date_col).cast("date").alias("updated_date")))


def scd2_build(log: DataFrame, key: str, date_col: str, attrs: list[str]) -> DataFrame:
    """D02 — full history with effective/expiry dates and ``is_current``."""
    return scd_versions(log, key, date_col, attrs)


def scd2_merge(dim: DataFrame, batch: DataFrame, key: str, date_col: str, attrs: list[str]) -> DataFrame:
    """D03 — apply a change batch (dates after the dimension's) to an SCD2 table.

    Only keys present in the batch are recomputed: their current row is put
    back into the change log ahead of the batch rows and the version chain is
    rebuilt for them; all other rows pass through untouched. A changed current
    row is closed on the first change date and the new row opens that day.
    Applying batches in order equals :func:`scd2_build` over the whole log.
    ``dim`` is read several times (closed rows, current rows, their dates):
    pass the stored table of the previous run, not an unmaterialised plan.
    """
    closed = dim.filter(~F.col("is_current"))
    cur = dim.filter(F.col("is_current"))
    # Rerun safety: only changes after a key's current version count; a batch
    # applied twice (or a late re-delivery) leaves the table unchanged.
    # Keys are renamed on the side derived from ``dim`` so no join compares a
    # lineage with itself (self-join attribute ambiguity).
    eff = cur.select(F.col(key).alias("_ek"), F.col("effective_date").alias("_eff"))
    bb = batch.select(key, *attrs, date_col)
    b = (bb.join(eff, bb[key] == eff["_ek"], "left")
         .filter(F.col("_eff").isNull() | (F.col(date_col).cast("date") > F.col("_eff"))).drop("_ek", "_eff"))
    touched = b.select(F.col(key).alias("_tk")).distinct()
    cur_keep = cur.join(touched, cur[key] == touched["_tk"], "left_anti")
    cur_redo = cur.join(touched, cur[key] == touched["_tk"], "left_semi").select(
        key, *attrs, F.col("effective_date").alias(date_col))
    # The union (touched keys only, small) is checkpointed: with
    # spark.sql.unionOutputPartitioning (on by default in Spark 4.1) the window
    # trusted the union of two key-partitioned children to be partitioned by
    # the key and produced duplicate chains when AQE read the children with
    # different partition layouts (found by a property test). A reliable
    # checkpoint gives the window a plain input and its own exchange.
    ensure_checkpoint_dir(dim.sparkSession)
    redo = scd_versions(cur_redo.unionByName(b).checkpoint(), key, date_col, attrs)
    return closed.unionByName(cur_keep).unionByName(redo)


def scd3_prev(log: DataFrame, key: str, date_col: str, attr: str) -> DataFrame:
    """D04 — current and previous value of one attribute as columns."""
    v = scd_versions(log, key, date_col, [attr], current=None)
    # the two latest versions: a rank limit that each map task applies first
    w = Window.partitionBy(key).orderBy(F.col("effective_date").desc())
    two = v.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    at = lambda n, c: F.max(F.when(F.col("_rn") == n, F.col(c)))
    return two.groupBy(key).agg(at(1, attr).alias(f"current_{attr}"), at(2, attr).alias(f"previous_{attr}"),
                                at(1, "effective_date").alias("changed_date"))


def zipper_build(log: DataFrame, key: str, date_col: str, attrs: list[str]) -> DataFrame:
    """D05 — zipper (chain) table: ``start_date`` / ``end_date`` per value run."""
    return scd_versions(log, key, date_col, attrs, "start_date", "end_date", None)


def zipper_snapshot_at(zipper: DataFrame, d) -> DataFrame:
    """D06 — state of every key at date ``d`` (half-open range filter)."""
    x = lit_date(d)
    return zipper.filter((F.col("start_date") <= x) & (x < F.col("end_date")))


def zipper_check(zipper: DataFrame, key: str) -> DataFrame:
    """D07 — per key: versions, overlaps, gaps, open rows and ``ok``."""
    w = Window.partitionBy(key).orderBy("start_date", "end_date")
    nxt = F.lead("start_date").over(w)
    z = zipper.withColumn("_next", nxt)
    return (z.groupBy(key).agg(
        F.count(F.lit(1)).alias("versions"),
        F.count(F.when(F.col("_next") < F.col("end_date"), 1)).alias("overlaps"),
        F.count(F.when(F.col("_next") > F.col("end_date"), 1)).alias("gaps"),
        F.count(F.when(F.col("end_date") == F.lit(OPEN_END), 1)).alias("open_rows"))
        .withColumn("ok", (F.col("overlaps") == 0) & (F.col("gaps") == 0) & (F.col("open_rows") == 1)))


def _dense_key(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """Dense surrogate key over a distinct set of any size, in column order.

    The set is range-partitioned and written once, each row with its place in
    its sorted part, shifted by the counts of the parts before (a row per part)."""
    spark = df.sparkSession
    order = [F.col(c).asc_nulls_first() for c in cols]
    path = scratch_dir(spark, id_col)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # counts up from 0 in each part
    (df.select(*cols).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumns({"_part": F.spark_partition_id(), "_in": place}).write.parquet(path))
    d = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (d.join(F.broadcast(shift), "_part")
            .select((F.col("_in") + 1 + F.col("_before")).cast("bigint").alias(id_col), *cols))


def junk_build(df: DataFrame, flags: list[str]) -> DataFrame:
    """D08 — distinct flag combinations → ``junk_id`` + flags."""
    return _dense_key(df, flags, "junk_id")


def junk_attach(fact: DataFrame, junk: DataFrame, flags: list[str]) -> DataFrame:
    """D09 — replace the flags on the fact by ``junk_id`` (NULL-safe match).
    A junk dimension that proves small is broadcast, a larger one shuffles."""
    j = bounded_broadcast(junk.select("junk_id", *[F.col(f).alias(f"_j_{f}") for f in flags]))
    cond = None
    for f in flags:
        c = fact[f].eqNullSafe(j[f"_j_{f}"])
        cond = c if cond is None else cond & c
    return fact.join(j, cond, "left").drop(*flags, *[f"_j_{f}" for f in flags])


def band(col: str, edges: list[float], labels: list[str]) -> Column:
    """Band a numeric column: value < edges[i] → labels[i]; else labels[-1]."""
    e = None
    for edge, lab in zip(edges, labels):
        e = (F.when(F.col(col) < F.lit(edge), F.lit(lab)) if e is None
             else e.when(F.col(col) < F.lit(edge), F.lit(lab)))
    return e.otherwise(F.lit(labels[-1]))


def mini_build(df: DataFrame, key: str, band_cols: dict[str, Column]) -> DataFrame:
    """D10 — banded fast-changing attributes → mini dimension with ``mini_id``.
    Returns the mini dimension; ``mini_attach`` puts its key on the facts."""
    b = df.select(key, *[c.alias(n) for n, c in band_cols.items()])
    return _dense_key(b, list(band_cols), "mini_id")


def mini_attach(fact: DataFrame, main: DataFrame, key_fact: str, key_main: str,
                band_cols: dict[str, Column], mini: DataFrame) -> DataFrame:
    """D11 — the fact carries both the main dimension key and ``mini_id``."""
    names = list(band_cols)
    m = main.select(F.col(key_main).alias("_mk"), *[c.alias(n) for n, c in band_cols.items()])
    m = m.join(bounded_broadcast(mini), names, "left").select("_mk", "mini_id")
    return fact.join(m, fact[key_fact] == m["_mk"], "left").drop("_mk")


def bridge_build(df: DataFrame, group_key: str, member_key: str, weight_col: str = "weight",
                 extra_aggs: list[Column] | None = None, parts: int | None = None) -> DataFrame:
    """D12/D13 — bridge (group, member, weight) with equal weights by largest
    remainder: the unit is 10^-4, or smaller where that is not a thousandth of
    an equal share; every member gets the same number of whole units, and the
    units left over go one each to the last members in key order. No two weights
    of a group differ by more than a unit, and they sum to exactly 1
    (decimal(18,12): up to a billion members at that precision).

    Members per group are counted with a combine on the map side; places in a
    group come from segments, so a hot group is numbered by many tasks.
    """
    pairs = df.groupBy(group_key, member_key).agg(*(extra_aggs or [F.count(F.lit(1)).alias("_x")]))
    if not extra_aggs:
        pairs = pairs.drop("_x")
    per = pairs.groupBy(F.col(group_key).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    places = F.least(F.lit(12), F.greatest(F.lit(4), F.length(F.col("_n").cast("string")) + 3))
    own = F.expr("_units div _n") + F.when(F.col("_place") > F.col("_n") - F.col("_units") % F.col("_n"), 1).otherwise(0)
    ranked = rank(segment(pairs, [group_key], [F.col(member_key)], parts), "_place")
    return (ranked.join(per, F.col(group_key).eqNullSafe(F.col("_g")))
            .withColumn("_units", F.pow(F.lit(10.0), places).cast("long"))
            .withColumn(weight_col, (own.cast("decimal(13,0)") / F.col("_units").cast("decimal(13,0)")).cast("decimal(18,12)"))
            .drop("_g", "_n", "_units", "_place"))


def bridge_build_m2n(df: DataFrame, a: str, b: str, date_col: str) -> DataFrame:
    """D13 — (a_id, b_id, effective_date, weight)."""
    return bridge_build(df, a, b, extra_aggs=[F.min(F.col(date_col).cast("date")).alias("effective_date")])


def array_field_build(df: DataFrame, key: list[str], value: str, name: str = "values") -> DataFrame:
    """D14 — a short multi-value field (≤ 5 values) as a sorted array column.
    Per-key sets are bounded by the value domain; the partial aggregate
    dedups map-side."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias(name))


def array_field_filter(df: DataFrame, name: str, value: str) -> DataFrame:
    """D14 — rows whose array contains ``value``."""
    return df.filter(F.array_contains(F.col(name), value))


def array_from_json_filter(df: DataFrame, json_col: str, value: str) -> DataFrame:
    """D14 on a JSON array string (JSON_CONTAINS equivalent)."""
    return df.filter(F.array_contains(F.from_json(F.col(json_col), "array<string>"), value))


def dim_date(bounds: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """D15 — calendar rows from a one-row frame of bounds (e.g. min/max of a
    fact's dates): date, year, quarter, month, ISO week, ISO weekday, week and
    month start, weekend flag."""
    d = F.col("date")
    cal = bounds.select(F.explode(F.sequence(F.col(lo).cast("date"), F.col(hi).cast("date"))).alias("date"))
    iso_dow = ((F.dayofweek(d) + 5) % 7 + 1)
    return cal.select(
        "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.weekofyear(d).alias("iso_week"), iso_dow.alias("iso_dow"),
        F.date_trunc("week", d).cast("date").alias("week_start"),
        F.trunc(d, "month").alias("month_start"),
        (iso_dow >= 6).alias("is_weekend"))


def dim_conformed(sources: list[DataFrame], key: str, seen_col: str, attrs: list[str],
                  source_col: str = "source") -> DataFrame:
    """D16 — one dimension from rows seen in several sources, latest wins
    (tie: source name, then attributes). Full build: pass all sources;
    increment: pass the existing dimension as one more source."""
    u = sources[0].select(key, *attrs, seen_col, source_col)
    for s in sources[1:]:
        u = u.unionByName(s.select(key, *attrs, seen_col, source_col))
    order = [F.col(seen_col).desc(), F.col(source_col).desc()] + [F.col(a).desc_nulls_last() for a in attrs]
    w = Window.partitionBy(key).orderBy(*order)
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
