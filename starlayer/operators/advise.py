"""Profiling and modelling advice driven by measured data (A01–A10).

The rules are the modelling rule base's; their inputs (cardinalities, change
rates, depths, relationship shapes) are measured by Spark jobs instead of
being typed in. Each advisor returns a small DataFrame with the measured
inputs, the decision and the number of the rule that fired; the decision is a
``when`` chain evaluated on the executors, not in driver Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, DataType, DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType,
)

from starlayer.functions import lexicon as L
from starlayer.functions.exprs import ratio
from starlayer.functions.joins import with_scalars


def _kw_hit(name: str, words: list[str], fold: bool = False) -> bool:
    """Whether a keyword stands in the name, as written; ``fold`` ignores case."""
    name = name or ""
    return any(w in name or fold and w.lower() in name.lower() for w in words)


def _text(name: str, kind: DataType) -> Column:
    """A value as text, equal for equal values of the column."""
    col = F.col(f"`{name}`")
    if isinstance(kind, BinaryType):
        return F.hex(col)
    if isinstance(kind, (FloatType, DoubleType)):
        col = col + F.lit(0.0).cast(kind)  # no negative zero
    return col.cast("string")


def _place(name: str, kind: DataType) -> Column:
    """Dates and times as whole numbers, in their own order."""
    col = F.col(f"`{name}`")
    if isinstance(kind, DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp"))
    return F.lit(None).cast("long")


def profile_columns(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A01 — rows, nulls, distinct, min, max per column.

    The input is read once: each row gives its (column, value) pairs, equal
    pairs are counted on the map side and then by ranges of their hash, so no
    column's values meet in one task; a column's row comes from the counts of
    its values. ``exact=False`` takes HyperLogLog++ distinct counts instead, one
    aggregate with bounded memory and a relative error of about 5 % (the
    default's standard deviation).
    """
    cols = cols or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not exact:
        return _profile_sketched(df, cols, kinds)
    numeric = F.col("_i").isin(*[i for i, c in enumerate(cols) if isinstance(kinds[c], NumericType)] or [-1])
    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), _text(c, kinds[c]).alias("_v"), _place(c, kinds[c]).alias("_at")) for i, c in enumerate(cols)])
    values = (df.select(F.explode(pairs).alias("_p")).select("_p._i", "_p._v", "_p._at")
              .groupBy("_i", "_v", "_at").agg(F.count(F.lit(1)).alias("_n")))
    num = F.when(numeric, F.col("_v").cast("double"))
    timed = F.struct(F.col("_at"), F.col("_v"))
    lo = F.when(F.min("_at").isNotNull(), F.min(F.when(F.col("_at").isNotNull(), timed))["_v"]).otherwise(F.min(F.when(~numeric, F.col("_v"))))
    hi = F.when(F.max("_at").isNotNull(), F.max(F.when(F.col("_at").isNotNull(), timed))["_v"]).otherwise(F.max(F.when(~numeric, F.col("_v"))))
    per = values.groupBy("_i").agg(
        F.sum("_n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
        F.count("_v").alias("distinct_count"), F.min(num).alias("min_num"), F.max(num).alias("max_num"), lo.alias("min_str"), hi.alias("max_str"))
    # a row per column, also where the table is empty
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "_c int, column_name string")
    out = F.broadcast(names).join(per, F.col("_c") == F.col("_i"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("row_count", "null_count", "distinct_count")]
    return out.select("column_name", *zero, "min_num", "max_num", "min_str", "max_str")


def _profile_sketched(df: DataFrame, cols: list[str], kinds: dict[str, DataType]) -> DataFrame:
    stats = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        col, number = F.col(f"`{c}`"), isinstance(kinds[c], NumericType)
        none = [F.lit(None).cast("string" if number else "double")] * 2
        ends = [F.min(col).cast("double" if number else "string"), F.max(col).cast("double" if number else "string")]
        lo, hi, lo_s, hi_s = ends + none if number else none + ends
        stats += [F.count(F.when(col.isNull(), 1)).alias(f"_n{i}"), F.approx_count_distinct(col).alias(f"_d{i}"),
                  lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}"), lo_s.alias(f"_ls{i}"), hi_s.alias(f"_hs{i}")]
    parts = ", ".join(f"'{c}', _n{i}, _d{i}, _lo{i}, _hi{i}, _ls{i}, _hs{i}" for i, c in enumerate(cols))
    return df.agg(*stats).selectExpr(
        "_rows AS row_count", f"stack({len(cols)}, {parts}) AS (column_name, null_count, distinct_count, min_num, max_num, "
        f"min_str, max_str)").select("column_name", "row_count", "null_count", F.col("distinct_count").cast("bigint").alias("distinct_count"),
                                     "min_num", "max_num", "min_str", "max_str")


def change_stats(log: DataFrame, key: str, date_col: str, attrs: list[str]) -> DataFrame:
    """Keys, versions and average changes per key of a change log (one row)."""
    from starlayer.operators.dims import scd_versions
    v = scd_versions(log, key, date_col, attrs, current=None)
    per = v.groupBy(key).agg(F.count(F.lit(1)).alias("_v"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.sum("_v").cast("bigint").alias("versions")) \
        .withColumn("avg_changes_per_key", ratio(F.col("versions") - F.col("keys"), F.col("keys"), 4))


def _freq_level(avg: Column, low: float, high: float) -> Column:
    return F.when(avg < low, "low").when(avg >= high, "high").otherwise("medium")


def advise_scd(log: DataFrame, key: str, date_col: str, attr: str, need_history: bool = False,
               is_correction: bool = False, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """A02 — SCD type: correction → 1 (rule 1); history → 2 (rule 2); low
    change rate → 1 (rule 3); high → 1 (rule 4); otherwise 2 (rule 5)."""
    corr = is_correction or _kw_hit(attr, L.CORRECTION_KEYWORDS)
    hist = need_history or _kw_hit(attr, L.HISTORY_KEYWORDS)
    s = change_stats(log, key, date_col, [attr])
    freq = _freq_level(F.col("avg_changes_per_key"), low, high)
    rule = (F.when(F.lit(corr), 1).when(F.lit(hist), 2).when(freq == "low", 3)
            .when((freq == "high") & F.lit(not need_history), 4).otherwise(5))
    scd = F.when(rule.isin(1, 3, 4), 1).otherwise(2)
    return s.select(F.lit(attr).alias("attribute"), "keys", "versions", "avg_changes_per_key",
                    freq.alias("change_frequency"), scd.alias("scd_type"), rule.alias("rule"))


def advise_zipper(log: DataFrame, key: str, date_col: str, attrs: list[str], need_history: bool = True,
                  max_changes: float = L.ZIPPER_MAX_CHANGES_PER_KEY,
                  small_rows: int = L.ZIPPER_SMALL_DIMENSION) -> DataFrame:
    """A03 — zipper table: no history → no (rule 1); average changes per key
    > ``max_changes`` → no (rule 2); else yes (rule 3), noting a small dimension."""
    s = change_stats(log, key, date_col, attrs)
    expansion = F.when(F.col("avg_changes_per_key") <= 0, F.lit(1.0)).otherwise(F.col("avg_changes_per_key"))
    rule = F.when(F.lit(not need_history), 1).when(expansion > max_changes, 2).otherwise(3)
    return s.select("keys", "versions", "avg_changes_per_key", expansion.alias("expansion_ratio"),
                    (rule == 3).alias("use_zipper"), rule.alias("rule"),
                    ((rule == 3) & (F.col("keys") < small_rows)).alias("small_dimension_note"))


def advise_degenerate(df: DataFrame, cols: list[str], declared_pk: tuple = ()) -> DataFrame:
    """A04 — business-number keyword in the name → yes (rule 1); declared or
    measured key (distinct = rows, no NULL) → yes (rule 2); else no (rule 3)."""
    p = profile_columns(df, cols)
    kw = F.lit(False)
    for c in cols:
        if _kw_hit(c, L.DEGENERATE_KEYWORDS, fold=True):
            kw = kw | (F.col("column_name") == c)
    pk = F.col("column_name").isin(*declared_pk) if declared_pk else F.lit(False)
    measured = (F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0)
    rule = F.when(kw, 1).when(pk | measured, 2).otherwise(3)
    return p.select("column_name", "row_count", "null_count", "distinct_count",
                    measured.alias("measured_key"), (rule != 3).alias("is_degenerate"), rule.alias("rule"))


def advise_junk(df: DataFrame, flags: list[str], max_values: int = L.JUNK_MAX_VALUES_PER_FLAG,
                min_flags: int = L.JUNK_MIN_FLAGS, max_combos: int = L.JUNK_MAX_COMBINATIONS) -> DataFrame:
    """A05 — junk dimension: a flag with > 20 values → no (rule 1); fewer than
    3 flags → no (rule 2); product of cardinalities > 10000 → no (rule 3);
    else yes (rule 4). Cardinalities are measured (A01)."""
    p = profile_columns(df, flags)
    card = F.greatest(F.col("distinct_count"), F.lit(1))
    s = p.agg(F.count(F.lit(1)).alias("flags"), F.max("distinct_count").alias("max_cardinality"),
              F.product(card).cast("bigint").alias("combinations"))
    rule = (F.when(F.col("max_cardinality") > max_values, 1).when(F.col("flags") < min_flags, 2)
            .when(F.col("combinations") > max_combos, 3).otherwise(4))
    return s.select("flags", "max_cardinality", "combinations", (rule == 4).alias("use_junk"),
                    rule.alias("rule"))


def advise_mini(dim: DataFrame, key: str, attrs: list[str], change_log: DataFrame | None = None,
                log_key: str | None = None, log_date: str | None = None, log_attrs: list[str] | None = None,
                low: float = 0.1, high: float = 1.0, min_attrs: int = L.MINI_MIN_ATTRIBUTES,
                large: int = L.MINI_LARGE_DIMENSION) -> DataFrame:
    """A06 — mini dimension: < 2 attributes → no (rule 1); low change rate and
    < 10000 rows → no (rule 2); medium/high rate or ≥ 10000 rows → yes (rule 3).
    Rows are the dimension's distinct keys; the change rate comes from a change
    log when one is given (else low)."""
    rows = dim.agg(F.countDistinct(key).alias("dimension_rows"))
    if change_log is not None:
        s = change_stats(change_log, log_key, log_date, log_attrs)
        avg = s.select("avg_changes_per_key")
        base = with_scalars(rows, avg)
    else:
        base = rows.withColumn("avg_changes_per_key", F.lit(0.0))
    freq = _freq_level(F.col("avg_changes_per_key"), low, high)
    n = len(attrs)
    rule = (F.when(F.lit(n < min_attrs), 1).when((freq == "low") & (F.col("dimension_rows") < large), 2)
            .when(freq.isin("medium", "high") | (F.col("dimension_rows") >= large), 3).otherwise(4))
    return base.select(F.lit(n).alias("attributes"), "dimension_rows", "avg_changes_per_key",
                       freq.alias("change_frequency"), (rule == 3).alias("use_mini"), rule.alias("rule"))


def advise_multivalue(df: DataFrame, a: str, b: str, array_max: float = L.MULTIVALUE_ARRAY_MAX) -> DataFrame:
    """A07 — multi-valued attribute b of a: measured fan-out on both sides
    decides the relationship (n:1, 1:n, m:n); n:1 → none (rule 1); 1:n with
    average ≤ 5 → array (rule 2), > 5 → bridge (rule 3); m:n → bridge (rule 4).

    Distinct pairs are aggregated per side with partial aggregation; no
    per-key list is collected.
    """
    pairs = df.select(a, b).dropna().distinct()
    per_a = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("_n"))
    per_b = pairs.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    sa = per_a.agg(F.sum("_n").alias("pairs"), F.count(F.lit(1)).alias("a_keys"), F.max("_n").alias("max_b_per_a"))
    sb = per_b.agg(F.count(F.lit(1)).alias("b_keys"), F.max("_n").alias("max_a_per_b"))
    s = with_scalars(sa, sb)
    avg_b = ratio(F.col("pairs"), F.col("a_keys"), 4)
    rel = (F.when(F.col("max_b_per_a") <= 1, "n:1").when(F.col("max_a_per_b") <= 1, "1:n").otherwise("m:n"))
    rule = F.when(rel == "n:1", 1).when((rel == "1:n") & (avg_b <= array_max), 2) \
        .when(rel == "1:n", 3).otherwise(4)
    strategy = F.when(rule == 1, "none").when(rule == 2, "array").otherwise("bridge_table")
    return s.select(F.lit(a).alias("owner"), F.lit(b).alias("value"), "pairs", "a_keys", "b_keys",
                    avg_b.alias("avg_values_per_owner"), "max_b_per_a", "max_a_per_b",
                    rel.alias("relationship"), strategy.alias("strategy"), rule.alias("rule"))


def advise_hierarchy(closure: DataFrame, queried_at_all_levels: bool = False,
                     flatten_max: int = L.HIERARCHY_FLATTEN_MAX_DEPTH) -> DataFrame:
    """A08 — depth ≤ 1 → none (rule 1); ≤ 4 and not queried at all levels →
    flatten (rule 2); else bridge (rule 3). Depth = max distance + 1."""
    s = closure.filter(F.col("distance") >= 0).agg((F.max("distance") + 1).alias("depth"),
                                                   F.countDistinct("descendant").alias("nodes"))
    rule = F.when(F.col("depth") <= 1, 1).when((F.col("depth") <= flatten_max) & F.lit(not queried_at_all_levels), 2) \
        .otherwise(3)
    strategy = F.when(rule == 1, "none").when(rule == 2, "flatten").otherwise("bridge")
    return s.select("depth", "nodes", strategy.alias("strategy"), rule.alias("rule"))


def advise_fact_type(events: DataFrame, key: str, process: str, ts: str, end_process: str | None = None,
                     interval_share: float = 0.5, high_volume_per_day: float = 1000.0) -> DataFrame:
    """A09 — fact-table type from measured process structure.

    Measured: n distinct processes; share of keys having ≥ 2 processes at
    different times (intervals); whether keys reach ``end_process`` (end
    state); rows per day (volume); snapshot-like process names. Rules: n = 0 →
    transaction (0); (n ≥ 2, intervals, end) or (n ≥ 4, intervals) →
    accumulating 0.9 (1); n = 1 snapshot-like → periodic 0.85 (2); n = 1 high
    volume → transaction 0.9 (3); n ≥ 2 without intervals → transaction 0.7
    (4); else transaction 0.6 (5).
    """
    many = (F.min(process) != F.max(process)) & (F.min(ts) != F.max(ts))  # two or more of each
    per_key = events.groupBy(key).agg(many.alias("_many"),
                                      F.max(F.col(process) == F.lit(end_process)).alias("_end")
                                      if end_process else F.lit(False).alias("_end"))
    k = per_key.agg(F.count(F.lit(1)).alias("keys"),
                    F.count(F.when(F.col("_many"), 1)).alias("keys_with_intervals"),
                    F.count(F.when(F.col("_end"), 1)).alias("keys_at_end"))
    snap = F.lit(False)
    for w in L.SNAPSHOT_KEYWORDS:
        snap = snap | F.col(process).contains(w)
    days = events.groupBy(F.col(process).alias("_process"), F.col(ts).cast("date").alias("_day")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(snap).alias("_snap"))
    g = days.agg(F.countDistinct("_process").alias("processes"),
                 F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
                 F.countDistinct("_day").alias("days"),
                 F.max("_snap").alias("snapshot_like"))
    s = with_scalars(g, k)
    share = ratio(F.col("keys_with_intervals"), F.col("keys"), 4)
    intervals = F.coalesce(share > interval_share, F.lit(False))
    end = F.col("keys_at_end") > 0
    per_day = ratio(F.col("rows"), F.col("days"), 2)
    high = F.coalesce(per_day >= high_volume_per_day, F.lit(False))
    n = F.col("processes")
    rule = (F.when(n == 0, 0).when(((n >= 2) & intervals & end) | ((n >= 4) & intervals), 1)
            .when((n == 1) & F.coalesce(F.col("snapshot_like"), F.lit(False)), 2)
            .when((n == 1) & high, 3).when((n >= 2) & ~intervals, 4).otherwise(5))
    ftype = F.when(rule == 1, "accumulating_snapshot").when(rule == 2, "periodic_snapshot").otherwise("transaction")
    conf = (F.when(rule == 0, 0.0).when(rule == 1, 0.9).when(rule == 2, 0.85).when(rule == 3, 0.9)
            .when(rule == 4, 0.7).otherwise(0.6))
    return s.select("processes", "keys", share.alias("interval_share"), "keys_at_end", per_day.alias("rows_per_day"),
                    ftype.alias("fact_type"), conf.alias("confidence"), rule.alias("rule"))


def advise_additivity(df: DataFrame, measures: list[str], quotients: dict[str, tuple[str, str]] | None = None,
                      state_measures: tuple = (), tolerance: float = 1e-3) -> DataFrame:
    """A10 — per measure: non-additive if it equals num / den (declared pair)
    on every row within ``tolerance``; semi-additive if declared a state;
    else additive. One aggregation counts the violating rows per measure."""
    quotients = quotients or {}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, m in enumerate(measures):
        if m in quotients:
            num, den = quotients[m]
            q = F.when(F.col(den) != 0, F.col(num).cast("double") / F.col(den).cast("double"))
            bad = F.coalesce(F.abs(F.col(m).cast("double") - q) > F.lit(tolerance), F.lit(True))
            aggs.append(F.count(F.when(bad, 1)).alias(f"_b{i}"))
        else:
            aggs.append(F.lit(None).cast("bigint").alias(f"_b{i}"))
    one = df.agg(*aggs)
    parts = ", ".join(f"'{m}', _b{i}, {str(m in state_measures).lower()}" for i, m in enumerate(measures))
    t = one.selectExpr("_rows AS row_count", f"stack({len(measures)}, {parts}) AS (measure, quotient_violations, "
                                             f"declared_state)")
    rule = F.when(F.col("quotient_violations") == 0, 1).when(F.col("declared_state"), 2).otherwise(3)
    add = F.when(rule == 1, "non_additive").when(rule == 2, "semi_additive").otherwise("additive")
    return t.select("measure", "row_count", "quotient_violations", "declared_state", add.alias("additivity"),
                    rule.alias("rule"))
