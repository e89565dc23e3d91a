"""Window functions along a key that may hold a third of all rows.

A window per key puts a whole key into one task. Here the rows of heavy keys
are dealt into ranges of (key, order) by sampled splitters; a segment is what
one range holds of one key. Windows run per (key, segment), and what they need
from beyond a border is carried there: copies of the nearest rows of the
segments before and after, or counts of the segments before. Keys that fit a
task are one segment each and cost nothing but a count per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from starlayer.session import scratch_dir

#: columns that segmented frames carry: the segment (NULL: the whole key), and
#: -1 / 0 / 1 for a row carried from before, of the segment itself, from after
SEG, SIDE = "_seg", "_side"
#: rows of a key that a task holds without thought
LEAST = 100_000
#: groups of keys whose rows :func:`key_load` counts together
GROUPS = 1 << 16


@dataclass
class Segmented:
    """Rows with their segment. ``cut`` tells whether any key is cut at all."""

    rows: DataFrame
    keys: list[str]
    order: list[Column]
    cut: bool

    def window(self, *order: Column) -> WindowSpec:
        """The window of a key's segment, by default in the rows' order;
        carried rows stand outside the segment's own."""
        by = list(order) or self.order
        return Window.partitionBy(*self.keys, *([SEG] if self.cut else [])).orderBy(*([SIDE] if self.carried else []), *by)

    @property
    def carried(self) -> bool:
        return SIDE in self.rows.columns

    def own(self, df: DataFrame) -> DataFrame:
        """``df`` without carried rows and helper columns."""
        df = df.where(F.col(SIDE) == 0) if SIDE in df.columns else df
        return df.drop(SEG, SIDE)


def _same(named: dict[str, str]) -> Column:
    """Equality of columns with their renamed copies, NULLs included."""
    cond = F.lit(True)
    for name, renamed in named.items():
        cond = cond & F.col(name).eqNullSafe(F.col(renamed))
    return cond


def heavy_keys(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Keys with more rows than half of a task's even share, and than any task
    can easily hold: at most two for each of ``parts`` tasks."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    share = total.select(F.greatest(F.lit(float(LEAST)), F.col("_all") / F.lit(2.0 * parts)).alias("_share")).scalar()
    return counts.where(F.col("_n") > share).select(*keys)


def key_load(df: DataFrame, key: str) -> tuple[int, bool]:
    """(rows with a key, whether some key may be hot), in one scan of the key.

    Keys are counted in groups by hash, a row per group from each task, so
    nothing is dealt by the key itself: a group with more rows than a key may
    have beside a few even shares of the others holds a hot key, perhaps."""
    groups = (df.where(F.col(key).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"))
              .agg(F.count(F.lit(1)).alias("_n")))
    rows, most = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    return rows, most > LEAST + 4 * rows / GROUPS


def segment(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> Segmented:
    """Deals ``df`` into segments along ``order`` (the last columns of which
    should tell rows apart: only equal ones can't be parted).

    The rows of heavy keys are written once to the shared folder, since a range
    partitioning computed again may place its splitters elsewhere.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(df, keys, parts)
    if heavy.isEmpty():
        return Segmented(df, keys, order, False)
    named = {k: f"_hot_{i}" for i, k in enumerate(keys)}
    path = scratch_dir(spark, "heavy_keys")
    heavy.withColumnsRenamed(named).write.parquet(path)
    hot = F.broadcast(spark.read.parquet(path))  # two keys a task at most
    same = _same(named)
    path = scratch_dir(spark, "segments")
    (df.join(hot, same, "left_semi").repartitionByRange(parts, *[F.col(k) for k in keys], *order)
     .withColumn(SEG, F.spark_partition_id()).write.parquet(path))
    rows = spark.read.parquet(path)
    rest = df.join(hot, same, "left_anti").withColumn(SEG, F.lit(None).cast("int"))
    return Segmented(rest.unionByName(rows), keys, order, True)


def _borders(s: Segmented, last: bool, of: Column | None) -> DataFrame:
    """(keys, segment, row): per segment its last (or first) row, of those that
    ``of`` holds for (else NULL), combined on the map side."""
    cols = [c for c in s.rows.columns if c not in (SEG, SIDE)]
    inner = s.rows.where(F.col(SEG).isNotNull())
    for i, c in enumerate(s.order):
        inner = inner.withColumn(f"_o{i}", c)
    place = F.struct(*[f"_o{i}" for i in range(len(s.order))])
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    if of is not None:
        place, row = F.when(of, place), F.when(of, row)
    pick = F.max_by(row, place) if last else F.min_by(row, place)
    return inner.groupBy(*s.keys, SEG).agg(pick.alias("_row"))


def carry(s: Segmented, before: bool = True, after: bool = False, of: Column | None = None) -> Segmented:
    """Puts a copy of the nearest row before (and after) each segment beside its
    own rows, with :data:`SIDE` -1 (and 1); with ``of`` the nearest row for which
    it holds, from whatever segment of the key. The order is taken ascending with
    NULLs first. Copies are one per segment, never one per row."""
    if not s.cut:
        return s
    cols = [c for c in s.rows.columns if c not in (SEG, SIDE)]
    out = s.rows.withColumn(SIDE, F.lit(0))
    w = Window.partitionBy(*s.keys).orderBy(SEG)  # a row per segment of one key
    for wanted, side in ((before, -1), (after, 1)):
        if not wanted:
            continue
        ends = _borders(s, side < 0, of)
        near = (F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if side < 0
                else F.first("_row", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
        found = ends.withColumn("_near", near).where(F.col("_near").isNotNull())
        out = out.unionByName(found.select(*[F.col(f"_near.`{c}`").alias(c) for c in cols], SEG, F.lit(side).alias(SIDE)))
    return Segmented(out, s.keys, s.order, True)


def rank(s: Segmented, name: str) -> DataFrame:
    """The rows with their place (from 1) in their key's order: places within a
    segment, shifted by the counts of the segments before."""
    inside = s.rows.withColumn(name, F.row_number().over(s.window()))
    if not s.cut:
        return inside
    named = {**{k: f"_s_{i}" for i, k in enumerate(s.keys)}, SEG: "_s_seg"}
    counts = s.rows.where(F.col(SEG).isNotNull()).groupBy(*s.keys, SEG).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*s.keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.broadcast(counts.withColumn("_before", F.sum("_n").over(w)).drop("_n").withColumnsRenamed(named))  # a row per segment
    return (inside.join(shift, _same(named), "left").withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long"))
            .drop("_before", SEG, *named.values()))
