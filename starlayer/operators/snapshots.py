"""The accumulating snapshot as a stored table, partitioned by start date (F05/F07).

Life cycles end, so most partitions never change again. An index beside the
data names the partitions that still hold unfinished life cycles; a batch reads
those, finds the few keys that are elsewhere by the key column alone, and
rewrites only partitions that it changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlayer.operators.facts import _finish_accumulating, _milestone_aggs, _names
from starlayer.session import drop_path, scratch_dir
from starlayer.sources.sinks import clustered

START = "start_part"
#: the folder name of the partition without a start date
NO_START = "__HIVE_DEFAULT_PARTITION__"


class AccumulatingSnapshot:
    """``<base>/data/start_part=…`` and ``<base>/open/v=…``, the index: (start_part,
    unfinished) per partition with unfinished life cycles. A life cycle is
    finished when it has all its milestones. ``grain`` is what a partition spans:
    ``day`` (then ``start_part`` is ``start_dt``), ``week`` or ``month``."""

    def __init__(self, spark: SparkSession, base: str, key, process_col: str, ts_col: str, milestones, grain: str = "day"):
        self.spark, self.base, self.grain = spark, base.rstrip("/"), grain
        self.keys = [key] if isinstance(key, str) else list(key)
        self.process_col, self.ts_col, self.milestones = process_col, ts_col, milestones
        self.stamps = [f"{n}_ts" for n in _names(milestones)]
        self.last = {f"{m[0]}_ts" for m in milestones if not isinstance(m, str) and m[2] == "max"}
        self.schema = None

    # --- reading -----------------------------------------------------------------

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.base}/open")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(at) if fs.exists(at) else []
        return sorted(int(st.getPath().getName()[2:]) for st in found if fs.exists(path(st.getPath(), "_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The snapshot, or None before the first batch."""
        if not self._versions():
            return None
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.base}/data")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/open/v={self._versions()[-1]}")

    @staticmethod
    def _in(dates: list) -> Column:
        """A filter on partitions alone."""
        known = [d for d in dates if d is not None]
        cond = F.coalesce(F.col(START).isin(known), F.lit(False)) if known else F.lit(False)
        return cond | F.col(START).isNull() if None in dates else cond

    def _matched(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """A join on the keys, NULL keys included; ``right``'s come as ``_k…``."""
        named = {k: f"_k_{i}" for i, k in enumerate(self.keys)}
        same = F.lit(True)
        for k, n in named.items():
            same = same & F.col(k).eqNullSafe(F.col(n))
        return left.join(right.withColumnsRenamed(named), same, how)

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # --- one batch ---------------------------------------------------------------

    def apply(self, events: DataFrame) -> list:
        """Merges a batch: new keys are inserted, a first-time milestone takes the
        earlier time, a last-time (``max``) one the later, whatever the order of
        batches. A batch applied twice changes nothing. Returns the start dates
        that were rewritten (partitions; rows never reach the driver).
        """
        aggs = _milestone_aggs(self.process_col, self.ts_col, self.milestones)
        batch = self._put(events.groupBy(*self.keys).agg(*aggs), "batch")
        old = self.read()
        changed = self._put(self._changes(batch, old), "changed")
        start = F.date_trunc(self.grain, F.col(self.stamps[0])).cast("date")
        moved = changed.where("_was").select(F.col("_start").alias(START)).unionByName(changed.select(start.alias(START)))
        dates = [r[START] for r in moved.distinct().collect()]
        if not dates and old is not None:
            return []
        rows = changed.select(*self.keys, *self.stamps)
        if old is not None:
            rows = self._matched(old.where(self._in(dates)).select(*self.keys, *self.stamps), changed.select(*self.keys),
                                 "left_anti").unionByName(rows)
        merged = self._put(_finish_accumulating(rows, self.keys, self.milestones).withColumn(START, start), "merged")
        self.schema = merged.schema
        open_rows = F.count(F.when(F.greatest(*[F.col(c).isNull() for c in self.stamps]), 1))
        now = {r[START]: r.n for r in merged.groupBy(START).agg(open_rows.alias("n")).collect()}
        (clustered(merged, START).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(START).parquet(f"{self.base}/data"))
        for d in set(dates) - set(now):  # all its life cycles have got another start date
            drop_path(self.spark, f"{self.base}/data/{START}={NO_START if d is None else d.isoformat()}")
        self._write_index(set(dates), now)
        return sorted(dates, key=lambda d: (d is not None, str(d)))

    def _changes(self, batch: DataFrame, old: DataFrame | None) -> DataFrame:
        """(keys, merged milestones, _was, _start): the batch's keys whose row is
        new or changes, and where that row stands now."""
        if old is None:
            return batch.withColumn("_was", F.lit(False)).withColumn("_start", F.lit(None).cast("date"))
        rows = old.where(self._in(self._places(batch, old))).select(
            *self.keys, *[F.col(c).alias(f"_o_{c}") for c in self.stamps], F.col(START).alias("_start"), F.lit(True).alias("_was"))
        pairs = self._matched(batch, rows, "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
        merged = {c: (F.greatest if c in self.last else F.least)(F.col(c), F.col(f"_o_{c}")) for c in self.stamps}
        same = F.col("_was")
        for c, m in merged.items():
            same = same & m.eqNullSafe(F.col(f"_o_{c}"))
        return pairs.where(~same).select(*self.keys, *[m.alias(c) for c, m in merged.items()], "_was", "_start")

    def _places(self, batch: DataFrame, old: DataFrame) -> list:
        """Start dates of the partitions that hold keys of the batch. Open ones
        are asked first; of the others only the key column is read, and only for
        keys that no open one holds."""
        opened = self._in([r[START] for r in self.index().select(START).collect()])  # a row per open partition
        keys, place = batch.select(*self.keys), old.select(*self.keys, START)
        near = self._put(self._matched(place.where(opened), keys, "left_semi"), "near")
        rest = self._put(self._matched(keys, near.select(*self.keys), "left_anti"), "rest")
        found = near.select(START)
        if not rest.isEmpty():
            found = found.unionByName(self._matched(place.where(~opened), rest, "left_semi").select(START))
        return [r[START] for r in found.distinct().collect()]

    def _write_index(self, rewritten: set, now: dict) -> None:
        versions = self._versions()
        rows = {d: n for d, n in now.items() if n}
        if versions:
            rows.update({r[START]: r.unfinished for r in self.index().collect() if r[START] not in rewritten})
        to = versions[-1] + 1 if versions else 1
        self.spark.createDataFrame(list(rows.items()), f"{START} date, unfinished bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.base}/open/v={to}")
        for v in versions[:-1]:
            drop_path(self.spark, f"{self.base}/open/v={v}")
