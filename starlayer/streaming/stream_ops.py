"""Structured Streaming variants of the layer operators.

Each operator reads a file stream and writes with ``foreachBatch`` into a
:class:`DeltaTable`: a micro-batch stores only what itself holds, reduced per
key, and the table is the same reduction over all that is stored. Run with
``trigger(availableNow=True)`` the result equals the batch operator over the
same input (tested).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlayer.operators import dims as dimops
from starlayer.session import drop_path


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """File stream over one table, a file or a folder of part files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def read_dir_stream(spark: SparkSession, path: str, schema, max_files: int | None = 1) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


@dataclass(frozen=True)
class Run:
    """What the batches ``lo`` to ``hi`` left in one bucket."""

    lo: int
    hi: int
    bytes: int
    path: str


class DeltaTable:
    """A table kept as the reduced rows of its micro-batches.

    ``reduce`` maps rows of ``schema`` to rows of ``schema``, per ``keys`` and
    associatively (reducing reduced parts together reduces the whole), e.g. the
    latest row or a sum. Batch ``b`` writes its own reduced rows, dealt to
    buckets by a hash of the keys, as ``<base>/<b>-<b>/bucket=<k>``; a retried
    batch overwrites its folder. Reading reduces all runs of a bucket.

    Before batch ``b`` is written, a bucket's last runs are reduced into one as
    long as the run before is at most twice as large as those after it. Runs
    thus shrink geometrically: a bucket has about log2(batches) of them, a row
    is rewritten about that often, and a bucket that a batch doesn't meet is
    left alone. Runs that a wider one replaced go one batch later, so that a
    retry and a reader of the batch before still find them.
    """

    def __init__(self, spark: SparkSession, base: str, schema, keys: list[str], reduce: Callable[[DataFrame], DataFrame],
                 buckets: int = 16, view: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.base, self.schema, self.keys = spark, base.rstrip("/"), schema, keys
        self.reduce, self.buckets, self.view = reduce, buckets, view or (lambda rows: rows)

    def runs(self) -> dict[int, list[Run]]:
        """Complete runs per bucket, from folder names and sizes alone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        base = path(self.base)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out: dict[int, list[Run]] = {}
        for st in (fs.listStatus(base) if fs.exists(base) else []):
            lo, dash, hi = st.getPath().getName().partition("-")
            if not (dash and lo.isdigit() and fs.exists(path(st.getPath(), "_SUCCESS"))):
                continue
            for sub in fs.listStatus(st.getPath()):
                name = sub.getPath().getName()
                if name.startswith("bucket="):
                    size = fs.getContentSummary(sub.getPath()).getLength()
                    out.setdefault(int(name[7:]), []).append(Run(int(lo), int(hi), size, sub.getPath().toString()))
        return out

    @staticmethod
    def cover(runs: list[Run], before: int | None = None) -> list[Run]:
        """The widest runs that hold each batch (before ``before``) once."""
        out: list[Run] = []
        for r in sorted(runs, key=lambda r: (r.lo, -r.hi)):
            if (before is None or r.hi < before) and (not out or r.lo > out[-1].hi):
                out.append(r)
        return out

    def stored(self) -> DataFrame:
        paths = [r.path for runs in self.runs().values() for r in self.cover(runs)]
        return self._load(paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.view(self.reduce(self.stored()))

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, df: DataFrame, lo: int, hi: int) -> None:
        key = F.pmod(F.hash(*self.keys), F.lit(self.buckets)) if self.keys else F.lit(0)
        rows = df.select(*[F.col(f"`{f.name}`") for f in self.schema.fields], key.cast("int").alias("bucket"))
        # buckets are even by their hash; a full one is split, small ones share a task
        rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("bucket").parquet(f"{self.base}/{lo}-{hi}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self._compact(batch_id)
        self._write(self.reduce(batch), batch_id, batch_id)

    def _compact(self, batch_id: int) -> None:
        merges: dict[int, list[str]] = {}
        for runs in self.runs().values():
            now = self.cover(runs, before=batch_id)
            for r in runs:  # replaced by a run that an earlier batch already made
                if any(w.lo <= r.lo and r.hi <= w.hi < batch_id - 1 and w != r for w in now):
                    drop_path(self.spark, r.path)
            at, size = len(now) - 1, now[-1].bytes if now else 0
            while at > 0 and now[at - 1].bytes <= 2 * size:
                at -= 1
                size += now[at].bytes
            if now and at < len(now) - 1:
                merges.setdefault(now[at].lo, []).extend(r.path for r in now[at:])
        for lo, paths in merges.items():  # few: buckets that fill alike merge alike
            self._write(self.reduce(self._load(paths)), lo, batch_id - 1)


def run_available_now(writer, checkpoint: str) -> None:
    """Start a streaming write with ``availableNow`` and wait for it."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise RuntimeError(str(q.exception()))


def _apply_batches(stream: DataFrame, table: DeltaTable, checkpoint: str,
                   prep: Callable[[DataFrame], DataFrame] | None = None) -> DeltaTable:
    """Writes each micro-batch to ``table``. No watermark: a late row meets the
    stored rows of its key when the table is read or compacted."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.write(prep(batch) if prep else batch, batch_id)

    run_available_now(stream.writeStream.foreachBatch(apply), checkpoint)
    return table


def stream_dwd_latest(stream: DataFrame, out_base: str, checkpoint: str, key: str = "order_id", buckets: int = 16) -> DeltaTable:
    """Streaming C01: standardise, filter, and keep the latest row per key,
    whichever batch it arrives in."""
    from starlayer.operators.clean import dwd_dedup_latest, dwd_filter_invalid, dwd_standardize
    s = dwd_filter_invalid(dwd_standardize(stream))
    table = DeltaTable(stream.sparkSession, out_base, s.schema, [key], lambda rows: dwd_dedup_latest(rows, key), buckets)
    return _apply_batches(s, table, checkpoint)


def stream_dwd_dedup(stream: DataFrame, out_base: str, checkpoint: str, key: str, ts: str, buckets: int = 16) -> DeltaTable:
    """Streaming landing without re-delivered rows: the earliest row per
    ``key``, however late it arrives; a NULL key is one key."""
    names = stream.columns
    cols = [c for c in names if c != key]

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(ts, *cols)).alias("_r")).select(key, "_r.*").select(*names)

    return _apply_batches(stream, DeltaTable(stream.sparkSession, out_base, stream.schema, [key], first, buckets), checkpoint)


def stream_dws_1d(events: DataFrame, out_base: str, checkpoint: str, buckets: int = 16) -> DeltaTable:
    """Streaming daily summary per event type: each micro-batch is summed, and
    sums of one day add up, so late rows count in theirs."""
    from pyspark.sql.types import _parse_datatype_string
    keys = ["day", "event_type"]
    schema = _parse_datatype_string("day date, event_type string, events bigint, value_sum decimal(28,2)")

    def daily(batch: DataFrame) -> DataFrame:
        return batch.select(F.col("ts").cast("date").alias("day"), "event_type", F.lit(1).cast("bigint").alias("events"),
                            F.col("value").cast("decimal(28,2)").alias("value_sum"))

    def add(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("value_sum").cast("decimal(28,2)").alias("value_sum"))

    return _apply_batches(events, DeltaTable(events.sparkSession, out_base, schema, keys, add, buckets), checkpoint, daily)


def stream_scd2(changes: DataFrame, out_base: str, checkpoint: str, key: str, date_col: str,
                attrs: list[str], prep=None) -> DeltaTable:
    """Streaming SCD2. The stored table is the log of raw changes, each written
    once and merged as it is; its view builds the versions, so a change older
    than the current version takes its place. ``prep`` turns raw rows into
    change-log rows."""
    make = prep or (lambda rows: rows)
    table = DeltaTable(changes.sparkSession, out_base, changes.schema, [], lambda rows: rows, 1,
                       lambda log: dimops.scd2_build(make(log).select(key, *attrs, date_col), key, date_col, attrs))
    return _apply_batches(changes, table, checkpoint)
