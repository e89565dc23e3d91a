"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlayer.session import drop_path, ensure_checkpoint_dir, scratch_dir

#: what counts as a word throughout: a run without space, tab and the line breaks
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_share(col: str, mod: int) -> Column:
    """crc32 of the id's text modulo ``mod``; NULL ids fall in no fold."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until it is none of ``columns`` (which Spark
    compares without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system where the C library can: a long-lived
    worker otherwise keeps the peak of every batch it has seen."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches again, at most ``rows`` rows each, so that what Python holds
    of one batch stays small; freed memory goes back every few batches."""
    for k, batch in enumerate(batches):
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        if k % 4 == 3:
            give_back()


class Memo(dict):
    """Row numbers of a growing float32 matrix, one row per distinct key.

    ``make(key)`` gives the row of a key not seen yet. The table is emptied when
    it holds ``most`` keys, so a worker's memory is bounded whatever the data.
    """

    def __init__(self, make: Callable[[str], np.ndarray], width: int, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most
        self.rows = np.zeros((4096, width), dtype=np.float32)

    def __missing__(self, key):
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = self.make(key)
        self[key] = n
        return n

    def of(self, keys: list) -> np.ndarray:
        """One matrix row per key."""
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))
        return self.rows[at]


def small_batches(spark: SparkSession, rows: int = 2048, size: int = 8 << 20) -> None:
    """Lowers (never raises) the session's Arrow batch bounds: a batch stands in
    the JVM and in the Python worker of each running task, so with long texts
    the defaults, made for narrow rows, cost hundreds of MB an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


_HELD: dict = {}


def held(key, make: Callable):
    """What this Python worker keeps between tasks (a model with its memo, an
    encoder): one thing at a time, so that a worker which serves one operator
    after another does not gather the memories of all."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


class Store:
    """Tables written to the shared folder: they cut lineage, survive lost
    executors, and go when the ``with`` block ends (``keep`` holds one until the
    end of the driver process, for a lazily read result)."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        small_batches(spark)
        self.spark, self.paths = spark, []

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_):
        for path in self.paths:
            drop_path(self.spark, path)

    def put(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = scratch_dir(self.spark, name)
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Drop the written table that ``df`` reads."""
        for path in [p for p in self.paths if any(p.split("/tables/")[-1] in f for f in df.inputFiles()[:1])]:
            drop_path(self.spark, path)
            self.paths.remove(path)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys, from rows sorted by them (a task's
    partition); holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def global_rank(spark: SparkSession, store: Store, df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """Adds ``rank`` (from 0) in the given order without one task seeing all
    rows: range partitions are numbered inside and shifted by the counts of the
    partitions before. ``df`` is written once with its partition, since a
    recomputed range partitioning may place bounds elsewhere."""
    ranged = store.put(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    shift = part_offsets(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n")
    return (inside.join(F.broadcast(shift), "_part")  # a row per partition
            .withColumn("rank", (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before"))


def part_offsets(counts: DataFrame, part: str, n: str, by: list[str] | None = None) -> DataFrame:
    """(by…, part, _before): running sum over the partitions before. ``counts``
    has a row per partition (and group), not per data row."""
    w = Window.partitionBy(*(by or [])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*(by or []), part, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long").alias("_before"))


def components(store: Store, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), the
    component being its smallest node. Nodes without an edge don't appear.

    Alternating large-star and small-star rounds: each node's neighbours are
    hung under its smallest neighbour until the edges form stars. Every round is
    two grouped minima (combined map-side, so a hub does not land in one task)
    and two joins; it is written to the shared folder, which keeps the lineage
    one round long. Rounds grow with the logarithm of the longest path.
    """
    a, b = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    now = store.put(edges.where("a <> b").select(b, a).distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store.put(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        small = store.put(small, "small_star")
        store.drop(now)
        store.drop(large)
        now, before, seen = small, seen, _mark(small)
        if seen == before:
            break
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select("v", "v").distinct().toDF("node", "component")))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def local_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable through the pairs (a, b) among 0..n-1, inside
    one task; ``label`` carries on from earlier pairs."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
