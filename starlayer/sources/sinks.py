"""Sinks and storage layout: ODS landing, overwrite / partition overwrite,
upsert, lifecycle archive split, compaction (S04–S10).

Writes go to the path given by the caller; a writer never overwrites a path
that the same plan reads (upserts write a new folder and return it).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlayer.functions.exprs import lit_date
from starlayer.session import scratch_dir


def ods_sync(src: DataFrame, as_of, etl_source: str = "starlayer") -> DataFrame:
    """S04 — 1:1 copy of a source plus ``etl_time`` and ``etl_source``.

    ``etl_time`` is the batch time passed in (midnight of ``as_of`` for a
    date), never the wall clock, so a rerun yields identical rows.
    """
    if isinstance(as_of, (_dt.date, str)) and not isinstance(as_of, _dt.datetime):
        t = lit_date(as_of).cast("timestamp_ntz")
    else:
        t = F.lit(as_of).cast("timestamp_ntz")
    return src.withColumn("etl_time", t).withColumn("etl_source", F.lit(etl_source))


#: rows of a size table up to which it is broadcast
BROADCAST_VALUES = 100_000


def clustered(df: DataFrame, part_col: str, target_bytes: int = 256 << 20, row_bytes: int | None = None) -> DataFrame:
    """``df`` dealt for a write partitioned by ``part_col``: a value with more
    rows than a file should hold is split evenly over as many tasks as it fills
    files, smaller values share tasks without being split. A value thus gets
    ceil(its bytes / target) files, and no task much more than one file's rows.

    Rows per value are counted in a pass of their own, which reads what
    ``part_col`` needs: pass a stored table, or its plan runs twice. ``row_bytes`` is the size of a stored row, by default
    what Spark assumes for the schema.
    """
    spark = df.sparkSession
    per_file = max(1, target_bytes // (row_bytes or int(df._jdf.schema().defaultSize())))
    path = scratch_dir(spark, "values")
    df.groupBy(F.col(part_col).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    sizes = spark.read.parquet(path)  # a row per folder of the table
    big = F.col("_n") > per_file
    files = F.when(big, F.ceil(F.col("_n") / per_file)).otherwise(0)
    before = Window.orderBy(F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("_files", files).withColumn("_first", F.coalesce(F.sum("_files").over(before), F.lit(0)))
             .withColumn("_filled", F.coalesce(F.sum(F.when(big, 0).otherwise(F.col("_n"))).over(before), F.lit(0))))
    whole, rest, values = sizes.agg(F.sum("_files"), F.max("_filled"), F.count(F.lit(1))).first()
    if not values:
        return df
    task = F.when(F.col("_files") > 0, F.col("_first") + F.pmod(
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id()), "_files")).otherwise(
        F.lit(whole) + F.floor(F.col("_filled") / per_file))
    sizes = sizes.drop("_n")
    sizes = F.broadcast(sizes) if values <= BROADCAST_VALUES else sizes
    dealt = df.join(sizes, F.col(part_col).eqNullSafe(F.col("_value"))).withColumn("_task", task.cast("int"))
    return dealt.repartitionById(int(whole) + int(rest) // per_file + 1, F.col("_task")).select(*[F.col(f"`{c}`") for c in df.columns])


def sink_overwrite_table(df: DataFrame, path: str) -> DataFrame:
    """S06 — CREATE OR REPLACE TABLE AS: overwrite the folder, return the re-read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_overwrite_partition(df: DataFrame, path: str, part_col: str = "dt", target_bytes: int = 256 << 20) -> DataFrame:
    """S07 — INSERT OVERWRITE … PARTITION: only partitions present in ``df``
    are replaced (dynamic partition overwrite), the others stay."""
    (clustered(df, part_col, target_bytes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part_col).parquet(path))
    return df.sparkSession.read.parquet(path)


def ods_append_partition(df: DataFrame, path: str, dt, dt_col: str = "dt") -> DataFrame:
    """S05 — daily incremental landing keyed by ``dt``: the batch is written as
    partition ``dt``; rerunning the same batch replaces that partition only, so
    the landing is append-only across days and rerun-safe within a day."""
    batch = df.withColumn(dt_col, lit_date(dt))
    return sink_overwrite_partition(batch, path, dt_col)


def sink_upsert(target: DataFrame, updates: DataFrame, keys: list[str], out_path: str,
                deleted_col: str | None = None) -> DataFrame:
    """S08 — upsert by key: matched rows take the update, new keys are inserted.

    Parquet has no MERGE, so this is a full outer join on the keys (one
    shuffle of each side) with the update side winning, written to a *new*
    folder and re-read. The caller swaps folders afterwards.
    """
    cols = target.columns
    u = updates.select(*cols).withColumn("_u", F.lit(True))
    t = target.select(*cols)
    j = t.alias("t").join(u.alias("u"), keys, "full_outer")
    sel = [F.col(k) for k in keys] + [
        F.when(F.col("u._u").isNotNull(), F.col(f"u.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c)
        for c in cols if c not in keys]
    merged = j.select(*sel).select(*cols)
    return sink_overwrite_table(merged, out_path)


def archive_split(df: DataFrame, finish_col: str, as_of, months: int = 6) -> DataFrame:
    """S09 — lifecycle tier: rows finished more than ``months`` months before
    ``as_of`` are ``cold``, the rest (including unfinished) ``hot``."""
    edge = F.add_months(lit_date(as_of), -months)
    return df.withColumn("tier", F.when(F.col(finish_col).cast("date") < edge, "cold").otherwise("hot"))


def write_tiers(df: DataFrame, path: str) -> DataFrame:
    """Write an ``archive_split`` frame partitioned by tier; returns the re-read."""
    clustered(df, "tier").write.mode("overwrite").partitionBy("tier").parquet(path)
    return df.sparkSession.read.parquet(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the data files under a folder, listed without reading
    any of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes")).where(~F.col("path").rlike(r"/[_.][^/]*$"))


def compaction_plan(files: DataFrame, target_bytes: int) -> DataFrame:
    """(path, bytes, folder, bin): the small files of each folder, in order of
    their names, in bins that fill up to ``target_bytes``; files of half the
    target and more are left out, and so are bins of one file. A row per file."""
    small = files.where(F.col("bytes") < target_bytes // 2).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    w = Window.partitionBy("folder").orderBy("path")
    filled = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bins = small.withColumn("bin", F.floor(F.coalesce(filled, F.lit(0)) / F.lit(target_bytes)).cast("int"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("folder", "bin")) == 1
    return bins.withColumn("_alone", alone).where(~F.col("_alone")).drop("_alone")


def compact_small_files(spark: SparkSession, path: str, target_bytes: int = 512 << 20) -> DataFrame:
    """S10 — replaces the small files of a parquet folder (partitioned or not) by
    files of about ``target_bytes``; large files are not touched. Returns the
    re-read table.

    One task writes each bin; the number of tasks follows the bytes. New files
    are written whole to a hidden folder beside the data, then moved in while
    the old ones go: run it while no batch writes the folder. What reaches the
    driver are names of files.
    """
    plan = compaction_plan(list_files(spark, path), target_bytes).collect()
    if not plan:
        return spark.read.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = f"{path.rstrip('/')}/_compacting"
    numbers = {k: n for n, k in enumerate(sorted({(r.folder, r.bin) for r in plan}))}
    dealt = spark.createDataFrame([(r.path, numbers[r.folder, r.bin]) for r in plan], "_path string, _bin int")
    rows = spark.read.parquet(*[r.path for r in plan]).withColumn("_file", F.col("_metadata.file_path"))
    # names of files only; Spark's listing and its metadata column may spell the scheme differently
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    binned = rows.join(dealt, bare("_file") == bare("_path")).drop("_file", "_path")
    (binned.repartitionById(len(numbers), F.col("_bin")).write.mode("overwrite").partitionBy("_bin").parquet(hidden))
    for (folder, _), n in numbers.items():
        for st in fs.listStatus(hadoop(f"{hidden}/_bin={n}")):
            if not st.getPath().getName().startswith(("_", ".")):
                fs.rename(st.getPath(), hadoop(f"{folder}/{st.getPath().getName()}"))
    for r in plan:
        fs.delete(hadoop(r.path), False)
    fs.delete(hadoop(hidden), True)
    return spark.read.parquet(path)


def compact_files(df: DataFrame, path: str, target_files: int,
                  max_records_per_file: int | None = None) -> DataFrame:
    """S10 — rewrite into ``target_files`` files (content unchanged).

    ``repartition(n)`` is a round-robin shuffle, so files come out equal-sized
    whatever the input skew; at scale choose ``n`` ≈ bytes / 512 MB.
    """
    w = df.repartition(target_files).write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_stats(df: DataFrame) -> DataFrame:
    """Files and bytes behind a parquet-backed frame (distributed over
    ``_metadata``; one row out)."""
    m = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    return m.agg(F.count(F.lit(1)).alias("files"), F.sum("s").cast("bigint").alias("bytes"))
