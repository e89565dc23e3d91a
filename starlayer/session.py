"""Session helpers: build a local session for tests/bench, and resolve the
shared checkpoint folder from the session (never a machine-local default on a
cluster)."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: scratch tables of this process, deleted at its end
_SCRATCH: dict[str, SparkSession] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "starlayer") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only a single-JVM session
    (``local`` / ``local[N]``), where driver and executors are one process, may
    fall back to a fresh scratch folder; any other master must name the folder,
    since a machine-local one is not visible to the other machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = _local_fallback(sc.master)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _local_fallback(master: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set and master {master!r} is not one local JVM: "
                           "name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="starlayer-ckpt-", dir="/tmp")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint area for a written table.

    The folder lives until ``drop_path`` or the end of the driver process.
    """
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_drop_all)
    _SCRATCH[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _SCRATCH.pop(path, None)


def _drop_all() -> None:
    for path, spark in list(_SCRATCH.items()):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; scratch only
            return


def cluster_conf(input_bytes: int | None = None) -> dict[str, str]:
    """Recommended settings for a large cluster: AQE re-plans with runtime
    sizes (coalescing small partitions, splitting skewed join partitions);
    the initial shuffle partition count is sized from the input so that no
    reducer starts with more than a few GB."""
    initial = 2000 if input_bytes is None else max(200, int(input_bytes / (512 * 1024 * 1024)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.session.timeZone": "UTC",
    }
