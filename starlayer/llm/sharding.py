"""Sharding by a hierarchical weighted hash tree.

A row descends from the region to the rack to the shard. At each node every
child draws an exponential waiting time whose rate is its weight, from a hash of
the row's id and the child's name; the shortest wait wins, so children are
chosen in proportion to their weights. Weight added later is a layer of its own:
it draws beside the old weight on its path, and a row that it wins stays on that
path. So rows move only into the subtree that grew, and there only to the shard
that was added; nothing moves anywhere else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import Store, part_offsets

REGIONS, RACKS, BASE = 2, 2, 16


def layout(shards: int, base: int = BASE, regions: int = REGIONS, racks: int = RACKS,
           weights: dict[int, float] | None = None) -> list[tuple]:
    """(shard, region, rack, weight, layer) of the first ``shards`` shards: the
    first ``base`` form layer 0, every later one is a layer of its own. Shards
    that ``weights`` does not name weigh 1; a weight must be above 0."""
    weights = weights or {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    return [(s, s % regions, (s // regions) % racks, float(weights.get(s, 1.0)), 0 if s < base else s - base + 1)
            for s in range(shards)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wait(keys: np.ndarray, name: tuple, weight: float) -> np.ndarray:
    """Exponential waiting times with the given rate, from key and child name."""
    salt = np.uint64(0)
    for part in name:
        salt = mix64(np.array([salt ^ np.uint64(part + 1)], dtype=np.uint64))[0]
    u = (mix64(mix64(keys) ^ salt) >> np.uint64(11)).astype(np.float64)
    return -np.log((u + 0.5) / float(1 << 53)) / weight


def place(keys: np.ndarray, shards: list[tuple]) -> np.ndarray:
    """Shard of each key (uint64) under a layout."""
    out = np.full(len(keys), -1, dtype=np.int32)

    def descend(rows: np.ndarray, within: list[tuple], level: int, path: tuple) -> None:
        if not len(rows):
            return
        if level == 3:
            out[rows] = within[0][0]
            return
        level_key = (lambda s: s[1], lambda s: s[2], lambda s: s[0])[level]
        children = sorted({(level_key(s), s[4]) for s in within})
        parts = [[s for s in within if (level_key(s), s[4]) == c] for c in children]
        if len(children) == 1:
            descend(rows, parts[0], level + 1, path + children[0])
            return
        waits = np.stack([wait(keys[rows], path + c, sum(s[3] for s in p)) for c, p in zip(children, parts)])
        won = waits.argmin(axis=0)
        for k, c in enumerate(children):
            descend(rows[won == k], parts[k], level + 1, path + c)

    descend(np.arange(len(keys)), shards, 0, ())
    return out


SHARDED = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, local long"


def shard(docs: DataFrame, shards: int = BASE, text: str = "text", doc_id: str = "doc_id",
          weights: dict[int, float] | None = None) -> DataFrame:
    """Law ``key``: id, number of shards and ``weights`` (1 where not named)
    decide. One row per row of ``docs``.

    ``slot`` counts a shard's rows from 0 without a gap: each task numbers its
    own rows per shard, and the counts of the tasks before (a row per task and
    shard) shift them; no shard meets in one task. NULL ids share one key;
    repeated rows go to one shard with a slot each; a NULL text has size 1 and
    the checksum of no bytes; an empty table gives no rows.
    """
    store = Store(docs.sparkSession)
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).cast("long").alias("text_crc32"))
    now, grown = layout(shards, weights=weights), layout(shards + 1, weights=weights)

    def run(batches):
        part, counted = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own, later = place(keys, now), place(keys, grown)
            local = np.empty(len(own), dtype=np.int64)
            order = np.argsort(own, kind="stable")
            first = np.searchsorted(own[order], np.arange(shards))
            local[order] = np.arange(len(own)) - first[own[order]] + counted[own[order]]
            counted += np.bincount(own, minlength=shards)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(later), pa.array(np.full(len(own), part, dtype=np.int32)), pa.array(local)],
                names=[x.split()[0] for x in SHARDED.split(", ")])

    placed = store.put(rows.mapInArrow(run, SHARDED), "placed", keep=True)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("_n"))
    shift = part_offsets(counts, "part", "_n", by=["shard"]).withColumnsRenamed({"shard": "_shard", "part": "_part"})
    joined = placed.join(shift, (F.col("shard") == F.col("_shard")) & (F.col("part") == F.col("_part")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("local") + F.col("_before")).cast("long").alias("slot"), "grown_shard")


def op7(docs: DataFrame) -> DataFrame:
    return shard(docs)
