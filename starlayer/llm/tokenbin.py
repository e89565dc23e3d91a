"""Token ids in ORC files: integer run-length encoded lists, row indexes and
Bloom filters on the document id, read back stripe by stripe."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlayer.llm.common import Store, part_offsets, slices
from starlayer.llm.tokens import crc32, encoder
from starlayer.session import drop_path, scratch_dir

#: what the writer is told: the stripes are the units of parallel reads, the row
#: index lets a reader skip 1,000 rows at a time, the Bloom filters whole stripes
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
       "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}

ROWS = "doc_id long, part int, seq long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id",
                 tokenizer: str | None = None, parts: int | None = None) -> None:
    """Writes each document's ids and id 0, files and rows in ascending id.

    The text, not the longer ids, is range-partitioned and sorted (NULL ids
    first, equal ids by a hash of the text, then text); ids are made after.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text"))

    def run(batches):
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1024):
            ids, bounds = encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), lists],
                names=["doc_id", "part", "seq", "ids"])
            seq += k

    (ranged.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, ROWS)
     .write.options(**ORC).orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; ``doc_ids`` is pushed to the reader, which skips
    stripes and row groups by their indexes and Bloom filters."""
    rows = spark.read.schema(ROWS).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, seq, n_tokens, ids_crc32) of each document in the files."""
    def run(batches):
        for batch in slices(batches, 512):
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            ids = memoryview(lists.values.to_numpy(zero_copy_only=False).view(np.uint8))
            crc = [crc32(ids[4 * a:4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(run, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long")


def starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: a running sum inside each file part, shifted by the sums
    of the parts before (one row per part, so bounded by the parts)."""
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    shift = part_offsets(rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")), "part", "_n")
    return inside.join(F.broadcast(shift), "part").withColumn("start", (F.col("_in") + F.col("_before")).cast("long"))


def op9(docs: DataFrame) -> DataFrame:
    """Query op9: writes the files, reads them back, returns their digests.

    A NULL or empty text has the end id alone; repeated rows are written as
    often as they occur; an empty table gives empty files and no rows."""
    spark = docs.sparkSession
    store = Store(spark)
    path = scratch_dir(spark, "token_orc")
    write_tokens(docs, path)
    rows = store.put(index(spark, path), "token_index", keep=True)
    drop_path(spark, path)  # the digests are all the query returns
    return starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
