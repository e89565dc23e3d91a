"""Exact distinct counts that add up across grains (G01, G13).

A distinct count can't be summed: an order on two rows of a coarser grain counts
twice. What adds up is the set itself. Values get dense numbers once; a set is
kept as buckets of 32,768 numbers, and sets of any grain merge bucket by bucket,
combined on the map side: DWT and ADS count exactly from DWS, without DWD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.operators.dims import _dense_key

#: numbers of a bucket, as fixed by Spark's bitmap functions
BUCKET = 32_768


def dense_numbers(df: DataFrame, col: str) -> DataFrame:
    """(number, value): the distinct non-NULL values of a column, numbered from 1
    without a gap. Keep it as a table: states of one numbering merge."""
    return _dense_key(df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()), ["value"], "number")


def distinct_state(df: DataFrame, by: list[str], col: str, numbers: DataFrame) -> DataFrame:
    """The set of ``col`` per ``by``: (by…, bucket, members), a sorted array of
    places in the bucket. A fine grain has few members a bucket, and none more
    than 32,768, whatever the group. NULL values belong to no set; a group
    without values has no rows."""
    n = numbers.select(F.col("value").alias("_value"), F.col("number").alias("_number"))
    rows = df.select(*by, F.col(col).alias("_own")).where(F.col("_own").isNotNull()).join(n, F.col("_own") == F.col("_value"))
    return (rows.groupBy(*by, F.bitmap_bucket_number("_number").alias("bucket"))
            .agg(F.sort_array(F.collect_set(F.bitmap_bit_position("_number").cast("int"))).alias("members")))


def merge_states(state: DataFrame, by: list) -> DataFrame:
    """Sets of a coarser grain: (by…, bucket, bits), a bitmap of 4 KB a bucket.
    ``state`` has members (a fine grain) or bits (an already merged one).
    Members are dealt by group and bucket as they are, and a bitmap is built
    where all of them stand: bitmaps of one or two members each, from every task
    of the map side, compress to nothing in a shuffle but take 4 KB in a sort."""
    if "bits" in state.columns:
        return state.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    fine = state.select(*by, "bucket", "members")
    keys = [F.col(f"`{c}`") for c in fine.columns if c != "members"]
    return (fine.repartition(*keys).withColumn("_member", F.explode("members")).groupBy(*keys)
            .agg(F.bitmap_construct_agg(F.col("_member").cast("long")).alias("bits")))


def distinct_count(state: DataFrame, by: list, name: str) -> DataFrame:
    """(by…, name): the sets' sizes at a grain; ``by`` empty: of their union."""
    merged = merge_states(state, by)
    keys = [c for c in merged.columns if c not in ("bucket", "bits")]
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias(name))
