"""Exact duplicates by content sort, with DataFrame functions only.

Sampled splitters deal the rows into ranges of (head of the text, hash), each
task sorts its range externally down to the whole text, and neighbouring rows
are compared in full; a run of equal texts keeps one row. Hashes only deal rows
and splitters stay short; what counts as equal is the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlayer.llm.common import Store

#: characters of a text that splitters carry
HEAD = 64
#: bytes of text in a range, and bytes counted for a row besides its text
PART_BYTES, ROW_BYTES = 128 << 20, 64


def _pieces(store: Store, rows: DataFrame) -> tuple[DataFrame, int]:
    """(hot, pieces) for the hashes that hold over half of a range, and the
    number of ranges. Copies are counted with a combine on the map side; at
    most two hashes a range can be that heavy, which bounds the table."""
    spark = rows.sparkSession
    weight = (F.octet_length("body") + ROW_BYTES).cast("long")
    counts = store.put(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")), "copies", keep=True)
    total = counts.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    share = max(1.0, total / (2 * parts))
    heavy = counts.where((F.col("n") > 1) & (F.col("bytes") > share))
    return heavy.select(F.col("hash").alias("hot"), F.least("n", F.ceil(F.col("bytes") / share)).alias("pieces")), parts


def content_sort(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest",
                 normalise: Callable[[Column], Column] | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``; with
    ``carry`` also ``row``, the whole row of ``docs`` as a struct.

    ``normalise`` maps the text before it is compared (default: no change);
    ``keep`` is ``smallest`` or ``largest`` identifier. One row of each group is
    ``kept``, also where rows repeat an id; a NULL id stays only if the group
    has no other (``keep_id`` is NULL then). A NULL text counts as empty, empty
    texts are equal to each other; an empty table gives no rows; further columns
    of any name don't matter.

    A text whose copies would fill over half of a range is cut into pieces by a
    hash of id and input partition. Pieces are groups of their own until a table
    of one row per piece, compared by whole text, joins them.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    body = F.coalesce(F.col(text), F.lit(""))
    body = normalise(body) if normalise else body
    extra = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), *extra).withColumn("hash", F.xxhash64("body"))
    with Store(docs.sparkSession) as store:
        hot, parts = _pieces(store, rows)
        dealt = (rows.join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left")  # two rows a range at most
                 .withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), "pieces"))
                             .otherwise(F.lit(0)).cast("long"))
                 .withColumn("head", F.substring("body", 1, HEAD))
                 .repartitionByRange(parts, "head", "hash", "piece"))
        first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
        # clustered by the ranges' own columns: no exchange, one sort
        run = Window.partitionBy("head", "hash", "piece", "body").orderBy(first)
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        compared = (dealt.withColumn("nth", F.row_number().over(run)).withColumn("best", F.first("doc_id").over(whole))
                    .withColumn("n", F.count(F.lit(1)).over(whole)))
        cut = F.col("pieces") > 1
        sorted_rows = store.put(compared.select(
            "doc_id", F.sha2("body", 256).alias("text_sha256"), "best", "n", "nth", "piece", F.coalesce(cut, F.lit(False)).alias("cut"),
            F.when(cut & (F.col("nth") == 1), F.col("body")).alias("border"), *(["row"] if carry else [])), "sorted", keep=True)
    one = F.struct(F.col("best").isNull().alias("no_id"), F.col("best").alias("id"), F.col("piece").alias("piece"))
    if keep == "largest":
        one = F.struct(F.col("best").isNotNull().alias("has_id"), F.col("best").alias("id"), F.col("piece").alias("piece"))
    joined = (sorted_rows.where("border is not null").groupBy("text_sha256", "border")
              .agg((F.min if keep == "smallest" else F.max)(one).alias("one"), F.sum("n").alias("size"))
              .select(F.col("text_sha256").alias("of"), F.col("one.id").alias("id"), F.col("one.piece").alias("at"), "size"))
    # a row per hot text: at most two a range
    out = sorted_rows.join(F.broadcast(joined), F.col("cut") & (F.col("text_sha256") == F.col("of")), "left")
    return out.select("doc_id", F.when(F.col("cut"), F.col("id")).otherwise(F.col("best")).alias("keep_id"),
                      F.when(F.col("cut"), F.col("size")).otherwise(F.col("n")).cast("long").alias("group_size"),
                      ((F.col("nth") == 1) & (~F.col("cut") | (F.col("piece") == F.col("at")))).alias("kept"),
                      "text_sha256", *(["row"] if carry else []))


def keep_one_copy(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest",
                  normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; cases as in
    :func:`content_sort`."""
    kept = content_sort(docs, text, doc_id, keep, normalise, carry=True).where("kept")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op11(docs: DataFrame) -> DataFrame:
    """Query op11: texts as they are, the largest doc_id stays."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return content_sort(rows, keep="largest")


OP11_SQL = """
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""
