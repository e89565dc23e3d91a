"""Mixing sources to target weights with DataFrame functions only.

Tokens are summed per source, targets follow from weights, and each document is
emitted floor(rate) times plus one copy drawn by a hash of the document, with
the rate's fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import WORD, Store, fresh, global_rank

#: sources up to which the table of rates (some 50 bytes a source) is broadcast
BROADCAST_SOURCES = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(store: Store, sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Sources by code point, NULL last, take the ``weights`` in turn and split
    ``share`` of all tokens in proportion; a target stops at ``most`` times its
    source, and what is above is shared again by weight until none is above.
    The level that all open sources rise to is found by a few aggregates over
    the sources, two numbers each; no source list reaches the driver.
    """
    spark = sizes.sparkSession
    per = store.put(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = per.count()
    order = [F.col("source").asc_nulls_last()]
    ranked = global_rank(spark, store, per, order, parts=1 + n // 50_000)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    open_to = store.put(ranked.select("source", "source_size", weight.alias("weight"),
                                      (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights", keep=True)
    total = open_to.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        capped, left = open_to.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                   F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, max(level, (share * total - capped) / left if left else level)
    target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    out = open_to.select("source", "source_size", target.alias("target"), rate.alias("rate"))
    # a row per source; larger tables are left to the planner
    return F.broadcast(out) if n <= BROADCAST_SOURCES else out


def copies(u: str, rate: str) -> Column:
    return (F.floor(rate) + (F.col(u) < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def emit(docs: DataFrame, seed: int = 17, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text",
         source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix
    takes it. Rows of one id and text are drawn alike; a NULL source is a source
    of its own; empty texts weigh nothing and follow their source's rate."""
    sized = docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
    of, rate, u, copy = fresh(docs.columns, "_of", "_rate", "_u", "_copy")
    with Store(docs.sparkSession) as store:
        rates = targets(store, sized, weights, share, most).select(F.col("source").alias(of), F.col("rate").alias(rate))
    rows = docs.withColumn(u, draw(seed, doc_id, text))
    taken = rows.join(rates, F.col(source).eqNullSafe(F.col(of)))
    again = F.explode(F.array_repeat(F.lit(0), copies(u, rate).cast("int")))
    return taken.withColumn(copy, again).select(*docs.columns)


def mix(docs: DataFrame, seed: int = 17, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``: the mix's
    accounts. An empty table gives no rows; all-empty texts take nothing."""
    spark = docs.sparkSession
    with Store(spark) as store:
        sized = store.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"),
                                      draw(seed, "doc_id", "text").alias("u")), "sized", keep=True)
        rates = targets(store, sized, weights, share, most).withColumnRenamed("source", "of")
    rows = sized.join(rates, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", F.col("source_size").cast("long"), F.col("target").cast("double"),
                       (F.col("size") * copies("u", "rate")).cast("long").alias("taken"))
