"""Hierarchies (D17–D21, J04): flattening, closure table, materialised path,
subtree filter and roll-up through the closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hier_flatten(edges: DataFrame, node: str = "node_id", parent: str = "parent_id",
                 depth: int = 4) -> DataFrame:
    """D17 — parent–child → depth, level_1 (root) … level_k, one row per node.

    The levels come from the closure: of a node at depth d, the ancestor at
    distance x stands on level d − x. So a node below level k keeps its real
    depth and root, the levels show the top of its path and ``deeper_than_k``
    is set. Grouping is by descendant, whose rows are no more than its depth.
    A parent missing from the edge list ends the path; rows without a node are
    left out; nodes of a cycle show each member once.
    """
    known = edges.select(F.col(node).alias("_k")).dropna().distinct()
    e = edges.join(known, F.col(parent) == F.col("_k"), "left").select(F.col(node), F.col("_k").alias(parent))
    c = hier_closure(e, node, parent).filter(F.col("distance") >= 0)
    placed = c.join(hier_depth(c), "descendant").withColumn("_level", F.col("depth") - F.col("distance"))
    levels = [F.max(F.when(F.col("_level") == i, F.col("ancestor"))).alias(f"level_{i}") for i in range(1, depth + 1)]
    return placed.groupBy(F.col("descendant").alias(node)).agg(F.max("depth").alias("depth"), *levels) \
        .withColumn("deeper_than_k", F.col("depth") > depth)


def hier_closure(edges: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """D18 — closure table (ancestor, descendant, distance), one row per pair
    with the least distance; distance 0 = self.

    Distances double: the pairs up to 2d are those up to d and, for each longer
    shortest path, its first d steps joined with the rest. Pairs known already
    are dropped, so a graph of any depth takes about log2(depth) rounds, each
    written to the shared folder (one-round lineage). A node that reaches
    itself is reported once more, with distance −1.
    """
    from starlayer.session import scratch_dir

    spark = edges.sparkSession
    base = scratch_dir(spark, "closure")
    up = edges.filter(F.col(parent).isNotNull() & F.col(node).isNotNull()).select(
        F.col(parent).alias("ancestor"), F.col(node).alias("descendant"), F.lit(1).alias("distance")).distinct()
    rounds: list[str] = []
    reach, fresh = 1, up
    while True:
        path = f"{base}/upto={reach:08d}"
        fresh.write.parquet(path)
        rounds.append(path)
        known = spark.read.schema(up.schema).parquet(*rounds)
        # a node on its own cycle is no step of a shortest path
        steps = known.filter(F.col("ancestor") != F.col("descendant"))
        first = steps.filter(F.col("distance") == reach).select("ancestor", F.col("descendant").alias("_mid"))
        if first.isEmpty():
            break
        rest = steps.select(F.col("ancestor").alias("_mid"), "descendant", "distance")
        fresh = (first.join(rest, "_mid").groupBy("ancestor", "descendant")
                 .agg((F.min("distance") + reach).cast("int").alias("distance"))
                 .join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"))
        reach *= 2
    nodes = edges.select(F.col(node).alias("ancestor")).filter("ancestor is not null").distinct()
    loops = F.when(F.col("ancestor") == F.col("descendant"), F.lit(-1)).otherwise(F.col("distance"))
    return (nodes.select("ancestor", F.col("ancestor").alias("descendant"), F.lit(0).alias("distance"))
            .unionByName(known.select("ancestor", "descendant", loops.alias("distance"))))


def hier_depth(closure: DataFrame) -> DataFrame:
    """Depth of each node (1 = root) from the closure."""
    return (closure.filter(F.col("distance") >= 0).groupBy("descendant")
            .agg((F.max("distance") + 1).alias("depth")))


def hier_path(closure: DataFrame, sep: str = "/") -> DataFrame:
    """D19 — materialised path ``/root/…/node/`` per node. The ancestors of a
    node are at most its depth, so the per-node list is bounded."""
    c = closure.filter(F.col("distance") >= 0)
    agg = c.groupBy("descendant").agg(
        F.sort_array(F.collect_list(F.struct(F.col("distance"), F.col("ancestor").cast("string").alias("a"))),
                     asc=False).alias("_l"))
    return agg.select(F.col("descendant").alias("node_id"),
                      F.concat(F.lit(sep), F.array_join(F.col("_l.a"), sep), F.lit(sep)).alias("path"))


def hier_path_filter(paths: DataFrame, prefix: str) -> DataFrame:
    """D20 — subtree by path prefix."""
    return paths.filter(F.col("path").startswith(prefix))


def hier_rollup(fact: DataFrame, closure: DataFrame, fact_key: str, measures: dict[str, str]) -> DataFrame:
    """D21 / J04 — measures at every level: the fact is pre-aggregated per
    leaf key, joined to the closure on descendant and re-aggregated per
    ancestor (an equi join; no per-level loop)."""
    pre = fact.groupBy(fact_key).agg(*[F.sum(c).alias(f"_{o}") for o, c in measures.items()],
                                     F.count(F.lit(1)).alias("_rows"))
    c = closure.filter(F.col("distance") >= 0)
    j = c.join(pre, c["descendant"] == pre[fact_key])
    return j.groupBy("ancestor").agg(*[F.sum(f"_{o}").alias(o) for o in measures],
                                     F.sum("_rows").cast("bigint").alias("fact_rows"),
                                     F.count(F.lit(1)).alias("descendants_with_facts"))
