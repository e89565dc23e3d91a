"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors with cosine c are sqrt(2 - 2c) apart. After a fixed rotation
the vector is split into blocks; a pair within the distance must, in at least
one block, be within the block's proportional share of the squared distance.
Each block is range-joined on a grid over its first coordinates, and the union
of the blocks' candidates is verified by the exact cosine of the given vectors.
A pair is counted once: in the first block whose share it keeps to, in the one
cell where both its ends meet.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import Store, components, local_labels, runs

THRESHOLD = 0.93
#: coordinates of a block
BLOCK = 16
#: vectors compared in one task; a fuller cell is compared in pairs of parts
CELL = 6000
#: cells over CELL up to which their list is broadcast
BROADCAST_CELLS = 100_000
#: added to squared shares, against rounding
SLACK = 1e-9


@lru_cache
def rotation(dim: int) -> np.ndarray:
    """The fixed random rotation of a dimension."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows, rotated; each row's result is the same in
    whatever batch it stands (row sums, no matrix product)."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    q = rotation(x.shape[1])
    return np.stack([(unit * q[:, c]).sum(axis=1) for c in range(x.shape[1])], axis=1)


def blocks(dim: int, threshold: float, block: int = BLOCK) -> list[tuple[slice, float]]:
    """(coordinates, share of the squared distance) of each block."""
    total = 2 - 2 * threshold
    return [(slice(lo, min(lo + block, dim)), total * (min(lo + block, dim) - lo) / dim) for lo in range(0, dim, block)]


def grid_width(n: int) -> int:
    """Coordinates that the grid uses for a label of ``n`` vectors: each cuts
    the cells about 2.5 times smaller, and adds half as many copies."""
    return int(np.clip(np.ceil(np.log(max(n, 1) / 2000) / np.log(2.5)), 1, 6))


CELLS = "cell string, home array<int>, at array<int>, block int, dim int, cid long, n long, vec binary"


def _cells(threshold: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "v"}
            dims = np.array(cols["dim"])
            vectors = batch.column(batch.schema.get_field_index("v"))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                r = rotate(x)
                out = []
                for b, (part, share) in enumerate(blocks(dim, threshold)):
                    radius = np.sqrt(share + SLACK) + SLACK
                    side = 2 * radius
                    for i, row in enumerate(own.tolist()):
                        # the widths agree for a label, so its vectors share one grid
                        width = min(grid_width(cols["of"][row]), part.stop - part.start)
                        place = r[i, part][:width] / side
                        home = np.floor(place).astype(int)
                        low = (place - home) * side <= radius
                        for down in product(*((0, 1) if v else (0,) for v in low)):
                            at = (home - down).tolist()
                            out.append((f"{cols['label'][row]}|{dim}|{b}|{at}", home.tolist(), at, b, dim,
                                        cols["cid"][row], cols["n"][row], x[i].tobytes()))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(),
                         pa.int64(), pa.binary()]
                names = [c.split()[0] for c in CELLS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    return run


def compare(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one cell (or of two parts of it): (cid, copies linked, cid of
    the smallest row linked directly or not)."""
    dim, b = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
    sub = group.column("sub").to_numpy()
    x = np.frombuffer(b"".join(group.column("vec").to_pylist()), dtype=np.float64).reshape(-1, dim)
    n = len(x)
    cid, copies = group.column("cid").to_numpy(), group.column("n").to_numpy()
    home, at = np.array(group.column("home").to_pylist()), np.array(group.column("at")[0].as_py())
    r, norm = rotate(x), np.sqrt((x * x).sum(axis=1))
    shares = blocks(dim, threshold)
    part, share = shares[b]
    y = r[:, part]
    square = (y * y).sum(axis=1)
    links = np.zeros(n, dtype=np.int64)
    label = np.arange(n)
    rows = np.flatnonzero(sub == left)
    others = np.flatnonzero(sub == right)
    for lo in range(0, len(rows), 256):
        own = rows[lo:lo + 256]
        apart = square[own][:, None] + square[others][None] - 2 * y[own] @ y[others].T
        near = apart <= share + 2 * SLACK
        if left == right:
            near &= others[None] > own[:, None]
        i, j = np.nonzero(near)
        i, j = own[i], others[j]
        for start in range(0, len(i), 100_000):
            p, q = i[start:start + 100_000], j[start:start + 100_000]
            mine = (np.minimum(home[p], home[q]) == at).all(axis=1)
            p, q = p[mine], q[mine]
            for k, (coords, limit) in enumerate(shares[:b + 1]):
                within = ((r[p, coords] - r[q, coords]) ** 2).sum(axis=1) <= limit + SLACK
                keep = within if k == b else ~within
                p, q = p[keep], q[keep]
            alike = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
            p, q = p[alike], q[alike]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            label = local_labels(n, p, q, label)
    hit = links > 0
    return cid[hit], links[hit], cid[label[hit]]



def pair_parts(rows: DataFrame, key: str, parts: str, by: str) -> DataFrame:
    """Deals the rows of a key to pairs (left <= right) of its ``parts`` parts,
    so that all pairs of rows meet and no task holds more than two parts."""
    sub = F.pmod(F.xxhash64(by), F.col(parts)).cast("int")
    dealt = rows.withColumn("sub", sub).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return dealt.withColumn("left", F.least("sub", "other")).withColumn("right", F.greatest("sub", "other")).drop("other")


LINKED = "cid long, links long, root long"


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Only rows of one label and one dimension are compared. Identical vectors,
    and those that differ by a power of two, are one class that is joined once
    and link with each other. A row without
    id or label, or whose vector is NULL, empty, zero or holds a NULL or
    non-finite component, links with nothing and is its own component.
    Repeated rows count as vectors of their own; an empty table gives no rows.
    """
    store = Store(vectors.sparkSession)
    v = F.transform(F.col(embedding), lambda c: c.cast("double") + 0.0)  # no negative zero
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0.0),
        F.lit(False)))
    # a power of two brings the largest component near 1: no square over- or underflows, no bit of a cosine changes
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))))
    rows = rows.withColumn("sound", sound).withColumn("v", F.when(F.col("sound"), F.transform("v", lambda c: c / scale)))
    rows = rows.withColumn("cid", F.when(F.col("sound"), F.xxhash64("label", "v")))
    classes = store.put(rows.where("cid is not null").groupBy("cid", "label", "v")
                        .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
                        .withColumn("dim", F.size("v")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("of"))
    placed = store.put(classes.join(sizes, ["label", "dim"]).select("label", "dim", "of", "cid", "n", "v")
                       .mapInArrow(_cells(threshold), CELLS), "cells")
    full = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell")).where(F.col("in_cell") > CELL)
    full = full.select("cell", F.ceil(F.col("in_cell") / CELL).cast("int").alias("parts"))
    full = F.broadcast(full) if full.count() <= BROADCAST_CELLS else full
    dealt = pair_parts(placed.join(full, "cell", "left").fillna({"parts": 1}), "cell", "parts", "cid")

    def run(batches):
        for group in runs(batches, ["cell", "left", "right"]):
            cid, links, root = compare(group, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links), pa.array(root)], names=["cid", "links", "root"])

    keys = ["cell", "left", "right"]
    found = store.put(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, LINKED), "linked")
    tied = components(store, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = (classes.select("cid", "n", "first").join(links, "cid", "left")
             .join(tied.withColumnRenamed("node", "cid"), "cid", "left").fillna({"links": 0}))
    first = known.where("component is not null").groupBy("component").agg(F.min("first").alias("component_first"))
    known = known.join(first, "component", "left").select(
        "cid", (F.col("n") - 1 + F.col("links")).alias("n_links"),
        F.coalesce("component_first", "first").alias("component_id"))
    known = store.put(known, "known", keep=True)
    out = rows.select("vec_id", "cid").join(known, "cid", "left")
    out = store.put(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                               F.coalesce("component_id", "vec_id").alias("component_id")), "near_vectors", keep=True)
    store.__exit__()
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
