"""Jaccard join of shingle sets by T-occurrence search.

Sets linked at a similarity share most of their shingles. A bottom-k prefix of
each set, taken in one global order, proves for most documents that no partner
can exist; the rest falls into families that share rare-enough prefixes. Inside a
family an inverted index answers each set's query by DivideSkip: short lists are
merged on a heap that skips what can't reach the threshold, long lists are
probed by binary search for the candidates that are left, and those reaching the
overlap that the two sizes require are linked.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from starlayer.llm.common import Store, components, fresh, held, runs, slices
from starlayer.llm.sharding import mix64
from starlayer.llm.vecdedup import pair_parts

#: a near duplicate by default: five-word shingles, similarity 0.8
PERCENT = 80
SHINGLE = 5
#: prefix beyond the necessary one, as a share of the set: a document must share
#: at least that much of its prefix with others to stay
EXTRA = 20
#: shingles of one part of a family; a larger family is searched in pairs of parts
PART = 2_000_000
#: family members up to which their ids (24 bytes each) are broadcast
BROADCAST_MEMBERS = 1_000_000
#: word hashes that a worker remembers
MOST_WORDS = 300_000
#: cost of a heap step in binary probes, for the number of long lists
MU = 0.0085


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text's
    whole sequence is its one shingle; without words, none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = held("words", _Words)
    if len(known) > MOST_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mix64(out ^ h[k:len(h) - n + 1 + k])
    return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any partner."""
    return -(-percent * n // 100)


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + -(-n // EXTRA) if n else 0


SETS = "doc_id long, n long, set_id long, prefix array<long>"


def sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            found = [shingles(t, width) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            lists = _lists([s[:prefix_length(len(s), percent)].view(np.int64) for s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in found], pa.int64()), lists],
                names=["doc_id", "n", "set_id", "prefix"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SETS)


# --- T-occurrence search in one family ---------------------------------------------

class Index:
    """Inverted lists over the sets of a family, members in order of size."""

    def __init__(self, members: list[np.ndarray]):
        self.size = np.array([len(m) for m in members], dtype=np.int64)
        every = np.concatenate(members)
        owner = np.repeat(np.arange(len(members)), self.size)
        order = np.lexsort((owner, every))
        every, self.owner = every[order], owner[order]
        self.tokens, self.start = np.unique(every, return_index=True)
        self.end = np.append(self.start[1:], len(every))
        # (list, member) as one ascending number: one binary search probes a list
        self.step = len(members)
        self.keys = np.repeat(np.arange(len(self.tokens)), self.end - self.start) * self.step + self.owner

    def search(self, query: np.ndarray, percent: int, skip: np.ndarray) -> list[int]:
        """Members that reach the overlap which their size and the query's
        require; ``skip`` marks members that need not be found."""
        n = len(query)
        need = least_overlap(n, percent)
        lo = int(np.searchsorted(self.size, need))
        hi = int(np.searchsorted(self.size, n * 100 // percent, side="right"))
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query]
        # lists of members in the size window only
        first = np.searchsorted(self.keys, at * self.step + lo)
        last = np.searchsorted(self.keys, at * self.step + hi)
        some = last > first
        at, first, last = at[some], first[some], last[some]
        if len(at) < need:
            return []
        length = last - first
        order = np.argsort(length, kind="stable")
        long = min(need - 1, int(need / (MU * np.log2(max(int(length.max()), 2)) + 1)))
        short, probed = order[:len(order) - long], order[len(order) - long:]
        member, count = merge([self.owner[a:b] for a, b in zip(first[short], last[short])], need - long)
        wanted = ~skip[member]
        member, count = member[wanted], count[wanted]
        size = self.size[member]
        enough = -(-percent * (n + size) // (100 + percent))  # overlap at which the similarity is reached
        for k, (a, b) in enumerate(zip(first[probed].tolist(), last[probed].tolist())):
            if not len(member):
                break
            items = self.owner[a:b]
            spot = np.searchsorted(items, member)
            count = count + (items[np.minimum(spot, len(items) - 1)] == member)
            if k % 8 == 7:  # who misses too many lists is out
                still = count + (long - 1 - k) >= enough
                member, count, enough = member[still], count[still], enough[still]
        return member[count >= enough].tolist()


def merge(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in at least ``need`` of the sorted lists, and in how many. Many
    entries are merged by one stable sort of the runs, few by the skipping heap."""
    if sum(map(len, lists)) > 1000:
        member, count = np.unique(np.concatenate(lists), return_counts=True)
        return member[count >= need], count[count >= need]
    found = np.array(merge_skip([x.tolist() for x in lists], need), dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(member, occurrences) of members in at least ``need`` of the sorted
    lists. Where the smallest head falls short, the ``need`` - 1 smallest heads
    are popped together and jump to the next head."""
    heap = [(items[0], k, 0) for k, items in enumerate(lists)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            out.append((top, len(popped)))
            jump = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            jump = heap[0][0]
        for _, k, pos in popped:
            pos = bisect_left(lists[k], jump, pos)
            if pos < len(lists[k]):
                heapq.heappush(heap, (lists[k][pos], k, pos))
    return out


def join_family(sizes: np.ndarray, members: list[np.ndarray], side: np.ndarray, left: int, right: int,
                percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (member, member) that connect whatever is linked among the members
    (left = right) or between two parts of them.

    A query can be left out once nothing unqueried lies outside its component:
    any link it could still find is inside. So a large group of near copies
    costs a few queries, and no link that joins two components is missed.
    """
    order = np.lexsort((np.arange(len(members)), sizes))
    own, other = order[side[order] == left], order[side[order] == right]
    if not len(own) or not len(other):
        return []
    index = Index([members[i] for i in other])
    component = np.arange(len(members))
    waiting = np.zeros(len(members), dtype=bool)
    waiting[own] = True
    links = []
    while True:
        # what a waiting query may have to be joined with
        left_over = np.flatnonzero(waiting)
        if not len(left_over):
            break
        open_to = left_over if left == right else np.concatenate([left_over, other])
        names, counts = np.unique(component[open_to], return_counts=True)
        if len(names) == 1:
            break
        largest = names[counts.argmax()]
        outside = left_over[component[left_over] != largest]
        turn = (outside if len(outside) else left_over)[:64]
        for q in turn.tolist():
            waiting[q] = False
            for k in index.search(members[q], percent, component[other] == component[q]):
                m = int(other[k])
                if component[m] != component[q]:
                    component[component == component[m]] = component[q]
                    links.append((q, m))
    return links


# --- the join ----------------------------------------------------------------------------

def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, text: str = "text",
                       doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Equal sets are joined once. ``component_id`` is the smallest id reachable
    by links. A row without words or without id links with nothing and is its
    own component; repeated rows are equal sets; an empty table gives no rows.
    """
    return _labelled(docs, percent, width, text, doc_id, ["doc_id", "n_shingles", "component_id"])


def _labelled(docs: DataFrame, percent: int, width: int, text: str, doc_id: str, names: list[str]) -> DataFrame:
    """``names`` of (doc_id, n_shingles, component_id, set_id, component) for
    every row; ``component`` is a set of the component, the same for all its rows."""
    spark = docs.sparkSession
    store = Store(spark)
    rows = store.put(sets(docs, text, doc_id, percent, width), "sets")
    distinct = store.put(rows.where("n > 0 and doc_id is not null").groupBy("set_id", "n")
                         .agg(F.min("doc_id").alias("first"), F.any_value("prefix").alias("prefix")), "distinct_sets")
    ids = store.put(_sharing(store, distinct, percent).select("set_id").distinct(), "sharing")
    wanted = distinct.select("set_id", "n", "first").join(ids, "set_id")
    kept = store.put(_whole_sets(docs, wanted, ids.count(), width, text, doc_id), "whole_sets")
    families = store.put(_families(store, kept, percent), "families")
    links = store.put(_links(kept, families, percent), "links")
    tied = components(store, links).withColumnRenamed("node", "set_id")
    named = distinct.select("set_id", "first").join(tied, "set_id")
    label = named.groupBy("component").agg(F.min("first").alias("component_id"))
    tied = named.join(label, "component").select("set_id", "component", "component_id")
    classes = distinct.select("set_id", "first").join(tied, "set_id", "left").select(
        "set_id", F.coalesce("component", "set_id").alias("component"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    out = store.put(out.join(classes, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "component")
        .select(*names), "jaccard", keep=True)
    store.__exit__()
    return out


def _sharing(store: Store, prefixes: DataFrame, percent: int) -> DataFrame:
    """(token, set_id, n): prefix shingles that two sets of fitting size have,
    of the sets that may have a partner.

    Two linked sets share at least as many prefix shingles as the smaller one's
    prefix has beyond the necessary; a set with fewer shared ones is left out.
    """
    postings = prefixes.select(F.explode("prefix").alias("token"), "set_id", "n")
    near = (postings.withColumn("before", F.lag("n").over(_by_token())).withColumn("after", F.lead("n").over(_by_token()))
            .where(_fits("before", "n", percent) | _fits("n", "after", percent)).select("token", "set_id", "n"))
    near = store.put(near, "shared_postings")
    smallest = F.ceil(F.col("n") * percent / 100)
    enough = (near.groupBy("set_id", "n").agg(F.count(F.lit(1)).alias("shared"))
              .where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(smallest / EXTRA))).select("set_id"))
    return near.join(enough, "set_id")


def _by_token():
    return Window.partitionBy("token").orderBy("n", "set_id")


def _fits(small: str, large: str, percent: int) -> Column:
    return F.coalesce(F.col(small) * 100 >= F.col(large) * percent, F.lit(False))


def _families(store: Store, kept: DataFrame, percent: int) -> DataFrame:
    """(set_id, family, parts) of the sets that may have a partner, from whole
    sets (set_id, n, shingles).

    Prefixes are taken anew with the rarest shingles of the sets left first: a
    passage that many share is at the end of the order, so it neither keeps a
    set nor ties families together. Neighbours in a shingle's list, ordered by
    size, form one family.
    """
    postings = kept.select("set_id", "n", F.explode("shingles").alias("token"))
    counted = postings.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")))
    need = F.ceil(F.col("n") * percent / 100)
    length = (F.col("n") - need + F.ceil(F.col("n") / EXTRA)).cast("int")
    prefixes = (counted.groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
                .select("set_id", "n", F.slice("all", F.lit(1), length).alias("prefix")))  # one set's shingles
    prefixes = prefixes.select("set_id", "n", F.transform(F.filter("prefix", lambda t: t.df > 1), lambda t: t.token).alias("prefix"))
    chained = (_sharing(store, prefixes, percent).withColumn("before", F.lag("n").over(_by_token()))
               .withColumn("previous", F.lag("set_id").over(_by_token())).where(_fits("before", "n", percent))
               .select(F.col("set_id").alias("a"), F.col("previous").alias("b")))
    family = components(store, chained).select(F.col("node").alias("set_id"), F.col("component").alias("family"))
    members = family.join(kept.select("set_id", "n"), "set_id")
    parts = members.groupBy("family").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    return members.join(parts, "family").select("set_id", "family", "parts")


def _whole_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int, text: str, doc_id: str) -> DataFrame:
    """(set_id, n, shingles) of the wanted (set_id, n, first), from their texts."""
    wanted = wanted.select(F.col("first").alias("doc"), "set_id", "n")
    if n_wanted <= BROADCAST_MEMBERS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).join(wanted, "doc")

    def read(batches):
        for batch in slices(batches, 256):
            _, body, ids, n = batch.columns
            found = [shingles(t, width) for t in pc.cast(body, pa.binary()).to_pylist()]
            same = pa.array([len(s) > 0 and set_id(s) == i for s, i in zip(found, ids.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, n, _lists([s.view(np.int64) for s in found])],
                                             names=["set_id", "n", "shingles"]).filter(same)

    # an id that repeats with the same set is read once more than needed
    return texts.mapInArrow(read, "set_id long, n long, shingles array<long>").dropDuplicates(["set_id"])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()),
                                    pa.array(np.concatenate([*arrays, np.empty(0, dtype=np.int64)])))


def _links(kept: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets that span the components of each family."""
    keys = ["family", "left", "right"]
    dealt = pair_parts(kept.join(families, "set_id"), "family", "parts", "set_id").select(*keys, "sub", "set_id", "n", "shingles")

    def search(batches):
        for group in runs(batches, keys):
            group = group.combine_chunks()
            ids = group.column("set_id").to_numpy()
            lists = group.column("shingles").chunk(0)
            values, bounds = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            links = join_family(group.column("n").to_numpy(), [values[a:b] for a, b in zip(bounds, bounds[1:])],
                                group.column("sub").to_numpy(), group.column("left")[0].as_py(),
                                group.column("right")[0].as_py(), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(side)]) for side in zip(*links)], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each component: a
    row with the smallest id. Rows that repeat an id compete only within a
    component; rows without words or id all stay."""
    found = _labelled(docs, percent, width, text, doc_id, ["doc_id", "n_shingles", "component_id", "set_id", "component"])
    key, of, component = fresh(docs.columns, "_id", "_set", "_component")
    same = F.col(doc_id).cast("long") == F.col(key)
    worded = found.where("doc_id is not null and n_shingles > 0")
    first = worded.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    dropped = first.where((F.col(key) != F.col("least")) & (F.col("rows") == 1)).select(key)
    repeated = first.where("rows > 1").select(key)
    left = docs.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return left
    twice = _with_set(left.join(repeated, same, "left_semi"), width, text, of)
    places = (worded.where("doc_id = component_id").withColumnRenamed("doc_id", key).join(repeated, key, "left_semi")
              .select(key, F.col("set_id").alias(f"{of}_place"), F.col("component").alias(component)).distinct())
    one = (twice.join(places, same & (F.col(of) == F.col(f"{of}_place")))
           .dropDuplicates([key, component]).select(docs.columns))
    return (left.join(repeated, same, "left_anti")
            .unionByName(twice.where(F.col(of).isNull()).select(docs.columns)).unionByName(one))


def _with_set(docs: DataFrame, width: int, text: str, name: str) -> DataFrame:
    """``docs`` with column ``name``, the id of a row's shingle set, NULL without words."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, 256):
            found = [shingles(t, width) for t in pc.cast(batch.column(at), pa.binary()).to_pylist()]
            ids = pa.array([set_id(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def op10(docs: DataFrame) -> DataFrame:
    """Query op10: three-word shingles, similarity 0.9."""
    return jaccard_components(docs, percent=90, width=3)
