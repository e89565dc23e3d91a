"""Best-fit packing of tokenised documents into fixed-length sequences, refined
by swap-based local search.

Documents longer than a sequence are cut, the first piece taking what is left
over, so that all other pieces fill a sequence alone. The short pieces are dealt
evenly to groups of bounded size; each group is packed best-fit by falling
length, then moves, one-for-one and two-for-one exchanges between underfull bins
raise the sum of squared fills until the emptiest bins run empty.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import Store, slices, small_batches
from starlayer.llm.tokens import crc32, encoder

LENGTH = 2048
#: short pieces packed together; a group wastes at most about one sequence
GROUP = 65_536
#: chunks that a packing worker's encoder remembers: fewer than by itself, since
#: the pipeline packs on executors whose heap earlier stages have filled
PACK_CHUNKS = 200_000


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n if n <= length else (n % length or length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
           tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each tokenised document (its ids, then id 0)."""
    def run(batches):
        encode = encoder(tokenizer, PACK_CHUNKS)
        for batch in slices(batches, 512):
            out = []
            ids, bounds = encode(batch.column(1))
            data = memoryview(ids).cast("B")
            for doc, lo, hi in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                out += [(doc, k, s, n, crc32(data[4 * (lo + s):4 * (lo + s + n)])) for k, (s, n) in enumerate(cut(hi - lo, length))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession, 512, 2 << 20)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


# --- packing one group --------------------------------------------------------

def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin
    that takes it. ``room`` has a bit per free capacity that some bin has."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    room = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = room >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                room &= ~(1 << free)
            bins[b].append(item)
        else:
            free, b = capacity, len(bins)
            bins.append([item])
        by_free[free - n].append(b)
        room |= 1 << (free - n)
    return bins


class _Underfull:
    """Bins that have room, found by their free space and their items' lengths.

    ``kinds`` has a bit per length that some bin of a free space holds, bit 0
    standing for taking nothing out; ``frees`` a bit per free space.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size = bins, size
        self.free = [capacity - sum(size[i] for i in b) for b in bins]
        self.holders: dict[tuple[int, int], dict[int, None]] = {}
        self.kinds = [0] * (capacity + 1)
        self.frees = 0
        for b in range(len(bins)):
            self.add(b)

    def _kinds(self, b: int) -> set[int]:
        return {0, *(self.size[i] for i in self.bins[b])} if self.free[b] and self.bins[b] else set()

    def add(self, b: int) -> None:
        free = self.free[b]
        for n in self._kinds(b):
            self.holders.setdefault((free, n), {})[b] = None
            self.kinds[free] |= 1 << n
            self.frees |= 1 << free

    def remove(self, b: int) -> None:
        free = self.free[b]
        for n in self._kinds(b):
            holders = self.holders[free, n]
            del holders[b]
            if not holders:
                del self.holders[free, n]
                self.kinds[free] &= ~(1 << n)
                if not self.kinds[free]:
                    self.frees &= ~(1 << free)

    def best(self, amounts: dict[int, tuple[int, ...]], most: int) -> tuple[int, int, int] | None:
        """(free, back, amount) of the exchange that moves most into a bin with
        at most ``most`` free: ``amount`` goes in, an item of ``back`` comes out."""
        gain, found = 0, None
        frees = self.frees & ((1 << most + 1) - 1)
        while frees:
            free = frees.bit_length() - 1
            if free <= gain:  # no exchange moves more than is free
                break
            frees ^= 1 << free
            kinds = self.kinds[free]
            for amount in amounts:
                least = max(0, amount - free)
                fits = (kinds & ((1 << amount) - 1)) >> least
                if fits:
                    back = least + (fits & -fits).bit_length() - 1
                    if amount - back > gain:
                        gain, found = amount - back, (free, back, amount)
        return found


def _amounts(items: list[int], size: list[int]) -> dict[int, tuple[int, ...]]:
    """The lengths of one item and of two, with items that have them."""
    own: dict[int, list[int]] = defaultdict(list)
    for i in items:
        own[size[i]].append(i)
    out = {n: (some[0],) for n, some in own.items()}
    few = [i for some in own.values() for i in some[:2]]
    for x, i in enumerate(few):
        for j in few[x + 1:]:
            out.setdefault(size[i] + size[j], (i, j))
    return out


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins by exchanges that each raise the sum of squared fills.

    The emptiest underfull bin gives: an item moves to a bin at least as full
    with room, or one or two of its items are exchanged for a shorter one there.
    Of all such exchanges the one that moves most is made, until there is none;
    then the next emptiest gives, and rounds go on until one finds no exchange
    between any two bins. A bin that has given all it had is gone.
    """
    size = lengths.tolist()
    under = _Underfull(bins, size, capacity)
    free, exchanged = under.free, True
    while exchanged:
        exchanged = False
        for giver in sorted((b for b in range(len(bins)) if bins[b] and free[b]), key=lambda b: -free[b]):
            under.remove(giver)
            while bins[giver] and free[giver]:
                amounts = _amounts(bins[giver], size)
                found = under.best(amounts, free[giver])
                if not found:
                    break
                room, back, amount = found
                taker = next(iter(under.holders[room, back]))
                under.remove(taker)
                for i in amounts[amount]:
                    bins[giver].remove(i)
                    bins[taker].append(i)
                if back:
                    j = next(i for i in bins[taker] if size[i] == back)
                    bins[taker].remove(j)
                    bins[giver].append(j)
                free[taker] -= amount - back
                free[giver] += amount - back
                under.add(taker)
                exchanged = True
            under.add(giver)
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = LENGTH) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


# --- packing all --------------------------------------------------------------------

PACKED = PIECES + ", sequence_id long, offset long"


def pack(store: Store, cut_pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``PIECES``.

    Pieces of full length are sequences of their own and are not shuffled. The
    others, a few numbers a row, are dealt round-robin, so that neither a hot
    document nor a hot source meets in one group, and a task holds one group.
    """
    whole = (cut_pieces.where(F.col("length") == length)
             .withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long")))
    short = cut_pieces.where(F.col("length") < length)
    n = short.count()

    def run(batches):
        serial = (TaskContext.get().partitionId() << 36)
        held: list[pa.RecordBatch] = []

        def flush():
            nonlocal serial
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows.column("length").to_numpy()
            bins = pack_lengths(lengths, length)
            at = np.empty(len(lengths), dtype=np.int64)
            sequence = np.empty(len(lengths), dtype=np.int64)
            for b in bins:
                at[b] = np.cumsum(lengths[b]) - lengths[b]
                sequence[b] = 2 * serial + 1
                serial += 1
            out = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(at))
            return out.to_batches(max_chunksize=8192)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * group:
                yield from flush()
                held = []
        if held:
            yield from flush()

    packed = short.repartition(max(1, -(-n // group))).mapInArrow(run, PACKED)
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                   tokenizer: str | None = None) -> DataFrame:
    """Tokenises, cuts and packs ``docs``; one row per piece.

    A NULL or empty text is one piece of one token; a NULL id is carried along;
    repeated rows are packed as often as they occur; an empty table gives no
    rows. Numbers of sequences mean nothing but equality.
    """
    store = Store(docs.sparkSession)
    rows = store.put(pieces(docs, text, doc_id, length, tokenizer), "pieces", keep=True)
    return pack(store, rows, length)


def op6(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
