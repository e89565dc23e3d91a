"""Chat formatting by columnar byte assembly.

Turns of a conversation become one byte string: per batch, numpy computes the
lengths of all headers, contents and footers, their running offsets and the
places where each byte goes, and one preallocated buffer takes them all; no
per-row string is built. Control strings inside contents carry a backslash, so
the template's own marks stay unique and the formatting is reversible.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: the control strings of the template family
BOS, EOS, INST, END_INST, SYS, END_SYS, ROLE, END_ROLE = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
CONTROL = "|".join(re.escape(x) for x in (BOS, EOS, INST, END_INST, SYS, END_SYS, ROLE, END_ROLE))
HEAD = {"user": f"{BOS}{INST} ", "assistant": f"{BOS} ", "system": f"{BOS}{SYS} "}
TAIL = {"user": f" {END_INST}{EOS}", "assistant": f" {EOS}", "system": f" {END_SYS}{EOS}"}
#: bytes assembled at once
SLAB = 8 << 20


def escape(column: pa.Array) -> pa.Array:
    """A backslash before every control string; any backslashes already there
    stay, so ``unescape`` takes off exactly the one that was added."""
    return pc.replace_substring_regex(column, f"({CONTROL})", r"\\\1")


_UNESCAPE = re.compile(rf"\\({CONTROL})".encode())
_TURN = re.compile(rf"(?<!\\){re.escape(BOS)}(.*?)(?<!\\){re.escape(EOS)}".encode(), re.S)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", text)


def _marks(role: str) -> tuple[bytes, bytes]:
    """Header and footer of a turn; a role without marks of its own is written
    out, escaped, between role marks."""
    if role in HEAD:
        return HEAD[role].encode(), TAIL[role].encode()
    name = escape(pa.array([role]))[0].as_py()
    return f"{BOS}{ROLE}{name} {END_ROLE} ".encode(), f" {EOS}".encode()


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copies the segment ``source[starts[i]:starts[i]+lengths[i]]`` to
    ``out[at[i]:…]`` for all i at once, through one pair of index vectors."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    step = np.arange(total, dtype=np.int64)
    out[np.repeat(at - before, lengths) + step] = source[np.repeat(starts - before, lengths) + step]


def assemble(roles: list[str], contents: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer holding all turns back to back, the turns' offsets in it (one
    more than turns) and each content's (start, length) in it."""
    codes: dict[str, int] = {}
    code = np.fromiter((codes.setdefault(r, len(codes)) for r in roles), dtype=np.int64, count=len(roles))
    marks = [_marks(r) for r in codes]
    heads, tails = [m[0] for m in marks], [m[1] for m in marks]
    head_len = np.array([len(h) for h in heads], dtype=np.int64)
    tail_len = np.array([len(t) for t in tails], dtype=np.int64)
    text = escape(contents).cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    size = np.diff(bounds)
    whole = head_len[code] + size + tail_len[code]
    offsets = np.concatenate([[0], np.cumsum(whole)])
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    put = offsets[:-1]
    body = put + head_len[code]
    for mark, lens, at in ((heads, head_len, put), (tails, tail_len, body + size)):
        pool = np.frombuffer(b"".join(mark), dtype=np.uint8)
        _scatter(out, at, pool, (np.cumsum(lens) - lens)[code], lens[code])
    _scatter(out, body, data, bounds[:-1], size)
    return buffer, offsets, np.stack([body, size], axis=1)


CHUNK = ("conv_id long, first_turn long, part long, n_turns long, formatted binary, mask_start array<long>, "
         "mask_length array<long>")


def _slabs(batches):
    """Batches cut so that about SLAB bytes of text are assembled at once; a
    single longer text stands alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False))
        lo, done = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, done + SLAB, side="right")))
            yield batch.slice(lo, hi - lo)
            lo, done = hi, int(size[hi - 1])


def _format(batches):
    part = 0
    for batch in _slabs(batches):
        conv = batch.column(0).to_pylist()
        roles = batch.column(2).to_pylist()
        buffer, offsets, body = assemble(roles, batch.column(3))
        cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        ends = offsets[cuts]
        formatted = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                          [None, pa.py_buffer(ends.astype(np.int64)), buffer])
        learn = np.array([r == "assistant" for r in roles])
        starts, lengths = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            own = body[lo:hi][learn[lo:hi]]
            starts.append((own[:, 0] - offsets[lo]).tolist())
            lengths.append(own[:, 1].tolist())
        turns = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv[i] for i in cuts[:-1]], pa.int64()), pa.array([turns[i] for i in cuts[:-1]], pa.int64()),
             pa.array(range(part, part + len(cuts) - 1), pa.int64()), pa.array(np.diff(cuts), pa.int64()),
             formatted.cast(pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64()))],
            names=["conv_id", "first_turn", "part", "n_turns", "formatted", "mask_start", "mask_length"])
        part += len(cuts) - 1


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", parts: int | None = None) -> DataFrame:
    """Formatted conversations in chunks: a conversation's chunks in the order
    (first_turn, part) hold its bytes, and the loss mask (assistant contents) as
    byte ranges within the chunk.

    Rows are dealt by ranges of (conversation, turn), so one huge conversation
    is formatted by many tasks. Turns go by number (NULL first), equal numbers
    by role, then text; NULL role or text counts as empty; repeated rows stay
    repeated turns; a NULL conversation id is one conversation of its own.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranged.mapInArrow(_format, CHUNK)


def parse(formatted: bytes) -> list[tuple[str, bytes]]:
    """(role, text) of each turn, read from formatted bytes."""
    out = []
    for m in _TURN.finditer(formatted):
        inner = m[1]
        for role in HEAD:
            head, tail = HEAD[role][len(BOS):].encode(), TAIL[role][:-len(EOS)].encode()
            if role != "assistant" and inner.startswith(head):
                out.append((role, unescape(inner[len(head):-len(tail)])))
                break
        else:
            if inner.startswith(ROLE.encode()):
                # a mark inside the name follows a backslash, not a space
                name, _, rest = inner[len(ROLE):].partition(f" {END_ROLE} ".encode())
                out.append((unescape(name).decode(), unescape(rest[:-1])))
            else:
                out.append(("assistant", unescape(inner[1:-1])))
    return out


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: bytes, starts: list[int], lengths: list[int]) -> None:
        for role, text in parse(formatted):
            self.turns.update(role.encode() + b"\n" + text + b"\n")
            self.n += 1
        for start, length in zip(starts, lengths):
            learnt = unescape(formatted[start:start + length])
            self.loss.update(learnt)
            self.loss_chars += len(learnt.decode())
        self.chars += len(formatted.decode())

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def _digests(batches):
    last, state = None, None
    done: list[tuple] = []
    for batch in batches:
        cols = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            conv, formatted, starts, lengths = (c[i].as_py() for c in cols)
            if state is None or conv != last:
                if state is not None:
                    done.append((last, *state.row()))
                last, state = conv, _Digest()
            state.add(formatted, starts, lengths)
        if done:
            yield _digest_rows(done)
            done = []
    if state is not None:
        yield _digest_rows([(last, *state.row())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[x.split()[0] for x in DIGEST.split(", ")])


def read_back(chunks: DataFrame) -> DataFrame:
    """One digest row per conversation, from the formatted chunks alone.

    A SHA-256 over a whole conversation is sequential by nature: its chunks are
    streamed in order through one task, which holds one chunk at a time."""
    ordered = (chunks.select("conv_id", "formatted", "mask_start", "mask_length", "first_turn", "part")
               .repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "part"))
    return ordered.mapInArrow(_digests, DIGEST)


def control_conversation() -> list[tuple]:
    """Conversation -7: both turns consist of control strings."""
    text = f"{EOS}{INST} ok {END_INST}"
    return [(-7, 0, "user", text), (-7, 1, "assistant", text)]


def op3(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = conversations.sparkSession.createDataFrame(control_conversation(), rows.schema)
    return read_back(format_conversations(rows.unionByName(extra)))
