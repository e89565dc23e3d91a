"""Conversation structure repair by Wagner-Fischer alignment with the grammar.

A repaired conversation's role initials are ``(s?(ua)+)?``: for every length
there is one target string, an alternation that an ``s`` may open. Turns are
aligned with the targets of all feasible lengths in one table per ending (a
shorter target is the end of a longer one), inside an Ukkonen band that the cost
of a greedy repair bounds; equally cheap alignments are traced and their audits
compared.

A conversation is cut into pieces of a bounded number of turns, wherever the
ranges of the sorted turns end. A piece is aligned between every pair of grammar
states, so a huge conversation is aligned by many tasks, and one short row per
piece joins the pieces to the cheapest, then least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import Store

#: fixed values: costs of the edits, and of a truncated turn that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: turns aligned at once
PIECE = 256
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 28

# --- alignment of one piece --------------------------------------------------------------
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A turn that may stay is a letter:
# its initial (other initials: x), in upper case if it is truncated.


def _table(sub: dict[str, np.ndarray], n: int, end: int, bound: int, cut: int) -> np.ndarray:
    """``f[i, r]``: least cost of aligning the turns from i on with the last r
    letters of the alternation that ends in state ``end``. Only cells that an
    alignment of at most ``bound`` can meet are filled: r letters for m turns
    take m - r deletions or r - m insertions (``cut``: cost that truncated turns
    cause in any case)."""
    down, up = bound // DELETE, max(0, bound - cut) // INSERT
    width = n + up + 1
    f = np.full((n + 1, width), FAR, dtype=np.int64)
    slope = INSERT * np.arange(width, dtype=np.int64)
    f[n, :up + 1] = slope[:up + 1]
    for i in range(n - 1, -1, -1):
        m = n - i
        lo, hi = max(0, m - down), m + up + 1
        row = f[i + 1, lo:hi] + DELETE
        if hi > 1:
            at = max(lo, 1)
            want = np.where(np.arange(at, hi) % 2 == 1, sub["a" if end == 3 else "u"][i], sub["u" if end == 3 else "a"][i])
            row[at - lo:] = np.minimum(row[at - lo:], f[i + 1, at - 1:hi - 1] + want)
        f[i, lo:hi] = np.minimum.accumulate(row - slope[lo:hi]) + slope[lo:hi]
    return f


def _wanted(end: int, r: int) -> str:
    """The letter that is next when ``r`` letters are left."""
    return "a" if (r % 2 == 1) == (end == 3) else "u"


def _trace(f: np.ndarray, turns: str, end: int, i: int, r: int) -> str:
    """The least audit among the cheapest alignments of f[i, r]: D before I
    before K before R wherever they cost the same."""
    n, out = len(turns), []
    while i < n or r:
        here = f[i, r]
        if i < n and f[i + 1, r] + DELETE == here:
            out.append("D")
            i += 1
        elif r and f[i, r - 1] + INSERT == here:
            out.append("I")
            r -= 1
        else:
            out.append("K" if turns[i].lower() == _wanted(end, r) else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def _greedy(turns: str) -> int:
    """The cost of one repair that starts with u and ends after a."""
    cost, want, any_left = 0, "u", False
    for t in turns:
        if t.isupper():
            cost += DELETE
            continue
        cost += KEEP if t == want else REROLE
        want, any_left = "a" if want == "u" else "u", True
    return cost + (2 * INSERT if not any_left else INSERT if want == "a" else 0)


def _align(turns: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the best way through a piece for each pair of states
    before and after it; pairs that can't be are left out."""
    n = len(turns)
    out = {(e, e): (DELETE * n, "D" * n) for e in range(4)}
    keep = np.array([KEEP + TRUNCATED * t.isupper() for t in turns], dtype=np.int64)
    sub = {w: keep + np.array([0 if t.lower() == w else REROLE for t in turns], dtype=np.int64) for w in "ua"}
    # any start and ending costs at most an insertion at each side more than the greedy repair
    bound = _greedy(turns) + 2 * INSERT
    cut = DELETE * sum(t.isupper() for t in turns)
    system = [k for k, t in enumerate(turns) if t.lower() == "s"]
    if system:  # only an s: the last of the cheapest stays
        k = max(system, key=lambda k: (-keep[k], k))
        out[0, 1] = (DELETE * (n - 1) + int(keep[k]), "D" * k + "K" + "D" * (n - 1 - k))
    for end in (2, 3):
        f = _table(sub, n, end, bound, cut)
        lengths = np.arange(1, f.shape[1])
        for first, states in (("u", (0, 1, 3)), ("a", (2,))):
            feasible = lengths[(lengths % 2 == 1) == (_wanted(end, 1) == first)]
            costs = f[0, feasible]
            # keys as (kept s, turns before it, length): cheapest first, then the audits
            ways = {(-1, 0, int(r)): int(c) for r, c in zip(feasible, costs) if c < FAR}
            plain = _best(f, turns, end, ways)
            for e in states:
                if e == 0:
                    for k in system:
                        opened = lengths[(lengths % 2 == 1) == (_wanted(end, 1) == "u")]
                        for r, c in zip(opened, f[k + 1, opened]):
                            if c < FAR:
                                ways[k, k + 1, int(r)] = int(c) + DELETE * k + int(keep[k])
                    best = _best(f, turns, end, ways)
                else:
                    best = plain
                out[e, end] = min(best, out[e, end]) if (e, end) in out else best
    return out


def _best(f: np.ndarray, turns: str, end: int, ways: dict) -> tuple[int, str]:
    least = min(ways.values())
    audits = ("D" * s + "K" + _trace(f, turns, end, i, r) if s >= 0 else _trace(f, turns, end, i, r)
              for (s, i, r), c in ways.items() if c == least)
    return least, min(audits)


_align_short = lru_cache(maxsize=50_000)(_align)


def align(turns: str) -> dict[tuple[int, int], tuple[int, str]]:
    return _align_short(turns) if len(turns) <= 12 else _align(turns)


# --- pieces --------------------------------------------------------------------------------

_WAY = pa.struct([("before", pa.int64()), ("after", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_PIECE = pa.struct([("ways", pa.list_(_WAY)), *((c, pa.int64()) for c in _COUNTS), ("low", pa.int64()), ("high", pa.int64()),
                    ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())])
PIECE_DDL = ("struct<ways: array<struct<before: long, after: long, cost: long, audit: string>>, "
             + ", ".join(f"{c}: long" for c in _COUNTS)
             + ", low: long, high: long, first: string, last: string, first_turn: long, last_turn: long>")
ORDER = ["conv_id", "turn", "role", "digest"]


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _summary(rows: list[tuple]) -> dict:
    """One piece, from its (turn, initial, fault, copies) rows in order."""
    letters, gaps = [], [0]
    counts = dict.fromkeys(_COUNTS, 0)
    last, seen = None, object()
    for turn, initial, fault, copies in rows:
        counts["rows"] += copies
        counts["illegal"] += (copies - 1) * illegal(initial, initial) + (last is not None and illegal(last, initial))
        counts["turns"] += turn is not None and turn != seen
        last, seen = initial, turn
        if fault == "blank":
            counts["blank"] += copies
        else:
            counts["duplicate"] += copies - (fault != "duplicate")
        if fault in ("blank", "duplicate"):
            gaps[-1] += copies
            continue
        counts["truncated"] += fault == "truncated"
        letter = initial if initial in ("s", "u", "a") else "x"
        letters.append(letter.upper() if fault == "truncated" else letter)
        gaps.append(copies - 1)
    forced = DELETE * sum(gaps)
    known = [t for t, *_ in rows if t is not None]
    ways = [{"before": e, "after": x, "cost": c + forced, "audit": _with_deletions(audit, gaps)}
            for (e, x), (c, audit) in align("".join(letters)).items()]
    return {"ways": ways, **counts, "low": min(known, default=None), "high": max(known, default=None), "first": rows[0][1],
            "last": last, "first_turn": rows[0][0], "last_turn": rows[-1][0]}


def _with_deletions(audit: str, gaps: list[int]) -> str:
    """The audit with the deletions of blank and repeated turns put in: right
    after the turn before them, which is the least place beside insertions."""
    out, at = ["D" * gaps[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            at += 1
            out.append("D" * gaps[at])
    return "".join(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Piece rows from a task's sorted turns: (conv_id, turn, role, digest,
    part, piece), the first turn's keys, so that pieces sort as their turns."""
    part, conv, rows, start = 0, None, [], None

    def done():
        return start, part, _summary(rows)

    for batch in batches:
        out = []
        for now, turn, role, digest, fault, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (now != conv or len(rows) == PIECE):
                out.append(done())
                part, rows = part + 1, []
            if not rows:
                conv, start = now, (now, turn, role, digest)
            rows.append((turn, role[:1], fault, copies))
        if out:
            yield _piece_batch(out)
    if rows:
        yield _piece_batch([done()])


def _piece_batch(found: list[tuple]) -> pa.RecordBatch:
    keys = list(zip(*[f[0] for f in found]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array([f[1] for f in found], pa.int64()),
         pa.array([f[2] for f in found], _PIECE)], names=[*ORDER, "part", "piece"])


# --- whole conversations -------------------------------------------------------------------

class _Way:
    """A cheapest way to a state: its cost, the way before and the last audit."""

    __slots__ = ("cost", "before", "audit")

    def __init__(self, cost: int, before: _Way | None, audit: str):
        self.cost, self.before, self.audit = cost, before, audit

    def audits(self, until: _Way | None = None) -> str:
        out, way = [], self
        while way is not until:
            out.append(way.audit)
            way = way.before
        return "".join(reversed(out))

    def least(self, other: _Way) -> _Way:
        """The cheaper way, or of equals the one with the lesser audit, read
        from where the two part."""
        if self.cost != other.cost:
            return min(self, other, key=lambda w: w.cost)
        a, b = self.before, other.before
        while a is not b:
            a, b = a.before, b.before
        return self if self.audits(a) <= other.audits(a) else other


def join_pieces(pieces: Iterator[dict]) -> dict:
    """The account of a conversation from its pieces in order."""
    now = {0: _Way(0, None, "")}
    total = dict.fromkeys(_COUNTS, 0)
    low = high = last = None
    last_turn = None
    for p in pieces:
        after: dict[int, _Way] = {}
        for way in p["ways"]:
            if way["before"] in now:
                start = now[way["before"]]
                made = _Way(start.cost + way["cost"], start, way["audit"])
                x = way["after"]
                after[x] = made.least(after[x]) if x in after else made
        now = after
        for c in _COUNTS:
            total[c] += p[c]
        if last is not None:
            total["illegal"] += illegal(last, p["first"])
            total["turns"] -= p["first_turn"] is not None and p["first_turn"] == last_turn
        last, last_turn = p["last"], p["last_turn"]
        if p["low"] is not None:
            low, high = p["low"] if low is None else low, p["high"]
    best = now[3].least(now[0]) if 3 in now and 0 in now else now.get(3, now.get(0))
    return {"gaps": 0 if low is None else high - low + 1 - total["turns"], "blank": total["blank"],
            "duplicate": total["duplicate"], "truncated": total["truncated"], "illegal": total["illegal"],
            "cost": best.cost, "audit": best.audits()}


REPAIRED = ("conv_id long, place long, role string, text string, gaps long, blank long, duplicate long, truncated long, "
            "illegal long, cost long, audit string")
_ACCOUNT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
#: characters of text that a task gathers before it gives rows on
OUT_CHARS = 4 << 20


class _Repairer:
    """Walks an audit beside the turns of one conversation."""

    def __init__(self, account: dict):
        self.audit, self.at, self.place = account["audit"], 0, 0
        self.opened = (len(self.audit) - self.audit.count("D")) % 2

    def _role(self) -> str:
        return "user" if (self.place - self.opened) % 2 == 0 else "assistant"

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = self._role()
            self.at += 1
            self.place += 1
            yield self.place, role, ""

    def turn(self, role: str, text: str):
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = role if edit == "K" else self._role()
            self.place += 1
            yield self.place, role, text


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its account (place 0), then the repaired turns. Rows
    (conv_id, kind, role, text, piece, ...) come as marker (kind 0), pieces (1)
    and turns (2) of each conversation."""
    conv, pieces, walk, started = None, [], None, False
    out: list[tuple] = []
    chars = 0

    def account():
        nonlocal walk
        found = join_pieces(pieces)
        walk = _Repairer(found)
        out.append((conv, 0, None, None, *(found[c] for c in _ACCOUNT)))

    def add(rows):
        nonlocal chars
        for place, role, text in rows:
            out.append((conv, place, role, text, *[None] * len(_ACCOUNT)))
            chars += len(text) + 64

    def finish():
        if walk is None:
            account()
        add(walk.inserts())

    for batch in batches:
        found = batch.column(4)
        for i, (now, kind, role, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
            if not started or now != conv:
                if started:
                    finish()
                conv, pieces, walk, started = now, [], None, True
            if kind == 1:
                pieces.append(found[i].as_py())
            elif kind == 2:
                if walk is None:
                    account()
                add(walk.turn(role, text))
            if chars > OUT_CHARS:
                yield _repaired_batch(out)
                out, chars = [], 0
        if len(out) > 1024:
            yield _repaired_batch(out)
            out, chars = [], 0
    if started:
        finish()
        if out:
            yield _repaired_batch(out)


def _repaired_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in REPAIRED.split(", ")]
    kinds = [pa.int64() if k == "long" else pa.string() for _, k in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[n for n, _ in fields])


def _typed(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault, copies): equal turns counted as one
    row, with the first copy's fault. ``turns`` has NULL-free role and text.

    Copies are combined on the map side, and the first of the turns with one
    role and text is a grouped minimum joined back, so no text repeated in a hot
    conversation gathers in a task. Texts themselves stay behind: a SHA-256
    stands for each."""
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    light = (turns.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"))
             .groupBy(*ORDER, "fault").agg(F.count(F.lit(1)).alias("copies")))
    first = (light.where("fault <> 'blank'")
             .groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"))
             .agg(F.min("turn").alias("_turn"), F.max(F.col("turn").isNull()).alias("_null")))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    earliest = F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_turn"))
    again = (F.col("fault") != "blank") & ~earliest
    return light.join(first, same, "left").select(
        *ORDER, F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"), "copies")


def repair(turns: DataFrame, every: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Accounts and repaired turns: per conversation a row with ``place`` 0 (gaps,
    faults, cost and audit), then its turns in ``place`` 1, 2, ..., next to each
    other in one partition.

    Turns go by number (NULL first), equal numbers by role, then by the SHA-256
    of the text; repeated rows are turns of their own. NULL role and text count
    as one space, so a NULL text is blank; NULL conversations are one. ``every``
    names conversations that are to have a row even without turns; they get
    zeros and an empty audit. No turns and no ``every``: no rows. Other columns
    don't matter.

    Alignment is split inside a conversation; the repaired turns of one leave in
    order through one task, which holds one batch of them, its audit and a short
    row per piece.
    """
    rows = _typed(turns, conv_id, turn, role, text)
    spark = turns.sparkSession
    with Store(spark) as store:
        found = store.put(faults(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(
            _pieces, f"conv_id long, turn long, role string, digest binary, part long, piece {PIECE_DDL}"), "pieces", keep=True)
    ids = rows if every is None else every.select(F.col(conv_id).cast("long").alias("conv_id"))
    marks = ids.select("conv_id").distinct().withColumn("kind", F.lit(0))
    parts = found.withColumn("kind", F.lit(1))
    said = rows.withColumn("kind", F.lit(2)).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return (said.unionByName(parts, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
            .select("conv_id", "kind", "role", "text", "piece", "turn", "digest", "part").repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest", "part").mapInArrow(_repair, REPAIRED))


def repaired_turns(turns: DataFrame, **names: str) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations alone."""
    return repair(turns, **names).where("place > 0").select("conv_id", "place", "role", "text")


# --- query -----------------------------------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """The turns with the faults that the CRC-32 of ``conv_id:turn`` names."""
    rows = _typed(turns, "conv_id", "turn", "role", "text")
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    what = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    copies = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1)
    return (rows.withColumn("what", what)
            .select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
            .drop("copy"))


DIGESTED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTED.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTED.split(", ")]
    now, state = None, None
    for batch in batches:
        done, accounts = [], zip(*(c.filter(pc.equal(batch.column(1), 0)).to_pylist() for c in [batch.column(0), *batch.columns[4:]]))
        for place, role, text in zip(*(c.to_pylist() for c in batch.columns[1:4])):
            if place == 0:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = next(accounts), hashlib.sha256()
            else:
                state.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, state.hexdigest()), kinds)], names=names)


def _sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII string; DuckDB has no function for it."""
    table = ("list_transform(range(256), lambda k: list_reduce(list_concat([k], range(8)), "
             "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")
    steps = f"list_concat([4294967295], list_transform(range(length({text})), lambda i: ascii({text}[i + 1])::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])), 4294967295)"


#: the grammar as an automaton, turn by turn: per conversation and state the
#: cheapest, then least audit; no alignment with targets
OP13_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, {_sql_crc32("k")} % 20 AS what FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
turns AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS letter,
         CASE WHEN said = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
ins(s, t, price, edits) AS (VALUES ('0', '0', 0, ''), ('0', 'u', 5, 'I'), ('0', 'a', 10, 'II'), ('s', 's', 0, ''), ('s', 'u', 5, 'I'),
  ('s', 'a', 10, 'II'), ('u', 'u', 0, ''), ('u', 'a', 5, 'I'), ('a', 'a', 0, ''), ('a', 'u', 5, 'I')),
go(s, t) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
edit AS (
  SELECT r.conv_id, r.i, g.s, g.t, CASE WHEN letter = g.t THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS price,
         CASE WHEN letter = g.t THEN 'K' ELSE 'R' END AS edits
  FROM turns r, go g WHERE fault NOT IN ('blank', 'duplicate') AND (letter = g.t OR g.t <> 's')
  UNION ALL SELECT conv_id, i, s, s, 2, 'D' FROM turns, (VALUES ('0'), ('s'), ('u'), ('a')) x(s)),
-- way: the cost in nine digits, then the audit, so that the least string is the way sought
best(conv_id, i, s, way) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0', '000000000' FROM turns
  UNION ALL
  SELECT b.conv_id, e.i, e.t, min(lpad(CAST(CAST(substr(b.way, 1, 9) AS BIGINT) + n.price + e.price AS VARCHAR), 9, '0')
                                  || substr(b.way, 10) || n.edits || e.edits)
  FROM best b JOIN ins n ON n.s = b.s JOIN edit e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.s = n.t
  GROUP BY b.conv_id, e.i, e.t),
chosen AS (
  SELECT b.conv_id, min(lpad(CAST(CAST(substr(b.way, 1, 9) AS BIGINT) + n.price AS VARCHAR), 9, '0') || substr(b.way, 10) || n.edits) AS way
  FROM best b JOIN ins n ON n.s = b.s AND n.t IN ('0', 'a')
  JOIN (SELECT conv_id, max(i) AS n FROM turns GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.n = b.i
  GROUP BY b.conv_id),
letters AS (
  SELECT conv_id, substr(way, 10) AS audit, unnest(range(1, length(way) - 8)) AS p FROM chosen),
steps AS (
  SELECT conv_id, p, substr(audit, p, 1) AS e, length(replace(substr(audit, 1, p), 'I', '')) AS i,
         length(replace(substr(audit, 1, p), 'D', '')) AS place, length(replace(audit, 'D', '')) % 2 AS opened FROM letters),
said AS (
  SELECT s.conv_id, s.place, CASE WHEN e = 'K' THEN r.role WHEN (s.place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS line
  FROM steps s LEFT JOIN turns r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE e <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS repaired FROM said GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(way, 1, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(way, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13(conversations: DataFrame) -> DataFrame:
    """Query op13: damaged conversations, their accounts and the digest of what
    the repair gives."""
    return repair(damage(conversations), every=conversations).mapInArrow(_digests, DIGESTED)
