"""Fill-in-middle transformation with a sparse index of multibyte characters.

Texts are cut on lines or code points, while the work is done on UTF-8 bytes. An
index of a buffer holds only its multibyte characters, their places and running
excess bytes; ``searchsorted`` turns code points into bytes and back, and spans
of ASCII need no entry at all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import give_back, small_batches

#: fixed values: the marks before prefix, suffix and middle
PRE, SUF, MID = "<P>", "<S>", "<M>"
#: bytes of text that are indexed at once
SLAB = 8 << 20
FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
DIGEST = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class SparseIndex:
    """Places of the multibyte characters of a UTF-8 buffer.

    ``at`` are the bytes at which they start, ``chars`` the same as code points,
    ``excess[k]`` the bytes above one a character among the first k of them."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(more)])
        self.chars = self.at - self.excess[:-1]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before the bytes ``places``, which start characters."""
        return places - self.excess[np.searchsorted(self.at, places)]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        return places + self.excess[np.searchsorted(self.chars, places)]


class Units:
    """The units (lines or code points) of the texts of one buffer; text i is
    ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str):
        self.index, self.unit, self.lo, self.hi = SparseIndex(data), unit, bounds[:-1], bounds[1:]
        self.char_lo = self.index.to_chars(self.lo)
        if unit == "char":
            self.n = self.index.to_chars(self.hi) - self.char_lo
            return
        self.breaks = np.flatnonzero(data == 10)
        self.first = np.searchsorted(self.breaks, self.lo)
        self.closed = np.searchsorted(self.breaks, self.hi) - self.first
        last = data[np.maximum(self.hi - 1, 0)] if len(data) else np.zeros(len(self.hi), dtype=np.uint8)
        self.n = self.closed + ((self.hi > self.lo) & (last != 10))

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The byte after the first ``k`` units of each text."""
        if self.unit == "char":
            return self.index.to_bytes(self.char_lo + k)
        end = np.where(k > self.closed, self.hi, self.lo)
        inside = (k > 0) & (k <= self.closed)
        end[inside] = self.breaks[(self.first + k - 1)[inside]] + 1
        return end

    def chars(self, places: np.ndarray) -> np.ndarray:
        return self.index.to_chars(places)


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers per id, from the SHA-256 of ``seed:id``."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").astype(np.int64).reshape(-1, 4)


def _slabs(batches, column: int):
    """Batches cut to about SLAB bytes of text; a longer text stands alone."""
    for k, batch in enumerate(batches):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        lo, done = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, done + SLAB, side="right")))
            yield batch.slice(lo, hi - lo)
            lo, done = hi, int(size[hi - 1])
        if k % 4 == 3:
            give_back()


def assemble(ids: list, texts: pa.Array, seed: int, rate: int, spm: int, unit: str) -> tuple:
    """Units, forms, cuts and outputs of a slab of texts without NULLs."""
    body = texts.cast(pa.large_binary())
    bounds = np.frombuffer(body.buffers()[1], dtype=np.int64)[body.offset:body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2] or b"", dtype=np.uint8)[:bounds[-1]]
    units = Units(data, bounds, unit)
    h = draws(ids, seed)
    marked = np.zeros(len(ids), dtype=bool)
    for mark in (PRE, SUF, MID):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (units.hi == units.lo) | marked | (h[:, 2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    one, two = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
    a, b = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
    at_a, at_b = units.chars(a), units.chars(b)
    view, out = memoryview(data), []
    pre, suf, mid = PRE.encode(), SUF.encode(), MID.encode()
    for f, lo, x, y, hi in zip(form, units.lo.tolist(), a.tolist(), b.tolist(), units.hi.tolist()):
        if f == "plain":
            out.append(bytes(view[lo:hi]))
        elif f == "psm":
            out.append(b"".join((pre, view[lo:x], suf, view[y:hi], mid, view[x:y])))
        else:
            out.append(b"".join((suf, view[y:hi], pre, view[lo:x], mid, view[x:y])))
    return units.n, form, plain, at_a - units.char_lo, at_b - at_a, out


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50,
              unit: str = "line") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs``.

    ``rate`` percent of the texts are transformed, ``spm`` percent of those with
    the suffix first; ``unit`` is ``line`` or ``char``. All is decided by a hash
    of the id alone: repeated rows give repeated results, and rows of one id the
    same draws; a NULL id draws as an empty one. A NULL text is empty; empty
    texts and texts that hold a mark stay plain, with NULL lengths; other columns
    don't matter; an empty table gives no rows. A narrow map over whole texts."""
    if unit not in ("line", "char"):
        raise ValueError(f"unit must be 'line' or 'char', not {unit!r}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for batch in _slabs(batches, 1):
            ids = batch.column(0)
            n, form, plain, prefix, middle, out = assemble(ids.to_pylist(), batch.column(1), seed, rate, spm, unit)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain),
                 pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                names=[x.split()[0] for x in FORMED.split(", ")])

    return rows.mapInArrow(run, FORMED)


def restore(output: bytes, form: str) -> bytes:
    """The text, from its transformed form alone. No text that holds a mark is
    transformed, and marks can't arise where a text meets one, so the first of
    each kind is the one that was set."""
    pre, suf, mid = PRE.encode(), SUF.encode(), MID.encode()
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output[len(pre):].partition(suf)
        suffix, _, middle = rest.partition(mid)
    else:
        suffix, _, rest = output[len(suf):].partition(pre)
        prefix, _, middle = rest.partition(mid)
    return b"".join((prefix, middle, suffix))


def read_back(formed: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts restored from them."""

    def run(batches):
        for batch in _slabs(batches, 5):
            outs = batch.column(5).cast(pa.binary()).to_pylist()
            back = [restore(o, f) for o, f in zip(outs, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (outs, back))],
                names=[x.split()[0] for x in DIGEST.split(", ")])

    return formed.mapInArrow(run, DIGEST)


def op12(docs: DataFrame) -> DataFrame:
    """Query op12: lines, seed 7, every text, half with the suffix first."""
    return read_back(transform(docs))


def _word(k: int) -> str:
    return f"CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"


OP12_SQL = rf"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS body,
                  regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                  {_word(0)} AS h1, {_word(1)} AS h2, {_word(2)} AS h3, {_word(3)} AS h4 FROM documents),
c AS (SELECT doc_id, body, lines, CAST(len(lines) AS BIGINT) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
             greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100
                  THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, body, n, form, coalesce(array_to_string(lines[1:a], ''), '') AS prefix,
             coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
