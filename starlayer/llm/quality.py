"""Line-first quality rules: judge every line, drop the lines that fail, then
reject the documents that lose too much of their text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlayer.llm.common import slices, small_batches

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: phrases of pages' furniture, looked for in the lower-cased line
BOILERPLATE = re.compile(
    rb"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|subscribe to our|sign up for"
    rb"|click here|enable javascript|javascript is disabled|lorem ipsum|licensed under|copyright \(c\)|\xc2\xa9 ?\d{4}"
    rb"|share on (?:facebook|twitter)|log ?in to (?:comment|continue)|skip to (?:main )?content")
NAVIGATION = frozenset(
    b"home about contact login logout register menu search next previous prev back top sitemap faq help account cart"
    b" archive archives categories tags share print rss blog news shop".split())
LINE_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"]", b",", b"\xe2\x80\x9d", b"\xe2\x80\x99", b"\xe2\x80\xa6",
            b"\xc2\xbb", b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xd8\x9f", b"\xe0\xa5\xa4")


def line_rule(line: bytes, words: list[bytes]) -> str | None:
    """Name of the first rule that a line with words fails, or None.

    * punctuation: symbols make up over a tenth of its characters, every third
      word or more ends in ``!``, or it is a fragment of up to two words
      without an end mark;
    * navigation: three or more ``|`` or ``>`` separators at a rate of one per
      four words, or a short line of menu words;
    * boilerplate: holds a furniture phrase.
    """
    solid = sum(map(len, words))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    bars = line.count(b"|") + line.count(b" > ")
    if bars >= 3 and 4 * bars >= len(words):
        return "navigation"
    if len(words) <= 8 and 2 * sum(w.strip(b".,|>").lower() in NAVIGATION for w in words) > len(words):
        return "navigation"
    if 10 * symbols > solid:
        return "punctuation"
    if len(words) >= 4 and 3 * sum(w.endswith(b"!") for w in words) >= len(words):
        return "punctuation"
    if len(words) <= 2 and not line.rstrip().endswith(LINE_END):
        return "punctuation"
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more, the first
    occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int64, count=n)
    pair = ids[:-1] * len(code) + ids[1:]
    if len(code) > 2_000_000:  # three factors would leave 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = pair[:-1] * len(code) + ids[2:]
    else:
        window = pair[:-1] * len(code) + ids[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[hit + shift] = True
    return int(covered.sum())


def judge(text: bytes | None, min_words: int = 50, max_loss: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, cleaned text, share of the text's solid bytes lost)."""
    text = text or b""
    lines = text.split(b"\n")
    words: list[bytes] = []
    seen: set[bytes] = set()
    duplicates = solid = lost = 0
    clean = []
    for line in lines:
        own = line.split()
        if not own:
            continue
        words += own
        size = sum(map(len, own))
        solid += size
        again = line in seen
        duplicates += again
        seen.add(line)
        if again or line_rule(line, own):
            lost += size
        else:
            clean.append(line)
    joined = b"".join(words)
    # UTF-8 continuation bytes are no code points of their own
    continuation = len(joined) - len(joined.translate(None, _CONTINUATION))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    repeat = repeated_words(words)
    failed = len(words) < min_words or 100 * repeat > 50 * len(words)
    share = lost / solid if solid else 1.0
    kept = not failed and share <= max_loss
    return len(words), len(joined) - continuation, symbols, duplicates, repeat, failed, kept, b"\n".join(clean), share


_CONTINUATION = bytes(range(0x80, 0xC0))

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, lost_share double")


def clean_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50,
                max_loss: float = 0.5, with_text: bool = False) -> DataFrame:
    """One row per document: the counts, the verdict and (``with_text``) the
    text that is left as ``clean_text``.

    A NULL or empty text has no words and fails; a repeated line loses all but
    its first copy; ties and repeated rows are judged alone, so they agree.
    """
    schema = SCHEMA + (", clean_text string" if with_text else "")
    types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string(), pa.float64()]
    order = [0, 1, 2, 3, 4, 5, 6, 8] + ([7] if with_text else [])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in slices(batches):
            found = [judge(t, min_words, max_loss) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k].decode() if k == 7 else x[k] for x in found], types[k]) for k in order)],
                names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def op2(docs: DataFrame) -> DataFrame:
    return clean_lines(docs)
