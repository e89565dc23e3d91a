"""Which of a fixed list of keywords a text holds, in one pass over the text.

Dozens of substring searches read a text dozens of times. An Aho-Corasick
automaton reads it once whatever the number of keywords, and gives overlapping
hits too. Texts go to it in Arrow batches; only word numbers come back.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:  # equal words share a node
            a.add_word(w, (*a.get(w, ()), i))
    a.make_automaton()
    return a


def _found(words: tuple[str, ...], texts: pa.Array) -> pa.Array:
    always = [i for i, w in enumerate(words) if not w]
    if len(always) == len(words):
        return pa.array([always if t is not None else None for t in texts.to_pylist()], pa.list_(pa.int32()))
    a = _automaton(words)
    out = []
    for t in texts.to_pylist():
        hit = set(always)
        for _, same in a.iter(t or ""):
            hit.update(same)
        out.append(sorted(hit))
    return pa.array(out, pa.list_(pa.int32()))


def found_words(text: Column, words: list[str]) -> Column:
    """The sorted places in ``words`` of those that ``text`` contains (an
    ``array<int>``; a NULL text holds none, every text holds an empty word)."""
    fixed = tuple(words)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _found(fixed, texts)

    return run(text)
