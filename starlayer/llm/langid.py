"""Language identification by word-first backoff.

A text's score per language is the sum, over its words, of log frequencies: a
word seen in training scores by its own frequency in each language; an unseen
word falls back to its longest character n-grams that training knows, then to
shorter ones, down to single letters.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlayer.llm.common import Memo, Store, held, id_share, slices

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: longest n-gram of the backoff
ORDER = 4
#: words of evidence at which a score stops growing surer (a mixed long text is
#: not reported as certain)
EVIDENCE = 30.0


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                    per_language: int = 3000, seed: int = 11) -> DataFrame:
    """About ``per_language`` whole texts of each language, chosen by a hash of
    the id. Languages are counted over all rows first; the share kept is that
    bound over the count, so no sort or window sees a language's rows."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
    for lang, counted in words.items():
        out = {0: counted}
        for n in range(1, ORDER + 1):
            out[n] = c = Counter()
            for w, k in counted.items():
                for g in grams(w, n):
                    c[g] += k
        for n, c in out.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(c), pa.string()), pa.array([n] * len(c), pa.int32()), pa.array(list(c), pa.string()),
                 pa.array(list(c.values()), pa.int64())], names=["lang", "n", "gram", "k"])


def fit(docs: DataFrame, per_language: int = 3000, min_count: int = 2) -> dict:
    """Word (n = 0) and n-gram frequencies per language from a bounded sample.

    Every entry seen at least ``min_count`` times in the sample enters, however
    many languages there are; what reaches the driver and every executor is
    bounded by the sample (``per_language``) alone. All grams of an order are
    kept as one string, which takes less memory than many, and a matrix."""
    counts = (training_sample(docs, per_language=per_language)
              .mapInArrow(_count_grams, "lang string, n int, gram string, k long")
              .groupBy("n", "gram", "lang").agg(F.sum("k").alias("k")))
    orders = {}
    with Store(docs.sparkSession) as store:
        counts = store.put(counts, "grams")
        langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        if not langs:
            return {"langs": [], "orders": {n: ("", np.zeros((0, 0), dtype=np.float32)) for n in range(ORDER + 1)}}
        by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("k"))), F.lit(0)) for x in langs]
        entries = counts.groupBy("n", "gram").agg(F.sum("k").alias("total"), F.array(*by_lang).alias("by"))
        for n in range(ORDER + 1):
            kept = entries.where((F.col("n") == n) & (F.col("total") >= min_count)).select("gram", "by").toArrow()
            by = kept.column("by").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            orders[n] = "\n".join(kept.column("gram").to_pylist()), _log_frequencies(by.reshape(kept.num_rows, len(langs)))
    return {"langs": langs, "orders": orders}


def _log_frequencies(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """A row of log frequencies per language for each gram."""
    total = counts.sum(axis=0) + smooth * max(len(counts), 1)
    return np.log((counts + smooth) / total).astype(np.float32)


class Predictor:
    """Scores texts with a fitted model; holds a bounded memo of words."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.row: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        for n, table in model["orders"].items():
            names, logs = (list(table), np.array(list(table.values()))) if isinstance(table, dict) else (table[0].split("\n"), table[1])
            self.row[n], self.logs[n] = {g: i for i, g in enumerate(names)} if len(logs) else {}, logs
        self.memo = Memo(self._word, max(len(self.langs), 1), most=250_000)

    def _word(self, word: str) -> np.ndarray:
        known = self.row[0].get(word)
        if known is not None:
            return self.logs[0][known]
        for n in range(ORDER, 0, -1):
            row = self.row[n]
            found = [row[g] for g in grams(word, n) if g in row]
            if found:
                return self.logs[n][found].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        logs = self.memo.of(words).sum(axis=0, dtype=np.float64) * min(1.0, EVIDENCE / len(words))
        best = int(np.argmax(logs))  # ties: the first name
        return self.langs[best], 1.0 / float(np.exp(logs - logs[best]).sum())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predictor(shared) -> Predictor:
    return held(("langid", shared.value["id"]), lambda: Predictor(shared.value["model"]))


def _share(spark: SparkSession, model: dict):
    return spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "model": model})


def predict_text(predictor: Predictor, text: str | None) -> tuple[str, float]:
    return predictor(text) if has_letter(text) else (UNDETERMINED, 0.0)


def identify(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``.

    ``lang_pred`` is a learned language, ``und`` (score 0) where the text is
    NULL or has no letter; ``score`` is its posterior over the learned
    languages. Equal scores go to the first name in code-point order; repeated
    rows give repeated results; without learned languages all is ``und``.
    """
    shared = _share(docs.sparkSession, model)

    def score(batches):
        p = _predictor(shared)
        for batch in slices(batches):
            found = [predict_text(p, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, text: str = "text", min_score: float = 0.0,
                    langs: set[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is
    determined, if wanted with at least ``min_score`` and as one of ``langs``."""
    shared = _share(docs.sparkSession, model)
    at = docs.columns.index(text)

    def keep(batches):
        p = _predictor(shared)
        for batch in slices(batches):
            found = [predict_text(p, t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x[0] != UNDETERMINED and x[1] >= min_score and (langs is None or x[0] in langs)
                                         for x in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Query op1: learns from the folds other than 1 of 3, predicts all rows."""
    fold = id_share("doc_id", 3)
    model = fit(docs.where(fold != 1))
    held = F.coalesce(id_share("doc_id", 3) == 1, F.lit(False))
    out = identify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
