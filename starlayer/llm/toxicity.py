"""Toxicity scores: gradient-boosted trees over dense text features, calibrated
by isotonic regression.

The lexicon is learnt from labelled texts (words and word beginnings that mark
toxic ones) beside a small fixed list. Features are densities of lexicon hits,
their nearness to the second person, capitals, punctuation and obfuscated
spellings. Lexicon, trees and calibration are fitted on a bounded, documented
sample of labelled rows; scoring covers whole texts of all rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlayer.llm.common import Memo, Store, held, id_share, slices

# Plain insults that count even where no label names them.
SEED = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown"
                 " imbecile cretin filth vermin degenerate bastard".split())
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te toi vous votre vos du dich dir dein deine ihr euch"
                          " usted ustedes ti tus vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
EDGE = ".,;:!?\"'()[]{}<>«»“”„’‘…-–—*_~"
SYMBOL = re.compile(r"[#*$%&|<>@_~^+=\\]")
STRETCH = re.compile(r"(.)\1{2,}")
STEM = 5
NEAR = 5
FEATURES = ("log_words", "hits", "hit_density", "weight", "weight_density", "top_weight", "stems", "stem_density",
            "obfuscated", "obfuscated_density", "near_second", "second_density", "upper_share", "caps_density",
            "exclaim_density", "question_density", "symbol_density")
# columns of a token's row in the memo
HIT, WEIGHT, STEMMED, HIDDEN, SECOND, UPPER, LETTERS, CAPS, EXCLAIM, QUESTION, SIGNS = range(11)


class Featurizer:
    """Feature row of a text under a lexicon; distinct tokens are analysed once."""

    def __init__(self, lexicon: dict):
        self.words: dict[str, float] = {w: 2.0 for w in SEED} | lexicon["words"]
        self.stems: dict[str, float] = lexicon["stems"]
        self.memo = Memo(self._token, 11, most=250_000)

    def _token(self, token: str) -> np.ndarray:
        row = np.zeros(11, dtype=np.float32)
        core = token.strip(EDGE).lower()
        weight = self.words.get(core)
        if weight is not None:
            row[HIT], row[WEIGHT] = 1, weight
        elif len(core) > STEM and core[:STEM] in self.stems:
            row[STEMMED], row[WEIGHT] = 1, self.stems[core[:STEM]]
        else:
            plain = _plain(token)
            if plain != core and plain in self.words:
                row[HIDDEN], row[WEIGHT] = 1, self.words[plain]
        row[SECOND] = core in SECOND_PERSON
        row[UPPER] = sum(map(str.isupper, token)) if not token.islower() else 0
        row[LETTERS] = len(token) if token.isalpha() else sum(map(str.isalpha, token))
        row[CAPS] = row[LETTERS] >= 3 and token.isupper()
        row[EXCLAIM], row[QUESTION] = token.count("!"), token.count("?")
        row[SIGNS] = len(SYMBOL.findall(token))
        return row

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.split() if text else []
        n = len(tokens)
        if not n:
            return np.zeros(len(FEATURES), dtype=np.float32)
        rows = self.memo.of(tokens)
        s = rows.sum(axis=0, dtype=np.float64)
        hits = s[HIT] + s[HIDDEN]
        near = 0.0
        if hits and s[SECOND]:
            at = np.flatnonzero(rows[:, HIT] + rows[:, HIDDEN])
            you = np.flatnonzero(rows[:, SECOND])
            i = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(i, len(you) - 1)]), np.abs(at - you[np.maximum(i - 1, 0)]))
            near = float((gap <= NEAR).sum()) / hits
        return np.array([np.log1p(n), hits, hits / n, s[WEIGHT], s[WEIGHT] / n, rows[:, WEIGHT].max(), s[STEMMED],
                         s[STEMMED] / n, s[HIDDEN], s[HIDDEN] / n, near, s[SECOND] / n, s[UPPER] / max(s[LETTERS], 1),
                         s[CAPS] / n, s[EXCLAIM] / n, s[QUESTION] / n, s[SIGNS] / n], dtype=np.float32)


def _plain(token: str) -> str:
    """The letters behind an obfuscated spelling: digits and signs read as the
    letters they resemble, separators dropped, stretched letters single."""
    read = token.strip(",.;:?\"'()[]").lower().translate(LEET)
    return STRETCH.sub(r"\1", "".join(c for c in read if c.isalpha()))


# --- lexicon ------------------------------------------------------------------

def learn_lexicon(sample: DataFrame, min_docs: int = 3, min_weight: float = 1.5) -> list[dict]:
    """Lexicons of fold 0, fold 1 and both, from (text, toxic, fold) rows.

    A word's weight is its shrunk log-odds of standing in a toxic text; all of
    ``min_weight`` with ``min_docs`` toxic texts enter. Counting is per document
    and combined by Spark; only the entries reach the driver, no more than the
    bounded sample holds."""
    def terms(batches):
        counted: dict[tuple, Counter] = {}
        for batch in slices(batches):
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                words = {t.strip(EDGE).lower() for t in set((text or "").split())}
                c = counted.setdefault((toxic, fold), Counter())
                c.update("w" + w for w in words if w.isalpha())
                c.update({"s" + w[:STEM] for w in words if len(w) > STEM and w.isalpha()})
        for (toxic, fold), c in counted.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array([fold] * len(c), pa.int32()),
                 pa.array(list(c.values()), pa.int64())], names=["term", "toxic", "fold", "k"])

    cell = [F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("k")).otherwise(0)).alias(f"k{t}{f}")
            for t in (0, 1) for f in (0, 1)]
    counts = (sample.select("text", "toxic", "fold").mapInArrow(terms, "term string, toxic int, fold int, k long")
              .groupBy("term").agg(*cell))
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    seen = F.col("k10") + F.col("k11")
    bad, good = max(sum(sizes.get((1, f), 0) for f in (0, 1)), 1), max(sum(sizes.get((0, f), 0) for f in (0, 1)), 1)
    odds = F.log((seen + 0.5) / bad) - F.log((F.col("k00") + F.col("k01") + 1.0) / good)
    rows = counts.where(seen >= min_docs).withColumn("odds", odds).where(F.col("odds") > min_weight * 0.5).collect()
    out = []
    for folds in ((0,), (1,), (0, 1)):
        bad, good = (max(sum(sizes.get((t, f), 0) for f in folds), 1) for t in (1, 0))
        found: dict[str, dict[str, float]] = {"w": {}, "s": {}}
        for r in rows:
            b, g = (sum(r[f"k{t}{f}"] for f in folds) for t in (1, 0))
            # half a text more among the clean, scaled to the classes' sizes
            weight = float(np.log((b + 0.5) / bad) - np.log((g + 1.0) / good))
            if b >= max(2, min_docs * len(folds) // 2) and weight >= min_weight:
                found[r["term"][0]][r["term"][1:]] = weight
        out.append({"words": found["w"], "stems": found["s"]})
    return out


# --- trees and calibration ----------------------------------------------------------

def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32,
              l2: float = 1.0) -> dict:
    """Boosted depth-wise trees on the log loss, split on quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    f = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = [], []
        for level in range(depth):
            n = 1 << level
            best = np.full(n, 1e-6)
            chosen, place = np.zeros(n, dtype=np.int64), np.full(n, bins, dtype=np.int64)
            for j in range(x.shape[1]):
                key = node * bins + binned[:, j]
                g = np.bincount(key, grad, n * bins).reshape(n, bins).cumsum(axis=1)
                h = np.bincount(key, hess, n * bins).reshape(n, bins).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (total_g - g)**2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
                k = gain.argmax(axis=1)
                better = gain[np.arange(n), k] > best
                best[better], chosen[better], place[better] = gain[np.arange(n), k][better], j, k[better]
            feature.append(chosen)
            cut.append(np.array([cuts[j][k] if k < len(cuts[j]) else np.inf for j, k in zip(chosen, place)]))
            node = 2 * node + (x[np.arange(len(y)), chosen[node]] > cut[-1][node])
        leaves = np.bincount(node, grad, 1 << depth) / (np.bincount(node, hess, 1 << depth) + l2) * rate
        f += leaves[node]
        trees.append((feature, cut, leaves))
    return {"base": base, "trees": trees}


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, leaves in model["trees"]:
        node = np.zeros(len(x), dtype=np.int64)
        for chosen, at in zip(feature, cut):
            node = 2 * node + (x[rows, chosen[node]] > at[node])
        f += leaves[node]
    return f


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (mean raw score, mean label) of each pool, read
    by linear interpolation. Equal raw scores are pooled first."""
    values, inverse = np.unique(raw, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    pools: list[list[float]] = []
    for v, m, w in zip(values, mean, weight):
        pools.append([v, m, w])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            w = a[2] + b[2]
            pools.append([(a[0] * a[2] + b[0] * b[2]) / w, (a[1] * a[2] + b[1] * b[2]) / w, w])
    # a pool of few rows is no proof of 0 or 1
    return np.array([p[0] for p in pools]), np.array([(p[1] * p[2] + 0.05) / (p[2] + 0.1) for p in pools])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, seed: int = 5) -> DataFrame:
    """(text, toxic, fold, calibrate): about ``most`` labelled texts, drawn by a
    hash of the id. Labels are counted over all rows; only the drawn ids
    (bounded by ``most``) are broadcast. Several labels of one id: the largest."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(id_share("doc_id", 5) != 0)
    n = max(marks.count(), 1)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    drawn = marks.where(draw < F.lit(int(min(1.0, most / n) * (1 << 30))))
    turn = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(10))
    return (docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
            .select("text", F.col("toxic").cast("int").alias("toxic"), (turn % 2).cast("int").alias("fold"),
                    (turn >= 8).alias("calibrate")))


def fit(docs: DataFrame, labels: DataFrame, most: int = 24_000) -> dict | None:
    """Lexicon, trees and calibration from at most about ``most`` labelled rows
    outside the held-out fold; None without labels of both kinds.

    Features for the trees are out of fold: a text is described by the lexicon
    learnt from the other half, so the trees don't trust memorised words."""
    with Store(docs.sparkSession) as store:
        sample = store.put(labelled_sample(docs, labels, most), "labelled")
        lexicons = learn_lexicon(sample)

        def describe(batches):
            by_fold = [Featurizer(lexicons[1]), Featurizer(lexicons[0])]
            for batch in slices(batches):
                rows = [by_fold[f](t).tolist() for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(3), pa.array(rows, pa.list_(pa.float32()))], names=["y", "calibrate", "x"])

        rows = sample.mapInArrow(describe, "y int, calibrate boolean, x array<float>").toPandas()
    if rows.empty or rows.y.nunique() < 2:
        return None
    x, y, last = np.stack(rows.x.to_numpy()).astype(float), rows.y.to_numpy(dtype=float), rows.calibrate.to_numpy(dtype=bool)
    if min(y[last].sum(), (1 - y[last]).sum()) < 10:  # too few rows to set some aside
        last = np.ones(len(y), dtype=bool)
        trees = fit_trees(x, y)
    else:
        trees = fit_trees(x[~last], y[~last])
    return {"lexicon": lexicons[2], "trees": trees, "isotonic": fit_isotonic(raw_scores(trees, x[last]), y[last])}


# --- scoring ----------------------------------------------------------------------------

def _scores(shared, texts: list) -> np.ndarray:
    model = shared.value["model"]
    if model is None:
        return np.zeros(len(texts))
    describe = held(("toxicity", shared.value["id"]), lambda: Featurizer(model["lexicon"]))
    x = np.stack([describe(t) for t in texts])
    return np.interp(raw_scores(model["trees"], x), *model["isotonic"])


def _share(spark: SparkSession, model: dict | None):
    return spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "model": model})  # bounded by fit()'s parameters


def score(docs: DataFrame, model: dict | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``; ``predicted`` is 1 from a
    score of 0.5. NULL and empty texts get the score of a text without any
    feature; without a model every score is 0. Repeated rows agree."""
    shared = _share(docs.sparkSession, model)

    def run(batches):
        for batch in slices(batches):
            s = _scores(shared, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict | None, text: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, scoring below ``below``."""
    shared = _share(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(shared, batch.column(at).to_pylist()) < below))

    return docs.mapInArrow(run, docs.schema)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op8: learns outside fold 0 of 5, scores all rows."""
    out = score(docs, fit(docs, labels))
    held = F.coalesce(id_share("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
