"""Vector and shingle joins against all pairs, and the pipeline."""
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from starlayer.llm import jaccard, vecdedup
from starlayer.llm.common import Store, components
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 290)]
    links += [(300, 300 + i) for i in range(1, 50)] + [(500, 500)]
    with Store(spark) as store:
        got = {r.node: r.component for r in components(store, spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    with Store(spark) as store:
        assert components(store, spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors -------------------------------------------------------------------------------

def brute_vectors(rows, threshold=0.93):
    ok = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] >= threshold]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = closure(range(len(rows)), links)
    first = defaultdict(list)
    for k, c in comp.items():
        first[c].append(rows[k][0])
    least = {c: min((x for x in v if x is not None), default=None) for c, v in first.items()}
    return sorted((rows[k][0] is not None, rows[k][0] or 0, n[k], least[comp[k]]) for k in range(len(rows)))


def got_vectors(frame):
    return sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id) for r in vecdedup.near_vectors(frame).collect())


def test_vectors_of_the_table(spark):
    frame = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert got_vectors(frame) == brute_vectors(rows)


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200] * 3, 0), (2, [2e200] * 3, 0), (3, [1e-200] * 3, 0), (4, [1e-310, 1e-310, -1e-310], 0),
            (5, [1.7e308, 1.7e308, -1.7e308], 0), (6, [5e-324, 0.0, 0.0], 0), (7, [3.0, 1e-300, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.n_links, r.component_id) for r in vecdedup.near_vectors(frame).orderBy("vec_id").collect()] == [
        (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6)]


@pytest.mark.parametrize("dim", [3, 24])
def test_vectors_odd_rows(spark, dim, monkeypatch):
    monkeypatch.setattr(vecdedup, "CELL", 7)  # cells are compared in pairs of parts
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((6, dim))
    rows = [(i, (centres[i % 6] + 0.12 * rng.standard_normal(dim)).tolist(), (i % 6) % 2) for i in range(90)]
    rows += [(100 + i, rows[4][1], rows[4][2]) for i in range(20)]  # copies
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * dim, 1), (203, [None] + [1.0] * (dim - 1), 1), (204, rows[0][1], None),
             (205, [float("nan")] + [1.0] * (dim - 1), 1), (206, [float("inf")] + [1.0] * (dim - 1), 1),
             (None, rows[0][1], rows[0][2]), (207, rows[0][1] + [0.0], rows[0][2]), (208, [2 * x for x in rows[0][1]], rows[0][2])]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, cid int")
    assert got_vectors(frame) == brute_vectors(rows)
    assert vecdedup.near_vectors(frame.limit(0)).count() == 0


def test_grid_finds_every_close_pair():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 32))
    x[200:] = x[:200] + 0.25 * rng.standard_normal((200, 32))
    r = vecdedup.rotate(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))):
        assert any(((r[a, c] - r[b, c]) ** 2).sum() <= s + vecdedup.SLACK for c, s in vecdedup.blocks(32, 0.93))


# --- shingles --------------------------------------------------------------------------------

def shingle_set(text, width):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = WORD.findall(lower)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[k:] for k in range(width))))


def brute_jaccard(rows, percent, width):
    sets = [shingle_set(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
             if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = closure(range(len(rows)), links)
    least = defaultdict(list)
    for k, c in comp.items():
        least[c].append(rows[k][0])
    return sorted((r[0] is not None, r[0] or 0, len(sets[k]), min((x for x in least[comp[k]] if x is not None), default=None))
                  for k, r in enumerate(rows))


def got_jaccard(frame, percent, width):
    out = jaccard.jaccard_components(frame, percent, width).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in out)


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5)])
def test_jaccard_of_the_table(spark, docs, percent, width):
    assert got_jaccard(docs, percent, width) == brute_jaccard([(r.doc_id, r.text) for r in docs.collect()], percent, width)


def near_copies(n=160, seed=4):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for k in range(n):
        base = [f"b{k % 5}x{i}" for i in range(int(rng.integers(30, 90)) if k % 5 else 70)]
        if k % 5 == 0:
            base = [f"c{i}" for i in range(70)]
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(0, len(base)))] = f"e{rng.integers(0, 9)}"
        out.append((k, " ".join(passage * int(k % 3 == 0) + base)))
    return out


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5), (50, 2), (100, 3)])
def test_jaccard_near_copies(spark, monkeypatch, percent, width):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_jaccard(frame, percent, width) == brute_jaccard(rows, percent, width)
    monkeypatch.setattr(jaccard, "PART", 900)  # families are searched in pairs of parts
    monkeypatch.setattr(jaccard, "BROADCAST_MEMBERS", 0)
    assert got_jaccard(frame, percent, width) == brute_jaccard(rows, percent, width)


def test_jaccard_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got_jaccard(odd, 90, 3) == brute_jaccard(rows, 90, 3)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(odd, percent=90, width=3)
    assert kept.columns == odd.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12]  # 7 and 8 are copies of 6, 9 stands twice
    assert jaccard.keep_one(none).count() == 0


def test_keep_one_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b),      # b has no copy, though its id stands on a copy of 1
            (3, c), (3, c), (3, "x y"),  # two texts of one id, one of them twice
            (4, c), (3, " "), (3, None), (None, c)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(
        [(1, a), (2, b), (3, c), (3, "x y"), (3, " "), (3, None), (None, c)], key=key)


def test_search_equals_counting():
    rng = np.random.default_rng(8)
    for trial in range(30):
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        members = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(60, 80)), replace=False),
                                             rng.integers(0, 1 << 60, int(rng.integers(0, 6))).astype(np.uint64)]))
                   for _ in range(40 if trial else 400)]
        members.sort(key=len)
        index = jaccard.Index(members)
        for q in range(0, len(members), 7):
            for percent in (70, 80, 90):
                want = [k for k, m in enumerate(members)
                        if 100 * len(np.intersect1d(m, members[q])) >= percent * len(np.union1d(m, members[q]))]
                assert index.search(members[q], percent, np.zeros(len(members), dtype=bool)) == want


def test_merge_skip():
    lists = [[1, 4, 9], [1, 9], [2, 9, 11], [9, 11], [1, 11]]
    assert jaccard.merge_skip(lists, 3) == [(1, 3), (9, 4), (11, 3)]
    assert jaccard.merge_skip(lists, 1) == [(1, 3), (2, 1), (4, 1), (9, 4), (11, 3)]
    assert jaccard.merge_skip([], 1) == []


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline(spark, docs):
    with Store(spark) as store:
        now, seen = docs, {}
        for name, stage in corpus_pipeline.STAGES:
            out = store.put(stage(spark, now, SF), name)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
            now = out
        before = [(r.doc_id, r.text) for r in store.spark.read.parquet(store.paths[1]).collect()]
    stay = {(x[1], x[3]) for x in brute_jaccard(before, 80, 5)}
    assert seen["ngram_jaccard_join"] == {i for i, c in stay if i == c}
    assert seen["best_fit_pack"] == seen["source_mix"] <= seen["ngram_jaccard_join"] < seen["language_id"]
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.collect()} == seen["best_fit_pack"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_no_rows(spark, odd, none, stage):
    name, f = corpus_pipeline.STAGES[stage]
    for frame in (odd, none):
        out = f(spark, frame, SF)
        assert out.count() >= 0 and (stage == 4 or out.columns == frame.columns)
    assert f(spark, none, SF).count() == 0
