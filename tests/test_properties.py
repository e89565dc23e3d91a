"""Property tests: operators against brute-force Python on random small frames."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starlayer.operators import dims, hierarchy, metrics

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
BASE = dt.datetime(2024, 1, 1)

events_st = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3 * 24 * 60)), min_size=1, max_size=40)


def brute_sessions(evs, gap=30):
    out = {}
    by_user = {}
    for i, (u, m) in enumerate(evs):
        by_user.setdefault(u, []).append((m, i))
    for u, xs in by_user.items():
        xs.sort()
        start, n, prev = None, 0, None
        sessions = []
        for m, _ in xs:
            if prev is None or m - prev > gap:
                if start is not None:
                    sessions.append((start, n))
                start, n = m, 0
            n += 1
            prev = m
        sessions.append((start, n))
        for s, n in sessions:
            day = (BASE + dt.timedelta(minutes=s)).date()
            c = out.setdefault(day, [0, 0])
            c[0] += 1
            c[1] += 1 if n == 1 else 0
    return {k: tuple(v) for k, v in out.items()}


@SETTINGS
@given(events_st)
def test_sessions_match_brute_force(spark, evs):
    rows = [(i, BASE + dt.timedelta(minutes=m), u) for i, (u, m) in enumerate(evs)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, user_id int")
    got = {r.day: (r.sessions, r.bounces) for r in metrics.sessions_bounce(df).collect()}
    assert got == brute_sessions(evs)


tree_st = st.lists(st.integers(0, 30), min_size=1, max_size=25)


@SETTINGS
@given(tree_st)
def test_closure_matches_walk(spark, picks):
    # node k (k >= 1) gets a parent among 0..k-1 → a forest rooted at 0
    parents = {0: None}
    for k, p in enumerate(picks, start=1):
        parents[k] = p % k
    e = spark.createDataFrame(list(parents.items()), "node_id int, parent_id int")
    got = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.hier_closure(e).collect()}
    want = set()
    for n in parents:
        a, d = n, 0
        while a is not None:
            want.add((a, n, d))
            a, d = parents[a], d + 1
    assert got == want


log_st = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 40), st.sampled_from(["a", "b", None])),
                  min_size=1, max_size=30)


@SETTINGS
@given(log_st, st.integers(1, 40))
def test_scd2_merge_equals_build(spark, log, cut):
    seen = {}
    for k, d, v in log:  # one change per key and day
        seen[(k, d)] = v
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d), v) for (k, d), v in seen.items()]
    df = spark.createDataFrame(rows, "k int, d date, v string")
    full = dims.scd2_build(df, "k", "d", ["v"])
    c = dt.date(2020, 1, 1) + dt.timedelta(days=cut)
    before = df.filter(F.col("d") < F.lit(c))
    after = df.filter(F.col("d") >= F.lit(c))
    dim = dims.scd2_build(before, "k", "d", ["v"])
    merged = dims.scd2_merge(dim, after, "k", "d", ["v"])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(merged.select(*full.columns).collect(), key=key) == sorted(full.collect(), key=key)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9)), min_size=1, max_size=30))
def test_bridge_weights_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "g int, m int")
    b = dims.bridge_build(df, "g", "m")
    sums = {r.g: r.w for r in b.groupBy("g").agg(F.sum("weight").alias("w")).collect()}
    assert all(w == 1 for w in sums.values())
    assert b.count() == len(set(pairs))
