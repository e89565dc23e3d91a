"""Exact duplicates, fill-in-middle and conversation repair against brute force."""
import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starlayer.llm import convrepair, exactdup, fim, queries
from tests.llm.conftest import SF

MEDIUM = SF.replace("0.001", "0.01")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_sql(key, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{MEDIUM}/{table}.parquet')")
    cur = con.execute(queries.ORACLE_SQL[key])
    names = [d[0] for d in cur.description]
    return names, Counter(cur.fetchall())


@pytest.mark.parametrize("key, table", [("op11_content_sort", "documents"), ("op12_fill_in_middle", "documents"),
                                        ("op13_conversation_repair", "conversations")])
def test_whole_table_equals_sql(spark, key, table):
    names, want = by_sql(key, table)
    got = queries.QUERIES[key](spark, MEDIUM)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == want


# --- exact duplicates ---------------------------------------------------------------------

def groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[t or ""].append(i)
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_copies_of_a_hot_text_are_cut_and_joined(spark, keep):
    rows = [(i, "the hot text") for i in range(0, 3000, 2)] + [(None, "the hot text")] * 20 + [(7, "the hot text")] * 30
    rows += [(5000 + i, None if i % 2 else "") for i in range(900)] + [(10_000 + i, f"text {i // 3}") for i in range(90)]
    rows += [(None, "no id")] * 40 + [(20_000, "x" * 200_000 + end) for end in "aab"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = exactdup.content_sort(frame, keep=keep).cache()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256) for r in out.collect()) == sorted(
        (i is None, i or 0, sha(t or "")) for i, t in rows)
    pick = min if keep == "smallest" else max
    want = {sha(t): (pick((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups(rows).items()}
    for r in out.collect():
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in out.collect() if r.kept) == Counter(want.keys())


def test_pieces_are_cut(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, body string")
    with exactdup.Store(spark) as store:
        hot, parts = exactdup._pieces(store, rows.withColumn("hash", F.xxhash64("body")))
        got = hot.collect()
    assert len(got) == 1 and got[0].pieces > parts  # two thirds of all rows: over half of the pieces


def test_sort_shuffles_texts_once(spark, docs):
    rows = docs.select("doc_id", F.col("text").alias("body")).withColumn("hash", F.xxhash64("body"))
    with exactdup.Store(spark) as store:
        hot, parts = exactdup._pieces(store, rows)
    seen = []
    put = exactdup.Store.put

    def look(self, df, name, keep=False):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return put(self, df, name, keep)

    exactdup.Store.put = look
    try:
        exactdup.op11(docs).count()
    finally:
        exactdup.Store.put = put
    plan = dict(seen)["sorted"]
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "Python" not in plan


def test_copies_odd_rows(spark, odd, none):
    kept = exactdup.keep_one_copy(odd)
    assert kept.columns == odd.columns
    assert Counter(kept.groupBy(F.coalesce("text", F.lit(""))).count().toDF("t", "n").rdd.map(lambda r: r.n).collect()) == {1: 11}
    assert {r.doc_id for r in kept.collect()} >= {1, 6, 9} and exactdup.keep_one_copy(none).count() == 0
    assert exactdup.op11(none).count() == 0
    lower = exactdup.keep_one_copy(odd, normalise=F.lower)
    assert lower.where("lower(text) = 'one two'").count() == 1 == lower.where("doc_id = 6").count()
    with pytest.raises(ValueError):
        exactdup.content_sort(odd, keep="first")


# --- fill in the middle ---------------------------------------------------------------------

TEXT = st.text(alphabet="ab\n\r é日\U0001F600<>PSM", max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.data())
def test_units_and_index(texts, data):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)
    for unit, split in (("line", lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)), ("char", list)):
        units = fim.Units(buffer, bounds, unit)
        want = [split(t) for t in texts]
        assert units.n.tolist() == [len(w) for w in want]
        k = np.array([data.draw(st.integers(0, len(w))) for w in want])
        cuts = units.cut(k)
        assert (cuts - bounds[:-1]).tolist() == [len("".join(w[:i]).encode()) for w, i in zip(want, k)]
        assert (units.chars(cuts) - units.char_lo).tolist() == [len("".join(w[:i])) for w, i in zip(want, k)]


def brute_fim(doc_id, text, rate=100, spm=50, unit="line"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("how", [{}, {"rate": 60, "spm": 20, "unit": "char"}])
def test_fim_equals_brute_force(spark, texts, odd, how):
    rows = [(i, r.text) for i, r in texts.items()] + [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(900 + i, t) for i, t in enumerate(["a<P>b\nc", "\n", "\n\nx", "x\n", "<P", "a<\n<S\n>", "é\n日本\n\U0001F600"])]
    rows.append((990, "日本語 text\n" * 40_000))
    out = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    assert Counter(map(tuple, out.collect())) == Counter(brute_fim(i, t, **how) for i, t in rows)
    for r in fim.read_back(out).collect():
        assert r.restored_sha256 in {sha(t or "") for i, t in rows if i == r.doc_id}


def test_fim_odd_rows(spark, odd, none):
    assert fim.op12(odd).count() == 14 and fim.op12(none).count() == 0
    with pytest.raises(ValueError):
        fim.transform(odd, unit="word")


# --- conversation repair --------------------------------------------------------------------

def least_audit(turns):
    """turns: (initial, forced, truncated). The grammar as an automaton, every
    edit tried: (cost, audit) of the least."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        ways = []
        if i == len(turns):
            if state in "0a":
                ways.append((0, ""))
        else:
            initial, forced, truncated = turns[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if not forced:
                for letter in "sua":
                    if step(state, letter) and (letter == initial or letter != "s"):
                        c, a = best(i + 1, letter, 0)
                        ways.append((c + (0 if letter == initial else 1) + 5 * truncated, ("K" if letter == initial else "R") + a))
        if inserted < 3:
            for letter in "ua":
                if step(state, letter):
                    c, a = best(i, letter, inserted + 1)
                    ways.append((c + 5, "I" + a))
        return min(ways, default=(10 ** 9, ""))

    def step(state, letter):
        return {"0": "su", "s": "u", "u": "a", "a": "u"}[state].find(letter) >= 0

    return best(0, "0", 0)


LETTERS = st.lists(st.sampled_from("suaxSUAX"), max_size=9).map("".join)


@settings(max_examples=150, deadline=None)
@given(LETTERS)
def test_alignment_is_the_least_of_all(turns):
    ways = convrepair.align(turns)
    got = min(w for e, w in ways.items() if e in ((0, 0), (0, 3)))
    assert got == least_audit(tuple((t.lower(), False, t.isupper()) for t in turns))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "", "truncated", "blank", "duplicate"]), st.integers(1, 3)),
                max_size=9), st.integers(1, 4))
def test_pieces_join_to_the_same(turns, size):
    turns = [(k, *t) for k, t in enumerate(turns)]
    pieces = [convrepair._summary(turns[k:k + size]) for k in range(0, len(turns), size)]
    got = convrepair.join_pieces(pieces)
    flat = [(i, (f in ("blank", "duplicate")) or c > 0, f == "truncated" and c == 0) for _, i, f, n in turns for c in range(n)]
    assert (got["cost"], got["audit"]) == least_audit(tuple(flat))
    assert got["illegal"] == sum(convrepair.illegal(a[0], b[0]) for a, b in zip(flat, flat[1:]))


def test_a_long_conversation():
    rng = np.random.default_rng(4)
    turns = "".join(rng.choice(list("uauauauasxUA"), 700))
    got = min(w for e, w in convrepair.align(turns).items() if e in ((0, 0), (0, 3)))
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert got == least_audit(tuple((t.lower(), False, t.isupper()) for t in turns))
    finally:
        sys.setrecursionlimit(old)


SPACES = " \t\n\x0b\x0c\r"


def brute_repair(rows, damaged=True):
    """rows: (conv_id, turn, role, text) -> conv_id -> (account…, sha)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20 if damaged else -1
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in turns:
            end = text.rstrip(SPACES)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        cost, audit = least_audit(tuple((r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(turns, faults)))
        names, i, left = [], 0, sum(x != "D" for x in audit)
        want = ["system"] * (left % 2) + ["user", "assistant"] * (left // 2)
        for edit in audit:
            if edit == "I":
                names.append((want[len(names)], ""))
                continue
            if edit != "D":
                names.append((turns[i][1] if edit == "K" else want[len(names)], turns[i][2]))
            i += 1
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit,
                     sha("\n".join(f"{r}:{t}" for r, t in names)))
    return out


def accounts(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def test_repair_of_the_table(spark):
    frame = spark.read.parquet(f"{MEDIUM}/conversations.parquet")
    out = queries.QUERIES["op13_conversation_repair"](spark, MEDIUM)
    assert accounts(out) == brute_repair([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert out.count() == frame.select("conv_id").distinct().count()


ODD = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "Be kind!"), (1, 3, None, "who?"), (1, 4, "assistant", None),
       (1, 5, "tool", "result."), (1, 9, "unknown", "So?"), (None, 0, "assistant", "first."), (None, None, "user", "then."),
       (2, 1, None, None), (3, 7, "user", "   \t\n"), (4, 0, "system", "cut"), (4, 1, "system", "Whole."), (5, 2, "", "?"),
       (6, 0, "user", "é日本 " * 50_000 + "."), (6, 0, "assistant", "same turn."), (6, 1, "user", "Hi."), (6, -4, "user", "Hi.")]


def test_repair_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(ODD * 2, schema).selectExpr("*", "7 as kind", "'x' as piece", "1.0 as digest", "2 as place")
    assert accounts(convrepair.op13(frame)) == brute_repair(ODD * 2)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD * 2)
    assert {r[0]: r[1:] for r in con.execute(convrepair.OP13_SQL).fetchall()} == brute_repair(ODD * 2)
    plain = accounts(convrepair.repair(frame).mapInArrow(convrepair._digests, convrepair.DIGESTED))
    assert plain == brute_repair(ODD * 2, damaged=False)
    turns = convrepair.repaired_turns(frame).where("conv_id = 6").orderBy("place").collect()
    assert [r.place for r in turns] == list(range(1, len(turns) + 1)) and "".join(r.role[0] for r in turns) == "ua" * (len(turns) // 2)
    none = spark.createDataFrame([], schema)
    assert convrepair.op13(none).count() == 0 and convrepair.repaired_turns(none).count() == 0


def test_one_conversation_of_many_turns(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, str(rng.choice(["user", "assistant", "system"], p=[0.5, 0.45, 0.05])),
             str(rng.choice(["Yes.", "No!", f"Reply {i}.", f"Cut {i}", f"Why {i}?"], p=[0.03, 0.03, 0.6, 0.04, 0.3]))) for i in range(1500)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"Fine {i}.") for i in range(20)]
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(50_000)
    try:
        want = brute_repair(rows)
    finally:
        sys.setrecursionlimit(old)
    assert accounts(convrepair.op13(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == want
