"""Chat formatting, mixing, packing, sharding, token files."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from starlayer.llm import chat, mixing, packing, sharding, tokenbin, tokens
from starlayer.session import scratch_dir
from tests.llm.conftest import SF
from tests.llm.test_text_ops import WORD


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


# --- chat -----------------------------------------------------------------------

def digests(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in conv.items():
        turns.sort()
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(),
                  len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r[0]: tuple(r)[1:5] for r in chat.op3(rows).collect()}
    assert got == digests([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
                          + chat.control_conversation())


def test_chat_odd_rows(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", " ", "x", "\n", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "é", "<", "[", ">"]
    roles = ["user", "assistant", "system", None, "tool [/ROLE] \\", "assistant ", "[ROLE]", ""]
    rows = [(c, rng.choice([None, 0, 1, 2, 2]), rng.choice(roles), rng.choice([None, "", "".join(rng.choices(bits, k=9))]))
            for c in (None, 1, 2, 3, 3, 3) for _ in range(40)]
    rows += [(9, i, "user", "hot") for i in range(3000)] + [(9, 5000, "assistant", "z" * 500_000)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, part string")
    chunks = chat.format_conversations(frame, parts=5)
    assert chunks.where("conv_id = 9").count() > 1  # the long conversation is formatted by several tasks
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(chunks).collect()}
    assert got == digests(rows)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# --- mixing ---------------------------------------------------------------------------

def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
            left -= out[s]
    return out


def test_mix(docs, odd, none):
    for frame in (docs, odd):
        rows = mixing.mix(frame).collect()
        assert sorted((r.size, r.taken) for r in rows) == sorted((r.size, r.taken) for r in mixing.mix(frame).collect())
        words = defaultdict(int)
        for r in frame.select("source", "text").collect():
            words[r.source] += len(WORD.findall(r.text or ""))
        want = brute_targets(words)
        assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted(
            {(words[s], round(want[s], 6)) for s in words})
        assert all(r.taken in (0, r.size, 2 * r.size) for r in rows) and len(rows) == frame.count()
    total = sum(r.size for r in mixing.mix(docs).collect())
    assert abs(sum(r.taken for r in mixing.mix(docs).collect()) - 1.5 * total) < 0.1 * total
    assert mixing.mix(none).count() == 0


def test_emit(docs, odd, none):
    out = mixing.emit(odd)
    assert out.columns == odd.columns
    taken = sum(r.taken for r in mixing.mix(odd).collect())
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == taken
    assert mixing.emit(none).count() == 0


# --- tokens -------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@example(["x <|endoftext|> y", "<|endoftext|>", "a  b<|endoftext|>c", "<|endoftext|", "plain text"])
@given(st.lists(st.text(st.sampled_from("abZé ß\n.,!'s%9\t 日\U0001F600|<>") | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_encoder_equals_the_library(texts):
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER)) if not hasattr(tokens, "_t") else tokens._t
    tokens._t = t
    ids, bounds = tokens.encoder()(pa.array([*texts, None], pa.string()))
    for k, text in enumerate([*texts, ""]):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


WHITE = "\t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"


@settings(max_examples=150, deadline=None)
@example("a \n \nb  c\n\n d \xa0e\t\nf's 't g'h ,'ll 80's \xd7i\xf7 \u2019s 5\xb2\n")
@given(st.text(st.sampled_from("   ab\xe9\u044f\u65e5\xd7\xaa\xb2\u2019\u0301''stl,.5" + WHITE), max_size=40))
def test_cuts_are_ends_of_the_librarys_pieces(text):
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = np.flatnonzero(tokens.piece_starts(data, np.array([0, len(data)])))
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    ends = {0, *(len(text[:b].encode()) for _, (_, b) in split(text))}
    assert set(cuts.tolist()) <= ends
    alone = [w for a, b in zip(cuts, cuts[1:]) for w, _ in split(data[a:b].tobytes().decode())]
    assert alone == [w for w, _ in split(text)]


def test_words_are_learnt_without_what_surrounds_them(library):
    """A word is learnt with and without its space, however many signs and line ends it stands beside."""
    words = [f"{a}{b}\xe9n" for a in "bcdfg" for b in ("a", "ou", "i", "el")]
    texts = [f"{v}{sign} {w}{sign}\n{v} ({w}) {v}" for sign in (",", ".", "!?", ";", ":", '"') for v in words for w in words]
    encode = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    ids, bounds = encode(pa.array(texts))
    assert len(encode.known) <= 2 * len(words) + 20
    for k in range(0, len(texts), 97):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == library(texts[k]).tolist()


def test_encoder_past_its_memo_and_in_slices(library):
    """Generations of the memo, long pieces, other scripts, slices with an offset."""
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "be", " ", " ", "\n", ",", "7", "'s", "\u043f\u0440", "\u65e5", " <|endoftext|>", "\xe9" * 40], k=30))
             for _ in range(400)] + [None, "", "x" * 5000]
    encode, whole = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), most_chunks=20), pa.array(texts, pa.string())
    for k in range(0, len(texts), 50):
        ids, bounds = encode(whole.slice(k, 50))
        for a, b, text in zip(bounds, bounds[1:], texts[k:k + 50]):
            assert ids[a:b].tolist() == library(text).tolist()
    assert 0 < max(map(len, [*encode.known, *encode.old])) <= tokens.LONGEST


def test_token_files(spark, docs, odd, none, library):
    for frame in (docs, odd):
        rows = tokenbin.op9(frame).collect()
        rows.sort(key=lambda r: r.start)
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
        assert keys == sorted(keys)
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        want = [(r.doc_id, len(i := library(r.text)), zlib.crc32(i.tobytes())) for r in frame.collect()]
        order = lambda x: (x[0] or -1, x[1:])
        assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=order) == sorted(want, key=order)
    assert tokenbin.op9(none).count() == 0
    path = scratch_dir(spark, "t")
    tokenbin.write_tokens(docs, path)
    some = [3, 77, -5]
    assert {r.doc_id for r in tokenbin.read_tokens(spark, path, some).collect()} == {3, 77}


# --- packing ------------------------------------------------------------------------------

def check_packed(rows, frame, library):
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    want = defaultdict(list)
    for r in frame.collect():
        ids = library(r.text)
        want[r.doc_id] += [(s, n, zlib.crc32(ids[s:s + n].tobytes())) for s, n in packing.cut(len(ids))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places), sum(r.length for r in rows)


def test_pack(docs, odd, none, library):
    n, total = check_packed(packing.op6(docs).collect(), docs, library)
    assert n <= -(-total // packing.LENGTH) * 1.02 + 1
    check_packed(packing.op6(odd).collect(), odd, library)
    assert packing.op6(none).count() == 0


def test_cut():
    assert packing.cut(2048) == [(0, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(1) == [(0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_keeps_items_and_gains(lengths):
    lengths = np.array(lengths)
    first = [[i] for i in range(len(lengths))]
    packed = packing.local_search([list(b) for b in first], lengths, 100)
    assert sorted(i for b in packed for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in packed)
    assert sum(lengths[b].sum() ** 2 for b in packed) >= (lengths ** 2).sum()
    assert len(packing.pack_lengths(lengths, 100)) <= len(packing.best_fit(lengths, 100))


def test_local_search_exchanges():
    # 60+30 and 50+40 leave 10 free each: exchanging 40 for 30 and so on empties the bin of 20
    lengths = np.array([60, 30, 50, 40, 20])
    assert len(packing.local_search([[0, 1], [2, 3], [4]], lengths, 100)) == 2


def exchange_left(bins, lengths, capacity):
    """Whether a move, 1-for-1 or 2-for-1 exchange with a bin at least as full is left."""
    under = [b for b in bins if lengths[b].sum() < capacity]
    sums = [np.unique([*lengths[b], *(lengths[i] + lengths[j] for x, i in enumerate(b) for j in b[x + 1:])]) for b in under]
    fill = [lengths[b].sum() for b in under]
    for g, amounts in enumerate(sums):
        for t, taker in enumerate(under):
            if t != g and fill[t] >= fill[g]:
                gain = amounts[:, None] - np.array([0, *lengths[taker]])
                if ((gain > 0) & (gain <= capacity - fill[t])).any():
                    return True
    return False


def test_local_search_leaves_no_exchange():
    # more underfull bins than 400; and givers with more than 16 items
    rng = np.random.default_rng(1)
    for lengths, capacity in ((rng.integers(600, 1100, 2_000), 2048), (rng.integers(2, 90, 400), 997)):
        first = packing.best_fit(lengths, capacity)
        if capacity == 997:
            first = [[int(i) for i in part] for part in np.array_split(np.arange(len(lengths)), 22)]
        packed = packing.local_search([list(b) for b in first], lengths, capacity)
        assert sorted(i for b in packed for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= capacity for b in packed)
        assert not exchange_left(packed, lengths, capacity) and len(packed) < len(first)


# --- sharding --------------------------------------------------------------------------------

def test_shards(docs, odd, none):
    for frame in (docs, odd):
        rows = sharding.shard(frame).collect()
        texts = sorted(((r.text or "").encode() for r in frame.collect()))
        assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t) + 1, zlib.crc32(t)) for t in texts)
        slots = defaultdict(list)
        for r in rows:
            assert r.law == "key" and r.grown_shard in (r.shard, 16)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        again = {(r.doc_id, r.shard, r.grown_shard) for r in sharding.shard(frame.repartition(3)).collect()}
        assert again == {(r.doc_id, r.shard, r.grown_shard) for r in rows}
    assert sharding.shard(none).count() == 0


def test_hash_tree_moves_only_into_what_grew():
    keys = np.arange(200_000, dtype=np.uint64)
    last = sharding.place(keys, sharding.layout(16))
    counts = np.bincount(last, minlength=16)
    assert abs(counts / 12_500 - 1).max() < 0.05
    for n in (17, 18, 19, 20):
        now = sharding.place(keys, sharding.layout(n))
        moved = now != last
        assert (now[moved] == n - 1).all() and abs(moved.mean() * n - 1) < 0.1
        last = now


def _descend(key, shards):
    """One key's way down the tree, level by level."""
    within, path = shards, ()
    for level in (1, 2, 0):
        heavy = Counter()
        for s in within:
            heavy[(s[level], s[4])] += s[3]
        if len(heavy) > 1:
            waits = {c: sharding.wait(np.array([key], dtype=np.uint64), path + c, w)[0] for c, w in heavy.items()}
            best = min(sorted(heavy), key=waits.get)
        else:
            best = next(iter(heavy))
        within, path = [s for s in within if (s[level], s[4]) == best], path + best
    return within[0][0]


def test_weighted_shards(spark, docs):
    weights = {0: 4.0, 5: 0.5, 16: 2.0}
    keys = np.arange(1, 40_001, dtype=np.uint64)
    for n in (16, 18):
        tree = sharding.layout(n, weights=weights)
        placed = sharding.place(keys, tree)
        assert placed[:300].tolist() == [_descend(k, tree) for k in keys[:300]]
        share = np.array([s[3] for s in tree]) / sum(s[3] for s in tree)
        assert np.abs(np.bincount(placed, minlength=n) / len(keys) - share).max() < 0.01
    for r in sharding.shard(docs, weights=weights).collect()[:200]:
        key = int(np.array([r.doc_id], dtype=np.int64).view(np.uint64)[0])
        assert r.shard == _descend(key, sharding.layout(16, weights=weights))
        assert r.grown_shard == _descend(key, sharding.layout(17, weights=weights))
    with pytest.raises(ValueError):
        sharding.layout(16, weights={3: 0.0})


def test_a_heavier_shard_draws_rows_along_its_path_only():
    keys = np.arange(1, 40_001, dtype=np.uint64)
    before, after = (sharding.layout(16, weights={5: w}) for w in (1.0, 3.0))
    old, new = sharding.place(keys, before), sharding.place(keys, after)
    region, rack = {s[0]: s[1] for s in before}, {s[0]: s[2] for s in before}
    moved = [(a, b) for a, b in zip(old.tolist(), new.tolist()) if a != b]
    assert moved
    for a, b in moved:
        assert region[b] == region[5]
        if region[a] == region[5]:
            assert rack[b] == rack[5]
            assert rack[a] != rack[5] or b == 5
