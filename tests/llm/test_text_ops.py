"""Language ID, line quality, toxicity."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from starlayer.llm import langid, quality, toxicity
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_held_out_accuracy(spark, docs):
    out = langid.op1(spark, spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).toPandas()
    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(truth, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_backoff_order():
    model = {"langs": ["a", "b"], "orders": {0: {"hello": np.array([-1.0, -5.0])}, 1: {"h": np.array([-2.0, -1.0])}, 2: {},
                                              3: {}, 4: {" hex": np.array([-4.0, -3.0])}}}
    p = langid.Predictor(model)
    assert p("hello")[0] == "a"          # the word itself
    assert p("hex")[0] == "b"            # its longest known n-gram
    assert p("h")[0] == "b"              # a letter
    assert p("zzz") == ("a", 0.5)        # nothing known: a tie, first name


def test_language_odd_rows(spark, docs, odd, none):
    model = langid.fit(docs)
    out = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= out
    assert langid.identify(odd, model).count() == 14 and langid.identify(none, model).count() == 0
    kept = langid.keep_identified(odd, model, min_score=0.0)
    assert kept.columns == odd.columns and not {1, 2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert langid.identify(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_keep_identified_keeps_all_with_letters(spark, docs):
    # words that no language knows: the posterior is one over the four languages
    rows = spark.createDataFrame([(1, "日本"), (2, "日 7"), (3, "123 ..."), (4, None)], "doc_id long, text string")
    model = langid.fit(docs)
    assert len(model["langs"]) > 2 and min(r.score for r in langid.identify(rows, model).where("lang_pred <> 'und'").collect()) < 0.4
    assert {r.doc_id for r in langid.keep_identified(rows, model).collect()} == {1, 2}


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_quality_counts(docs, odd, texts, none):
    for frame in (docs, odd):
        got = sorted(((r.doc_id is not None, r.doc_id or 0), tuple(r)[1:7]) for r in quality.clean_lines(frame).collect())
        rows = frame.select("doc_id", "text").collect()
        assert got == sorted(((r.doc_id is not None, r.doc_id or 0), brute_quality(r.text)) for r in rows)
    assert quality.clean_lines(none).count() == 0


def test_quality_verdict(spark, docs):
    good = "\n".join(" ".join(f"{w}{i}" for w in "this line says a few words of its own quite plainly".split()) + "." for i in range(9))
    menu = "\n".join("Home | About | Contact | Page %d | Login | Search" % i for i in range(30))
    assert quality.judge(good.encode())[6] and not quality.judge(menu.encode())[6]
    mixed = quality.judge((good + "\n" + menu.split("\n")[0] + "\nAll rights reserved.").encode())
    assert mixed[6] and mixed[7].decode() == good  # the failing lines go, the document stays
    rows = quality.clean_lines(docs, with_text=True).collect()
    assert all(not (r.base_failed and r.kept) for r in rows) and any(r.kept for r in rows)


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    both = toxicity.op8(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    assert held.toxic.sum() >= 3 and ((held.score >= 0.5) == held.toxic).mean() > 0.93
    assert held[held.toxic == 1].score.min() > held[held.toxic == 0].score.median()


def test_toxicity_parts():
    f = toxicity.Featurizer({"words": {"grobble": 3.0}, "stems": {"blurg": 2.0}})
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert f("you Grobble!")[at["hits"]] == 1 and f("you Grobble!")[at["near_second"]] == 1
    assert f("gr0bble and g.r.o.b.b.l.e")[at["obfuscated"]] == 2
    assert f("blurgish")[at["stems"]] == 1 and f(None).sum() == 0 == f("").sum()
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] > 0.3)).astype(float)
    model = toxicity.fit_trees(x, y)
    raw = toxicity.raw_scores(model, x)
    assert ((raw > 0) == y).mean() > 0.98
    knots, values = toxicity.fit_isotonic(raw, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


@pytest.mark.parametrize("labelled", [True, False])
def test_toxicity_odd_rows(spark, docs, odd, none, labelled):
    labels = spark.read.parquet(f"{SF}/labels.parquet").limit(10_000 if labelled else 0)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score(none, model).count() == 0


def _made_words(n):
    """Distinct words of letters only."""
    return ["q" + "".join("abcdefghij"[int(d)] for d in f"{i:06d}") for i in range(n)]


def test_every_sampled_word_enters_the_model(spark):
    words = _made_words(160_000)
    text = " ".join(words + words + ["once"])
    model = langid.fit(spark.createDataFrame([(1, text, "xx"), (2, "b b c c", "yy")], "doc_id long, text string, lang string"))
    known = set(model["orders"][0][0].split("\n"))
    assert known == set(words) | {"b", "c"}


def test_every_heavy_word_enters_the_lexicon(spark):
    words = _made_words(20_000)
    rows = [(" ".join(words), 1, f) for f in (0, 0, 1, 1)] + [("calm words here", 0, f) for f in (0, 1) * 10]
    lexicons = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    for lexicon in lexicons:
        assert set(lexicon["words"]) == set(words)


def test_a_language_without_long_words_or_letters_is_learned(spark):
    rows = [(1, "a b a b", "xx"), (2, "12 34", "yy"), (3, "", "zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert model["langs"] == ["xx"]
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(frame, model).collect()} == {(1, "xx"), (2, "und"), (3, "und")}
    blank = spark.createDataFrame([("", 1, 0), ("", 0, 1)], "text string, toxic int, fold int")
    assert all(not x["words"] and not x["stems"] for x in toxicity.learn_lexicon(blank))
