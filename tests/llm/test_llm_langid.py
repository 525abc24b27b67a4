"""Language identification: chain against enumeration, accuracy on held-out texts, code-switched texts, odd rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from steadyline.llm import langid
from steadyline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def enumerated(score, transitions):
    n, k = score.shape
    mass, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(sum(score[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            mass[i, y] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    return mass / total, pairs / total


def test_chain_marginals_match_enumeration():
    draw = np.random.default_rng(4)
    for n in (1, 2, 5):
        score, transitions = draw.normal(size=(n, 3)) * 2, draw.normal(size=(3, 3))
        mass, pairs = enumerated(score, transitions)
        got, seen = langid.chain_marginals(score[None], transitions)
        assert np.allclose(got[0], mass) and np.allclose(seen, pairs)


@pytest.mark.parametrize("lengths", [[], [0], [1], [64], [63, 64, 65], [0, 1, 128, 129, 300, 2, 0], [2000, 3]])
def test_blocked_marginals_match_plain_chains(lengths):
    draw = np.random.default_rng(len(lengths))
    score, transitions = draw.normal(size=(sum(lengths), 4)) * 6, draw.normal(size=(4, 4)) * 4
    start = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    got = langid.marginals(score, start, transitions)
    for a, z in zip(start, start[1:]):
        if z > a:
            assert np.abs(langid.chain_marginals(score[a:z][None], transitions)[0][0] - got[a:z]).max() < 1e-9


def test_a_step_follows_the_gradient():
    """Against differences of the log-likelihood that chain_marginals' sums stand for."""
    draw = np.random.default_rng(7)
    score, transitions, gold = draw.normal(size=(4, 3)), draw.normal(size=(3, 3)), [0, 2, 2, 1]

    def likelihood(s, t):
        own = sum(s[i, y] for i, y in enumerate(gold)) + sum(t[a, b] for a, b in zip(gold, gold[1:]))
        every = [sum(s[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=4)]
        return own - np.log(np.exp(every).sum())

    mass, pairs = langid.chain_marginals(score[None], transitions)
    for i, j in itertools.product(range(4), range(3)):
        d = np.zeros_like(score)
        d[i, j] = 1e-6
        assert (likelihood(score + d, transitions) - likelihood(score, transitions)) / 1e-6 == pytest.approx((gold[i] == j) - mass[0, i, j], abs=1e-5)
    for a, b in itertools.product(range(3), range(3)):
        d = np.zeros_like(transitions)
        d[a, b] = 1e-6
        seen = sum(p == (a, b) for p in zip(gold, gold[1:]))
        assert (likelihood(score, transitions + d) - likelihood(score, transitions)) / 1e-6 == pytest.approx(seen - pairs[a, b], abs=1e-5)


def test_features_name_affixes_and_words():
    vocab = pa.array([b"abc", b"abd", b"xab", "é".encode()], pa.large_binary())
    feature, owner, _ = langid.features(vocab, 40)
    of = [set(feature[owner == i].tolist()) for i in range(4)]
    assert len(of[0] & of[1]) == 3  # " a", " ab" and "ab"
    assert len(of[0] & of[2]) == 1  # "ab"; neither is an affix of the other
    assert len(of[3]) == 1 + 3 + 2 + 1  # the word, and what its two bytes and borders give


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return langid.fitted(docs.where(~langid.held_out(4, 2)))


def test_query_on_held_out_texts(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op13_language_id"](spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert 0.15 < len(held) / len(got) < 0.35
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) >= 0.98


def test_words_of_code_switched_text_are_labelled(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out(4, 2)).where("n_chars > 900")
    texts = {r["lang"]: r["text"][:600] for r in docs.orderBy("doc_id").collect()}
    words = langid.words_of(pa.array([texts["en"] + " " + texts["de"]]), langid.LETTERS)
    p = langid.marginals(langid.emissions(words.vocab, model)[words.code], words.start, model.transitions)
    n_en = int(langid.words_of(pa.array([texts["en"]]), langid.LETTERS).start[-1])
    named = [model.labels[j] for j in p.argmax(1)]
    assert named[:n_en].count("en") > 0.9 * n_en and named[n_en:].count("de") > 0.9 * (len(named) - n_en)
    assert (np.diag(model.transitions) > model.transitions.mean(1)).all()  # languages tend to go on


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 . !"), (None, "the of and"), (5, "…—"), (6, "x"), (6, "x"), (7, "the and of that " * 60_000), (8, "文字")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, score int, lang string")
    got = langid.identified(df, model).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"][:8] if r["text"] else r["text"]): (r["lang_pred"], r["score"]) for r in got}
    for key in ((1, None), (2, ""), (3, "12 . !"), (5, "…—")):
        assert by[key] == ("und", 0.0)
    assert by[None, "the of a"][0] == "en" and by[7, "the and "][0] == "en" and by[8, "文字"][0] in model.labels
    assert langid.identified(df.limit(0), model).count() == 0


def test_little_to_learn_from(spark):
    schema = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "", "de")], schema)
    assert [r["lang_pred"] for r in langid.identified(docs, langid.fitted(docs)).collect()] == ["und"] * 3
    one = spark.createDataFrame([(1, "some words", "xx"), (1, "some words", "xx"), (None, "mehr", None)], schema)
    assert {(r["lang_pred"], r["score"]) for r in langid.identified(one, langid.fitted(one)).collect()} == {("xx", 1.0)}
    two = spark.createDataFrame([(1, "aa", "x"), (2, "bb", "y")], schema)  # fewer words than a chain: no step, ties go by name
    assert {r["lang_pred"] for r in langid.identified(two, langid.fitted(two)).collect()} == {"x"}


def test_model_does_not_depend_on_the_layout_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    s = langid.Settings(rounds=1, shards=2, bits=12)
    a, b = langid.fitted(docs, s), langid.fitted(docs.repartition(7), s)
    assert a.labels == b.labels and (a.weights == b.weights).all() and (a.transitions == b.transitions).all()
