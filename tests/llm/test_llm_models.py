"""Learnt and numeric operators: exact parts against brute force, learnt parts by held-out results."""

import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from steadyline.llm import embeddings, lattice, maxent, quality
from steadyline.llm.components import components

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CLASH = "doc_id bigint, text string, score string, chunk string, label string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], CLASH).repartition(parts)


# ---- components


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(1000, 1300)] + [(2, 1000), (2, 2), (None, 7), (7, None)]
    df = spark.createDataFrame(chain + hub, "x bigint, y bigint").repartition(4)
    got = {r.node: r.root for r in components(df, "x", "y").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 2 for i in [2, 5, *range(1000, 1300)]}}
    assert components(df.limit(0), "x", "y").count() == 0


# ---- embeddings


def brute_vectors(rows, threshold):
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) and label is not None for _, v, label in rows]
    n, near = len(rows), {i: set() for i in range(len(rows))}
    unit = [np.array(v, float) / np.linalg.norm(v) if good else None for (_, v, _), good in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((str(rows[i][0]), len(near[i]), str(least), rows[i][0] == least))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 25])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(6, 24))
    for i in range(160):
        v = centre[i % 6] + rng.normal(size=24) * rng.choice([0.01, 0.1, 0.2])
        rows.append((i, (v * rng.choice([1e-3, 1, 1e3])).astype(np.float32).tolist(), i % 6 // 2))
    rows += [(300 + i, rows[6][1], rows[6][2]) for i in range(9)] + [(6, rows[6][1], rows[6][2]), (None, rows[6][1], rows[6][2])]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 24, 0), (403, [None] * 24, 0), (404, [nan] + [1.0] * 23, 0), (405, [inf] * 24, 0), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0), (None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, cid string").repartition(3)
    got = embeddings.near_duplicates(df).collect()
    want = brute_vectors(rows, 0.98)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert sum(w[1] > 0 for w in want) > 60 and embeddings.near_duplicates(df.limit(0)).count() == 0


def test_the_error_bound_holds(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(200, 40)) * np.exp(rng.normal(size=(200, 40))) for _ in range(2))
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    b[:100] = a[:100] + rng.normal(size=(100, 40)) * 0.02
    b /= np.linalg.norm(b, axis=1)[:, None]
    true = a @ b.T
    for threshold in (0.5, 0.9, 0.98, 0.995):
        found = embeddings._linked((a, *embeddings.quantised(a)), (b, *embeddings.quantised(b)), slice(0, 200), threshold)
        assert (found == (true >= threshold)).all()


# ---- quality


def marked(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))
        good = rng.random() < 0.8
        rows.append((i, text.capitalize() + "." if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = marked(600)
    odd = [(None, rows[0][1]), (1000, None), (1001, ""), (1002, "x " * 50_000), (0, rows[0][1])]
    extra = [(0, 1), (0, 0), (1, None), (2, 7), (None, 1), (5000, 1)]
    labelled = spark.createDataFrame([(*x, 1) for x in labels + extra], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows + odd)
    weights = quality.fitted(docs, labelled.where(~quality.held_out(5)), quality.Settings(bits=12, shards=3))
    got = quality.scored(docs, weights).select("doc_id", "text", "score", quality.held_out(5).alias("held"), "chunk").collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [(r.score >= 0.3) == truth[r.doc_id] for r in got if r.held and r.doc_id in truth]
    assert len(held) > 80 and np.mean(held) > 0.97
    assert {r.held for r in got if r.doc_id is None} == {True}
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_quality_deals_its_vectors_out_once(spark, monkeypatch):
    rows, labels = marked(300)
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int")
    docs, plans = frame(spark, rows + [rows[0], (rows[1][0], "another text")]), []
    plain = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    seen = []
    by_shard = quality._by_shard
    monkeypatch.setattr(quality, "_by_shard", lambda *a: seen.append(by_shard(*a)) or seen[-1])
    assert quality.fitted(docs, labelled, quality.Settings(bits=10, shards=3, rounds=2)).any()
    assert len(plans) == 2 and not any("hashpartitioning(shard" in p for p in plans)
    monkeypatch.undo()
    assert sorted(r.doc_id for r in seen[0].collect()) == list(range(300))


def test_quality_without_labels(spark):
    docs = frame(spark, marked(10)[0])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    weights = quality.fitted(docs, none)
    assert not weights.any() and {r.score for r in quality.scored(docs, weights).collect()} == {0.5}
    assert quality.scored(docs.limit(0), weights).count() == 0


def test_one_vector_follows_the_formula():
    s = quality.Settings(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(3), np.zeros(3)
    quality._follow(z, n, np.array([0, 2]), np.array([1.0, 2.0]), 1, s)
    assert np.allclose(z, [-0.5, 0, -1.0]) and np.allclose(n, [0.25, 0, 1.0])  # w = 0, p = 1/2
    w = quality._weights(z, n, s)
    assert np.allclose(w, [0.4 / ((1 + 0.5) / 0.5 + 0.2), 0, 0.9 / ((1 + 1) / 0.5 + 0.2)])


# ---- language model


def test_model_counts_and_probabilities(spark):
    rng = random.Random(3)
    tongues = [[f"{t}{i}" for i in range(60)] for t in "abcd"]
    rows = [(i, " ".join(rng.choice(tongues[i % 4]) for _ in range(rng.randint(1, 60)))) for i in range(1600)]
    rows += [(9000, None), (9001, ""), (9002, "Zß ñ " * 4000), (None, "a1 A2"), (3, rows[3][1])]
    s = maxent.Settings(first_bits=8, second_bits=9, batch=2048)
    model = maxent.LanguageModel(frame(spark, rows, 4), s, chunk_bytes=40_000, bucket_bytes=90_000)
    got = model.scores().collect()
    assert len(got) == len(rows)
    text = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update(text(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    assert (model.model.tokens, model.model.vocabulary, model.model.end_count) == (n, v, ends)
    p = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((str(i), held(i), len(text(t)) + 1, sum(count[w] > 0 for w in text(t)) + 1, round(sum(p(count[w]) for w in text(t)) + p(ends), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    own = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.2 * sum(r.n_tokens for r in own)  # the company of words tells


def test_softmax_sums_to_one():
    s = maxent.Settings(first_bits=6, second_bits=7)
    rng = np.random.default_rng(1)
    weights = rng.normal(size=((1 << 6) + (1 << 7), maxent.SIDE)).astype(np.float32)
    before = [np.full(256, np.uint64(rng.integers(1 << 60))) for _ in range(3)]
    assert abs((10 ** maxent._log10(weights, before, np.arange(256), s)).sum() - 1) < 1e-4


def test_texts_are_cut_into_words_once(spark):
    model = maxent.LanguageModel(frame(spark, [(i, f"a b{i % 7} C {i}") for i in range(40)], 2), maxent.Settings(first_bits=5, second_bits=6, rounds=1))
    plan = model.scores()._jdf.queryExecution().executedPlan().toString()
    assert "places" in plan and "text" not in plan


def test_a_coded_chunk_reads_back():
    texts, ids = ["b a b", None, " ", "x A a y"], [7, None, 3, 20]
    given = pa.table({"chunk": [5] * 4, "doc_id": pa.array(ids, pa.int64()), "text": texts})
    made = maxent._Chunk(given, 3, 10)
    fields = [f.split()[0] for f in maxent._Chunk.CODED.split(", ")]
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 3]
    read = maxent._Chunk.read(pa.table({n: pa.array([v], k) for n, v, k in zip(fields, made.coded(), kinds)}), 10)
    assert read.doc_id.to_pylist() == ids and (read.held == made.held).all() and read.counts().tolist() == [3, 0, 0, 4]
    counts, leaves = np.arange(4), np.arange(4, dtype=np.uint8)
    for x, y in zip(made.sequence(counts, leaves, 9), read.sequence(counts, leaves, 9)):
        assert np.array_equal(x, y)
    high, low = maxent.hashes(pa.array(["b", "a", "x", "y"], pa.large_binary()))
    place = {int(v): i for i, v in enumerate(made.low)}
    b, a, x, y = (place[int(v)] for v in low)
    assert read.place.tolist() == [b, a, b, x, a, a, y] and read.hash[[b, a, x, y]].tolist() == high.tolist()


def test_gradient_is_that_of_the_likelihood():
    s = maxent.Settings(first_bits=5, second_bits=6, batch=50, rate=0.05)
    rng = np.random.default_rng(2)
    leaf = rng.choice([3, 3, 3, 70, 200], size=500)
    before = [mixed for mixed in rng.integers(1 << 60, size=(3, 500)).astype(np.uint64)]
    zero = np.zeros(((1 << 5) + (1 << 6), maxent.SIDE), np.float32)
    new = maxent._descended(zero, before, leaf, s)
    assert maxent._log10(new, before, leaf, s).sum() > maxent._log10(zero, before, leaf, s).sum() + 100


def test_nothing_to_learn_from(spark):
    got = maxent.LanguageModel(frame(spark, [(None, "a b")], 1)).scores().first()
    assert (got.n_known, got.base_score) == (0, 0.0) and math.isfinite(got.score)
    assert maxent.LanguageModel(frame(spark, [], 1)).scores().count() == 0


# ---- sampled segmentations


@pytest.fixture(scope="module")
def pieces():
    return lattice.pieces(PIECES)


TEXTS = ["The quick brown fox", "", None, "  two  blanks\n\nand\tlines \n", "ñandú 漢字 𝄞 ▁ literal", "a", "\x00\x01", "x" * 3000, "word " * 4000, "\n", " "]


def test_round_trip_and_distinct_samples(spark, pieces):
    rows = list(enumerate(TEXTS)) + [(None, "The quick"), (0, TEXTS[0])]
    out = lattice.encoded(frame(spark, rows), pieces, k=4)
    got = out.collect()
    assert out.columns[:5] == ["doc_id", "text", "score", "chunk", "label"] and all(r.exact for r in got)
    assert all((r.text or "") == d.decoded for r, d in zip(got, lattice.decoded(out, pieces).collect()))
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text), []).append(r)
    assert len(by) == len(rows) - 1
    for (i, text), own in by.items():
        several = {tuple(r.ids) for r in own}
        assert len(several) == len(own) / (2 if i == 0 else 1) <= 4  # the repeated row has equal samples
        assert all(r.log_prob <= 1e-9 and r.inclusion <= 1e-9 and r.n_pieces == len(r.ids) for r in own)
    assert len(by[1, ""]) == len(by[2, None]) == 1 and by[1, ""][0].ids == []
    one_way = by[9, "\n"]  # the blank in front and the line break have one way each
    assert len(one_way) == 1 and one_way[0].inclusion == 0 and abs(one_way[0].log_prob) < 1e-9
    again = lattice.encoded(frame(spark, rows, 1), pieces, k=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert lattice.encoded(frame(spark, [], 1), pieces).count() == 0


def every_way(text, pieces):
    """All segmentations of a text with their probabilities."""
    surface = {b.as_py(): i for i, b in enumerate(pieces.text) if i > 258}
    data, ways = b" " + text, []

    def go(at, ids, w):
        if at == len(data):
            ways.append((tuple(ids), w))
        for end in range(at + 1, len(data) + 1):
            if (i := surface.get(data[at:end])) is not None:
                go(end, [*ids, i], w + pieces.weight[i])

    go(0, [], 0.0)
    total = sum(math.exp(w) for _, w in ways)
    return {ids: math.exp(w) / total for ids, w in ways}


def test_samples_follow_the_lattice(pieces):
    flat = lattice.pieces(PIECES, sharpness=0.3)
    p = every_way(b"an on", flat)
    n = 6000
    keys = np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, lat, leaves, out, kappa, first = lattice.searched([b"an on"] * n, keys, 2, flat)
    drawn = []
    for leaf, (_, there) in zip(leaves, out):
        assert there.all()
        ids = lat.piece[leaf.edges]
        at = leaf.start[first]
        drawn.append([tuple(ids[a:z].tolist()) for a, z in zip(at, at[1:])])
        assert all(abs(math.exp(leaf.log_p[first[t] : first[t + 1]].sum()) - p[drawn[-1][t]]) < 1e-9 for t in range(0, n, 97))
    second = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for got, want in ((Counter(drawn[0]), p), (Counter(drawn[1]), second)):
        assert all(abs(got[ids] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-4 for ids, q in want.items())
    assert all(a != b for a, b in zip(*drawn))
    # the inclusion scores are unbiased weights: the sum of p / inclusion over the sample has the mean 1
    weight = sum(np.array([p[x] for x in d]) / -np.expm1(-np.exp(np.log([p[x] for x in d]) - kappa)) for d in drawn)
    assert abs(weight.mean() - 1) < 5 * weight.std() / math.sqrt(n)


def test_all_segmentations_come_once(pieces):
    p = every_way(b"the", pieces)
    _, lat, leaves, out, kappa, first = lattice.searched([b"the"] * 5, np.arange(1, 6).astype(np.uint64), len(p) + 2, pieces)
    for t in range(5):
        seen = [tuple(lat.piece[leaf.edges[leaf.start[first[t]] : leaf.start[first[t + 1]]]].tolist()) for leaf, (_, there) in zip(leaves, out) if there[t]]
        assert len(seen) == len(p) and set(seen) == set(p)
    assert np.isneginf(kappa).all()


def test_lattices_hold_every_piece_that_fits(pieces):
    surface = {}
    for i, b in enumerate(pieces.text.to_pylist()):
        if i > 258:
            surface[b] = i
    units = [" the".encode(), "  ".encode(), "\n".encode(), " ñandú漢𝄞\x00".encode(), " internationalisation".encode(), b" " + b"=" * 70, " ​а".encode()]
    lat = lattice.Lattices(pa.array(units, pa.large_binary()), pieces)
    got, want = set(), set()
    for node in range(len(lat.rank)):
        if (k := lat.rank[node]) >= 0:
            got |= {(int(lat.source[e]), node, int(lat.piece[e])) for e in range(lat.bounds[k], lat.bounds[k + 1])}
    for unit, begin in zip(units, lat.begin.tolist()):
        starts = [a for a in range(len(unit)) if unit[a] & 0xC0 != 0x80]
        for a, z in zip(starts, [*starts[1:], len(unit)]):
            own = [(begin + a, begin + b, surface[unit[a:b]]) for b in range(a + 1, len(unit) + 1) if unit[a:b] in surface]
            if unit[a:z] not in surface:
                own += [(begin + i, begin + i + 1, int(pieces.byte[unit[i]])) for i in range(a, z)]
            want |= set(own)
    assert got == want and len(lat.source) == len(want)


def other(lat, unit, ruled_out, seed):
    """One unit's segmentation that is none of ``ruled_out``, edge by edge."""
    node, path, left = lat.end[unit], [], [r[::-1] for r in ruled_out]
    while node != lat.begin[unit]:
        edges = np.arange(lat.bounds[lat.rank[node]], lat.bounds[lat.rank[node] + 1])
        share, free = np.exp(lat.log_p[edges]), lat.ways[lat.source[edges]]
        for r in left:
            share[r[len(path)] - edges[0]] -= np.exp(lat.log_p[r[len(path) :]].sum())
            free[r[len(path)] - edges[0]] -= 1
        share = np.where(free > 0, np.maximum(share, 0.0), 0.0)
        share = share if share.sum() else (free > 0).astype(float)
        upto = np.cumsum(share)
        drawn = float(lattice.uniform(np.array([seed]), len(path))[0]) * upto[-1]
        e = edges[min(int(np.searchsorted(upto, drawn, side="right")), int(np.flatnonzero(share)[-1]))]
        left = [r for r in left if r[len(path)] == e]
        path.append(e)
        node = lat.source[e]
    return path[::-1]


def test_units_parted_together_are_as_one_by_one(pieces):
    words = [" the", " on", " remarkable", " ñandú", " " + "x" * 300, " internationalisation"]
    lat = lattice.Lattices(pa.array([w.encode() for w in words], pa.large_binary()), pieces)
    unit = np.repeat(np.arange(len(words)), 3)
    seeds = np.arange(1, len(unit) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    edges, start, _ = lat.sample(unit, seeds)
    ruled = [[edges[a:z]] for a, z in zip(start, start[1:])]
    for again in range(1, 4):
        want = [other(lat, *x) for x in zip(unit.tolist(), ruled, seeds + np.uint64(again))]
        edges, start = lat.others(unit, ruled, seeds + np.uint64(again))
        got = [edges[a:z] for a, z in zip(start, start[1:])]
        assert [g.tolist() for g in got] == want
        ruled = [[*r, g] for r, g in zip(ruled, got)]
        assert all(len({tuple(x.tolist()) for x in r}) == again + 1 for r in ruled)


def test_a_slice_is_searched_as_one(pieces):
    """Calls grow little with the number of texts: what differs at a unit is drawn for all texts of a slice at once."""

    def calls(n):
        made, texts = Counter(), [b"the quick brown fox jumps over the lazy dog"] * n
        keys = np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sys.setprofile(lambda frame, event, arg: made.update([event]))
        try:
            lattice.searched(texts, keys, 2, pieces)
        finally:
            sys.setprofile(None)
        return made["call"] + made["c_call"]

    assert (calls(600) - calls(200)) / 400 < 60
