"""Embedding whitening against LAPACK and whole-number sums, conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from steadyline.llm import repair, whitening
from steadyline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- whitening ------------------------------------------------------------------------------------


def brute_whitening(vectors, k=4):
    size = max(map(len, vectors), default=0)
    x = [[int(np.floor(256 * float(c))) for c in v] + [0] * (size - len(v)) for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[v - s / n for v, s in zip(row, sums)] for row in fit])
    e, p = np.linalg.eigh(centred.T @ centred / n)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    values = (np.array(x) - np.array(sums) / n) @ p / np.sqrt(e)
    return n, [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x], values, e / np.trace(centred.T @ centred / n)


def held(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def whitened_rows(df):
    rows = whitening.whitened(df).collect()
    return sorted(rows, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"]))


def test_whitening_matches_lapack_and_exact_sums(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    rows += [(10_001, rows[0][1], 3)]  # a copy counts once in the fit
    n, away, values, explained = brute_whitening([r[1] for r in rows])
    got = whitened_rows(held(spark, rows))
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::4]] == away
    found = np.array([r["whitened"] for r in got]).reshape(-1, 4)
    signs = np.sign((found * values).sum(0))
    assert np.abs(found * signs - values).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:4]], explained, rtol=1e-12)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_leaves_out_pads_and_saturates(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [1.0, inf], 0)]
    good = [(5, [1.0, 2.0, 3.0], 0), (6, [1.0, -2.0], 0), (None, [], 1), (7, [1e30, 0.5, 0.25], 2), (7, [0.1, 0.7, 0.9], 2)]
    got = whitened_rows(held(spark, bad + good))
    assert {r["vec_id"] for r in got} == {5, 6, 7, None} and {r["n"] for r in got} == {5}
    x = [[256, 512, 768], [256, -512, 0], [0, 0, 0], [2**63 - 1, 128, 64], [25, 179, 230]]
    sums = [sum(c) for c in zip(*x)]
    exact = {str(sum((5 * v - s) ** 2 for v, s in zip(row, sums))) for row in x}
    assert {r["deviation_exact"] for r in got} == exact and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0), (2, [], 0)]])
def test_whitening_without_variance_has_no_components(spark, rows):
    assert whitened_rows(held(spark, rows)) == []


def test_whitening_has_as_many_components_as_directions(spark):
    got = whitened_rows(held(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(6)]))
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_whitening_ignores_extra_columns(spark):
    df = held(spark, [(i, [float(i), float(i * i)], 0) for i in range(5)])
    wide = df.selectExpr("*", "7 as x", "1 as component", "2 as n", "label as e")
    assert whitened_rows(wide) == whitened_rows(df)


@pytest.mark.parametrize("spectrum", [
    [5, 5, 5, 5, 1, 1], [1e9, 1, 1e-3, 0, 0, 0], [4, 4 - 1e-13, 3, 2, 1, 0], list(range(40, 0, -1)), [1] * 12,
])
def test_contours_find_all_pairs(spark, spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum),) * 2))
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    e, p = whitening.components(spark, (v + v.T) / 2)
    wanted = [x for x in sorted(spectrum, reverse=True)[:4] if x > len(v) * 2.3e-16 * max(spectrum)]
    assert len(e) == len(wanted) and np.allclose(e, wanted, rtol=1e-9, atol=1e-13 * max(spectrum))
    assert np.abs(p.T @ p - np.eye(len(e))).max() < 1e-12 and np.abs(v @ p - p * e).max() < 1e-12 * max(spectrum)


def test_inertia_counts_eigenvalues():
    r = np.random.default_rng(9)
    for size in (1, 2, 5, 30):
        v = r.standard_normal((size, size))
        v = v + v.T
        for shift in (-3.0, -0.1, 0.0, 1.0, 4.0):
            assert whitening.below(v, shift) == (np.linalg.eigvalsh(v) < shift).sum()
    assert whitening.below(np.zeros((3, 3)), 0.0) == 0 and whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_packed_vectors_come_back():
    x = np.array([[0, 0, 0], [1, -128, 0], [200, 0, 0], [70_000, 0, 1], [-(1 << 63), 0, (1 << 63) - 1]], np.int64)
    import pyarrow as pa

    keys = whitening.packed(x)
    assert (whitening.unpacked(pa.array(keys, pa.binary()), 3) == x).all() and len(keys[1]) == 3


# ---- repair -----------------------------------------------------------------------------------------


def brute_repair(rows):
    """Per conversation by a search in order of (cost, audit) over all edits."""
    spaced = lambda v: " " if v is None else str(v)
    conversations = {}
    for c, t, r, x in rows:
        own, r, x = conversations.setdefault(c, []), spaced(r), spaced(x)
        kind = zlib.crc32(f"{spaced(c)}:{spaced(t)}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: brute_plan(own) for c, own in conversations.items()}


def brute_plan(rows):
    rows = sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.sha256(q[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, r, x in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    fits = lambda g: re.fullmatch("s?(ua)*u?", g)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        for role in ("user", "assistant"):
            if fits(roles + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*out, (role, ""))))
        if i == len(rows):
            continue
        (_, r, x), stays = rows[i], 5 if faults[i] == "t" else 0
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
        if faults[i] not in ("b", "d"):
            if r[:1] in ("s", "u", "a") and fits(roles + r[:1]):
                heapq.heappush(heap, (cost + stays, audit + "K", i + 1, roles + r[:1], (*out, (r, x))))
            for role in ("user", "assistant"):
                if fits(roles + role[0]):
                    heapq.heappush(heap, (cost + 1 + stays, audit + "R", i + 1, roles + role[0], (*out, (role, x))))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def reported(df):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(repair.damaged(df)).collect()}


def test_repair_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert found == brute_repair(rows)


def test_repair_of_broken_rows(spark):
    draw = random.Random(5)
    rows = [
        (c, draw.choice([None, 0, 1, 2, 3, 4, 5, 6, 9, 12]), draw.choice(["user", "assistant", "system", "tool", None, "", "s"]),
         draw.choice([None, "", "hi.", "yes", "no!", " \n", "ok? ", "a ", "x" * 50_000 + "."]))
        for c in [None, *range(90)] for _ in range(draw.randint(1, 14))
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute_repair(rows)
    assert reported(df) == expected
    assert reported(df.selectExpr("*", "1 as dropped", "2 as initial", "'x' as letter", "3 as cost", "4 as _kind")) == expected
    # what the rows of the general form add up to
    damage = repair.damaged(df)
    planned = repair.plans(repair.signatures(damage.where("not dropped")))
    lines = {}
    for r in sorted(repair.repaired(damage, planned).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, e in expected.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == e[-1]


def test_repair_of_a_conversation_that_holds_most_rows(spark):
    rows = [(1, t, ("user", "assistant", "user", "system")[t % 4], f"text {t % 700}" + ("." if t % 3 else "")) for t in range(3000)]
    rows += [(c, t, ("user", "assistant")[t], "same.") for c in range(2, 300) for t in range(2)]
    assert reported(spark.createDataFrame(rows, SCHEMA)) == brute_repair(rows)


def test_repair_of_nothing(spark):
    assert reported(spark.createDataFrame([], SCHEMA)) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = reported(spark.createDataFrame([(7, dropped, "user", "hi.")], SCHEMA))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_nodes_are_shared_between_conversations(monkeypatch):
    """Each distinct suffix is one node, however many signatures end in it."""
    made, plain = [], repair.node
    monkeypatch.setattr(repair, "node", lambda letter, rest: made.append(letter) or plain(letter, rest))
    signed = ["EIE", "AEIEI", "BEIEI", "EIEI", "AEIEI", "IEI", "H"]
    nodes, last, audits = [repair.END], "", {}
    for s in sorted(signed, key=lambda s: s[::-1]):
        repair.extend(nodes, last, s)
        audits[s], last = repair.audit(nodes, s), s
    assert len(made) == len({s[i:] for s in signed for i in range(len(s))})
    assert audits["AEIEI"] == "KKKKK" and audits["BEIEI"] == "DKKKK" and audits["IEI"] == "DKK" and audits["H"] == "D"
