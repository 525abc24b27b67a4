"""Ordered operators and log replay against plain Python, with one key holding a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from steadyline.functions import ordered
from steadyline.functions.ordered import Ordered
from steadyline.operators import workflow as W
from steadyline.plans import flow


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(40)}")
        data.append((key, rng.randrange(300), i, rng.randrange(10)))
    return data, spark.createDataFrame(data, "key string, ts int, id int, v bigint").cache()


def expected(data, reverse=False):
    """Per id: (row number, running sum, previous value) within the key."""
    out, state = {}, {}
    for key, ts, i, v in sorted(data, key=lambda r: (-r[1] if reverse else r[1], r[2])):
        n, total, previous = state.get(key, (0, 0, None))
        state[key] = (n + 1, total + v, v)
        out[i] = (n + 1, total + v, previous)
    return out


def test_spreads_the_hot_key(hot):
    run = Ordered(hot[1], ["key"], ["ts", "id"])
    assert run.df.filter("key = 'hot'").select(ordered.CHUNK).distinct().count() > 1


def test_row_number_running_sum_previous(hot):
    data, df = hot
    want = expected(data)
    run = Ordered(df, ["key"], ["ts", "id"])
    assert {r["id"]: r["n"] for r in run.row_number("n").collect()} == {i: w[0] for i, w in want.items()}
    assert {r["id"]: r["s"] for r in run.running_sums({"s": "v"}).collect()} == {i: w[1] for i, w in want.items()}
    assert {r["id"]: r["p"] for r in run.previous("v", "p").collect()} == {i: w[2] for i, w in want.items()}


def test_descending_order_and_no_key(hot):
    data, df = hot
    want = expected([("all", *r[1:]) for r in data], reverse=True)
    got = Ordered(df, [], [F.desc("ts"), "id"]).row_number("n").collect()
    assert {r["id"]: r["n"] for r in got} == {i: w[0] for i, w in want.items()}


def brute_replay(log, codes):
    edges = {(a, s): t for a, s, t in flow.TRANSITIONS}
    out, state = {}, {}
    for case, ts, seq, action, want, reason in sorted(log, key=lambda r: (r[1], r[2])):
        now = state.get(case, "open")
        to, refusal = now, None
        if reason not in codes:
            refusal = "missing_reason"
        elif want is not None and want != now:
            refusal = "conflict"
        elif (action, now) not in edges:
            refusal = "invalid_transition"
        else:
            to = edges[(action, now)]
        state[case] = to
        out[seq] = (now, to, refusal is None, refusal)
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    actions = sorted({t[0] for t in flow.TRANSITIONS})
    return [
        (
            1 if i % 3 == 0 else rng.randrange(2, 12), rng.randrange(200), i, rng.choice(actions),
            rng.choice(flow.STATES) if rng.random() < 0.2 else None, rng.choice(["R1", "R1", "R1", None, "bad"]),
        )
        for i in range(700)
    ]


SCHEMA = "case_id int, ts int, seq int, action string, expected_state string, reason_code string"


@pytest.mark.parametrize("block", [1, 3, 256])
def test_replay_matches_row_by_row(spark, log, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    got = W.replay(spark.createDataFrame(log, SCHEMA), flow.STATES, flow.TRANSITIONS, ["R1"]).collect()
    want = brute_replay(log, {"R1"})
    assert {r["seq"]: (r["from_state"], r["to_state"], r["accepted"], r["refusal"]) for r in got} == want
    assert len(got) == len(log)


def test_states_history_conflicts_reopens(spark, log):
    replayed = W.replay(spark.createDataFrame(log, SCHEMA).withColumn("role", F.lit("r")), flow.STATES, flow.TRANSITIONS, ["R1"]).cache()
    want = brute_replay(log, {"R1"})
    last = {}
    for case, ts, seq, *_ in sorted(log, key=lambda r: (r[1], r[2])):
        last[case] = want[seq][1]
    assert {r["case_id"]: r["state"] for r in W.current_states(replayed).collect()} == last
    steps = {}
    for r in W.history(replayed).collect():
        steps.setdefault(r["case_id"], []).append(r["step"])
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in steps.values())
    assert sum(map(len, steps.values())) == sum(w[2] for w in want.values())
    assert {r["seq"] for r in W.conflicts(replayed).collect()} == {s for s, w in want.items() if w[3] == "conflict"}
    # a refused action changes nothing
    assert W.invalid_actions(replayed).filter("from_state <> to_state").count() == 0
    closed = sum(r["closed_times"] for r in W.reopens(replayed).collect())
    assert closed == sum(w[2] and w[1] == "closed" for w in want.values())


def test_full_path_and_second_writer(spark):
    path = ["acknowledge", "start_review", "progress_support", "progress_support", "close", "reopen", "acknowledge"]
    rows = [(1, i, i, a, None, "R1") for i, a in enumerate(path)] + [(1, 7, 7, "start_review", "open", "R1")]
    got = W.replay(spark.createDataFrame(rows, SCHEMA), flow.STATES, flow.TRANSITIONS).orderBy("seq").collect()
    assert [r["to_state"] for r in got][:7] == [
        "acknowledged", "in_review", "support_planned", "support_completed", "closed", "reopened", "acknowledged",
    ]
    assert (got[7]["accepted"], got[7]["refusal"], got[7]["to_state"]) == (False, "conflict", "acknowledged")


def test_feedback_is_idempotent(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 1, 1, "x"), (1, "a", 2, 2, "y"), (1, "b", 3, 3, "x"), (2, "a", 1, 4, "z")],
        "case_id int, idempotency_key string, ts int, seq int, text string",
    )
    once = rows(W.feedback(df))
    assert once == rows(W.feedback(df.unionByName(df))) and len(once) == 3
    assert (1, "a", 1, 1, "x") in once


def test_feedback_without_a_key_is_no_replay(spark, rows):
    df = spark.createDataFrame(
        [(1, None, 1, 1, "first"), (1, None, 2, 2, "second"), (1, "a", 3, 3, "x"), (1, "a", 4, 4, "x")],
        "case_id int, idempotency_key string, ts int, seq int, text string",
    )
    assert [r[4] for r in rows(W.feedback(df))] == ["x", "first", "second"]


def test_missing_reason_and_drift(spark, rows, log):
    df = spark.createDataFrame(log, SCHEMA)
    codes = spark.createDataFrame([("R1",)], "reason_code string")
    assert W.missing_reason(df, codes).count() == sum(r[5] != "R1" for r in log)
    a = W.transition_table(df, flow.TRANSITIONS)
    assert W.graph_drift(a, a).count() == 0
    b = W.transition_table(df, flow.TRANSITIONS[1:])
    assert rows(W.graph_drift(a, b)) == [("acknowledge", "open", "acknowledged", "first")]
