"""Explanation, queue, follow-up and summaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from steadyline.config import Policy
from steadyline.operators import explain as E, followup as U, queue as R, summary as S
from steadyline.plans import flow

P = Policy()


def d(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(
        [
            ("c1", 1, 7, d(20), 3.5, "high", "v1", "open"), ("c2", 2, 7, d(20), 1.0, "low", "v1", "in_review"),
            ("c3", 3, 8, d(25), 1.0, "low", "v1", "closed"), ("c4", 3, 8, d(5), 2.0, "moderate", "v1", "reopened"),
        ],
        "case_id string, entity_id bigint, group_id int, case_day date, load_z double, level string, "
        "policy_version string, state string",
    )


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(
        [
            (1, d(20), 12, 4.0, 3, 1.0, 2.0, 1, True, 3.0), (2, d(20), 5, 4.0, 0, None, None, 2, False, None),
            (3, d(25), 5, 4.0, 0, 1.0, 0.1, 1, False, 4.0), (3, d(5), 9, 4.0, 0, 1.0, 0.1, 1, False, 4.0),
        ],
        "entity_id bigint, day date, load bigint, load_mean double, errors bigint, errors_mean double, errors_z double, "
        "rest_gap int, busy boolean, load_lagged_mean double",
    )


@pytest.fixture(scope="module")
def found(cases, features):
    return E.factors(cases, features, P).cache()


def test_factors_and_order(cases, found):
    nested = {r["case_id"]: r for r in E.explain_or_absent(cases, found).collect()}
    assert [f["metric"] for f in nested["c1"]["factors"]] == ["errors", "load", "rest", "drift"]
    top = nested["c1"]["factors"][1]
    assert (top["value"], top["reference"], top["window_start"], top["window_end"]) == (12.0, 4.0, d(6), d(19))
    assert nested["c2"]["explanation_status"] == "not_recorded" and nested["c2"]["factors"] is None
    assert nested["c4"]["explanation_status"] == "recorded"


def test_factor_count_and_absence(cases, found, rows):
    assert rows(E.factor_count(cases, found), "case_id", "factors") == [("c1", 4), ("c2", 0), ("c3", 0), ("c4", 1)]
    said = {r["case_id"]: r["surfaced"] for r in R.surfacing_reason(E.explain(cases, found), "nothing new").collect()}
    assert said["c1"] == "errors: errors_above_own_normal" and said["c2"] == "nothing new"


def test_untraceable(found):
    assert E.untraceable(found).count() == 0
    assert E.untraceable(found.withColumn("reference", F.when(F.col("metric") != "rest", F.col("reference")))).count() == 1


def test_policy_intervals(spark, cases, rows):
    policies = spark.createDataFrame(
        [("v1", d(6), d(20)), ("v2", d(20), None)], "policy_version string, valid_from date, valid_to date"
    )
    got = rows(E.policy_at(cases, policies, F.lit(d(25))), "case_id", "valid_version")
    assert got == [("c1", "v2"), ("c2", "v2"), ("c3", "v2"), ("c4", None)]


def test_overlapping_policies_are_refused(spark, cases):
    policies = spark.createDataFrame(
        [("v1", d(6), d(21)), ("v2", d(20), None)], "policy_version string, valid_from date, valid_to date"
    )
    with pytest.raises(Exception, match="several policies are valid on 2024-01-21"):
        E.policy_at(cases, policies, F.lit(d(25))).collect()


def test_queue_order_scope_and_limit(spark, cases):
    assert [r["case_id"] for r in R.queue(cases).collect()] == ["c3", "c1", "c2", "c4"]
    accounts = spark.createDataFrame(
        [("a", "reviewer", ["support"], [7])], "account_id string, role string, purposes array<string>, groups array<int>"
    )
    matrix = spark.createDataFrame([("reviewer", "support")], "role string, purpose string")
    assert [r["case_id"] for r in R.queue_for(cases, "a", accounts, matrix, "support", 1).collect()] == ["c1"]
    assert R.queue_for(cases, "a", accounts, matrix.limit(0), "support", 1).count() == 0


def test_staleness_header_drift(spark, cases):
    stale = {r["case_id"]: r["chip"] for r in R.staleness(cases, F.lit(d(27)), P, flow.OLDER).collect()}
    assert stale["c1"] is None and stale["c4"] == "older data: 22 days"
    one = spark.range(1).select(F.lit(3).alias("n"))
    assert tuple(R.queue_header(cases, one, one).first()) == (3, 1, 3, 3)
    flags = spark.createDataFrame(
        [(1, d(20), True), (1, d(21), False), (1, d(22), None), (3, d(25), True)], "entity_id bigint, day date, material boolean"
    )
    out = {r["case_id"]: (r["signal_day"], r["signal"], r["differs"]) for r in R.signal_drift(cases, flags).collect()}
    assert out["c1"] == (d(21), False, True) and out["c3"] == (d(25), True, False) and out["c2"] == (None, None, False)


def ts(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def test_feasibility(spark, cases, rows):
    duties = spark.createDataFrame(
        [
            (1, ts(20, 8), ts(21)),  # ends at midnight: day 21 stays free
            (2, ts(21, 8), ts(21, 9)), (2, ts(21, 8), ts(21, 9)),
            (3, ts(26, 8), ts(28, 9)),
            (3, ts(6), ts(6)),  # empty
        ],
        "entity_id bigint, start_ts timestamp_ntz, end_ts timestamp_ntz",
    )
    got = rows(U.feasibility(cases, U.duty_days(duties), flow.FEASIBILITY), "case_id", "busy_days", "feasibility")
    assert got == [("c1", 0, "now"), ("c2", 1, "with_adjustment"), ("c3", 3, "constrained"), ("c4", 0, "now")]


def test_options_and_next_step(spark, cases, found):
    options = U.support_options(found, U.mapping_table(found, flow.SUPPORT_MAPPING))
    by_case = {r["case_id"]: r["options"] for r in options.collect()}
    assert by_case == {"c1": ["offer_practice_time", "review_workload", "schedule_free_day"], "c4": ["review_workload"]}
    feasible = spark.createDataFrame([("c2", "now")], "case_id string, feasibility string")
    steps = {r["case_id"]: r["next_step"] for r in U.next_step(cases, options, feasible, flow.FEASIBILITY).collect()}
    assert steps == {"c1": "acknowledge", "c2": "talk_first", "c3": "none", "c4": "acknowledge"}


def test_followups(spark, rows):
    f = spark.createDataFrame(
        [(1, 1, d(5), None), (2, 1, d(4), None), (3, 2, d(9), None), (4, 2, d(3), d(4)), (5, 3, d(3), d(3)), (6, 3, None, None)],
        "followup_id int, entity_id bigint, due date, done date",
    )
    status = U.followup_status(f, F.lit(d(5)))
    assert [r[1] for r in rows(status, "followup_id", "status")] == ["due", "overdue", "upcoming", "done_late", "done", "unscheduled"]
    queue = spark.createDataFrame([(1,), (3,)], "entity_id bigint")
    assert rows(U.requeue(queue, status)) == [(1, "case", 3), (3, "case", 1)]
    roster = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "entity_id bigint, group_id int")
    assert rows(U.follow_through(f, roster)) == [(7, 4, 4, 1, 0), (8, 2, 1, 1, 1)]


def test_summaries(spark, cases, rows):
    roster = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "entity_id bigint, group_id int")
    feasible = spark.createDataFrame([("c3", "constrained"), ("c1", "now")], "case_id string, feasibility string")
    assert rows(S.group_summary(roster, cases, feasible)) == [(7, 2, 2, 0), (8, 1, 1, 1), (9, 1, 0, 0)]
    assert rows(S.concentration(cases)) == [(7, 2, 0.5), (8, 2, 0.5)]
    groups = spark.createDataFrame([(7, "g7", "A"), (8, "g8", "A"), (9, "g9", "B")], "group_id int, group_name string, region_name string")
    totals = {(r["region_name"], r["group_name"]): (r["cases"], r["high"]) for r in S.dashboard(cases, groups).collect()}
    assert totals[("A", None)] == (4, 1) and totals[(None, None)] == (4, 1) and totals[("B", "g9")] == (0, 0)
    panel = spark.createDataFrame(
        [(7, d(0), 5, 1), (7, d(1), None, None), (7, d(7), 3, 0)], "group_id int, day date, load bigint, errors bigint"
    )
    assert rows(S.group_trend(panel)) == [(7, d(0), 5, 1, 1, None), (7, d(7), 3, 0, 1, 5.0)]


def test_timeline_keeps_every_day(spark, cases):
    flags = spark.createDataFrame(
        [(1, d(19), None, None, None), (1, d(20), 12, 3.5, True)], "entity_id bigint, day date, load bigint, load_z double, material boolean"
    )
    out = {r["day"]: r["case_id"] for r in S.timeline(flags, cases).collect()}
    assert out == {d(19): None, d(20): "c1"}
