"""Baselines, materiality, persistence, recovery, repeats and capacity on small panels."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from steadyline.config import Policy
from steadyline.operators import baselines as B, panel, signals as A
from steadyline.plans import flow

D0 = dt.date(2024, 1, 1)
P = Policy()


def day(i):
    return D0 + dt.timedelta(days=i)


def series(spark, values, group=1):
    """{entity: [load or None, ...]} as a dense panel; entity 99 keeps its own group steady."""
    data = [
        (e, group, day(i), (day(i) - dt.date(1970, 1, 1)).days, v, 0 if v is not None else None)
        for e, vs in values.items()
        for i, v in enumerate(vs)
    ]
    df = spark.createDataFrame(data, "entity_id bigint, group_id int, day date, day_no int, load bigint, errors bigint")
    return df


def judged(spark, values, policy=P):
    # each entity in a group with many steady others: the group context is then close to zero change
    quiet = {1000 + i: [4] * 30 for i in range(20)}
    dense = series(spark, {**values, **quiet})
    return A.material(flow.features(flow.with_context(dense, dense, policy), policy), "load", policy)


BASE = [4, 3, 4, 4, 3, 4, 4, 3, 4, 4]


def test_spine_keeps_gaps_null(spark, rows):
    days = spark.createDataFrame([(1, day(0), 3), (1, day(2), 5)], "entity_id bigint, day date, load bigint")
    roster = spark.createDataFrame([(1, 7), (2, 7)], "entity_id bigint, group_id int")
    out = panel.spine(days, roster, F.lit(day(0)), F.lit(day(2)))
    assert rows(out, "entity_id", "load") == [(1, 3), (1, 5), (1, None), (2, None), (2, None), (2, None)]


def test_entity_days_counts(spark, rows):
    r = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 0, 0)), (1, dt.datetime(2024, 1, 1, 23, 59)), (1, dt.datetime(2024, 1, 2))],
        "entity_id bigint, ts timestamp_ntz",
    )
    assert rows(panel.entity_days(r, {"load": F.count("*")})) == [(1, day(0), 2), (1, day(1), 1)]


def test_baseline_leaves_today_out_and_needs_enough_days(spark):
    dense = series(spark, {1: [2, 4, 2, 4, 3, 100, 3]})
    out = {r["day"]: r for r in B.personal_baseline(dense, "load", P, median=True).collect()}
    assert out[day(4)]["load_mean"] is None and out[day(4)]["load_n"] == 4
    assert out[day(5)]["load_mean"] == 3.0 and out[day(5)]["load_sd"] == 1.0 and out[day(5)]["load_median"] == 3.0


def test_baseline_window_is_calendar_days(spark):
    values = [1] * 5 + [None] * 12 + [9]
    out = {r["day"]: r for r in B.personal_baseline(series(spark, {1: values}), "load", P).collect()}
    assert out[day(17)]["load_n"] == 2  # only days 3 and 4 are within 14 days


def test_lagged_baseline_sees_drift(spark):
    dense = series(spark, {1: [2] * 15 + [4] * 10})
    out = {r["day"]: r for r in B.lagged_baseline(dense, "load", P).collect()}
    assert out[day(24)]["load_lagged_mean"] < 3


def test_group_context_absorbs_a_common_rise(spark):
    alike = {i: BASE + [9] * 3 for i in range(5)}
    dense = series(spark, alike)
    out = A.material(flow.features(flow.with_context(dense, dense, P), P), "load", P)
    assert out.filter("material").count() == 0
    alone = judged(spark, {1: BASE + [9] * 3})
    assert alone.filter("entity_id = 1 and material").count() == 3


def found(flagged, policy=P):
    return flow.found(flagged, policy).filter("entity_id < 1000")


def test_one_day_spike_opens_nothing(spark):
    assert found(judged(spark, {1: BASE + [12] + [4] * 5})).count() == 0


def test_rise_with_gap_and_constant_history(spark, rows):
    flagged = judged(spark, {1: BASE + [12, None, 13, 4, 4], 2: [4] * 10 + [7, 8, 4, 4], 3: [4, 4, 9, 9]})
    got = rows(found(flagged), "entity_id", "start_day", "end_day", "length", "case_day", "recovered_day")
    # the unobserved day neither breaks the run nor counts; too short a history (3) is never judged
    assert got == [
        (1, day(10), day(12), 2, day(12), day(14)),
        (2, day(10), day(11), 2, day(11), day(13)),
    ]
    assert flagged.filter("entity_id = 3 and material is not null").count() == 0


def test_null_day_is_not_judged(spark):
    flagged = judged(spark, {1: BASE + [None]})
    assert flagged.filter(f"entity_id = 1 and day = '{day(10)}'").first()["material"] is None


def test_features_lag_gap_slope_busy(spark):
    dense = series(spark, {1: [1, 2, 3, None, 5, 6, 7]})
    out = {r["day"]: r for r in B.temporal_features(dense, "load", 3).collect()}
    assert out[day(4)]["rest_gap"] == 2 and out[day(4)]["load_prev"] == 3 and not out[day(4)]["busy"]
    assert out[day(2)]["busy"] and out[day(6)]["load_slope7"] == 1.0 and out[day(3)]["rest_gap"] is None


def test_trend(spark):
    df = series(spark, {1: [1] * 8}).withColumn("load_z", F.when(F.col("day") == day(7), 2.0).otherwise(0.0))
    out = {r["day"]: r["trend"] for r in B.entity_trend(df, "load").collect()}
    assert out[day(7)] == "rising" and out[day(0)] == "unknown"


def candidates(spark, items):
    """(entity, day offset, score, recovered offset or None)"""
    data = [(e, 1, day(d), s, None if r is None else day(r), f"id-{e}-{d}") for e, d, s, r in items]
    return spark.createDataFrame(
        data, "entity_id bigint, group_id int, case_day date, score double, recovered_day date, case_id string"
    )


def test_repeats_depend_on_the_last_kept(spark, rows):
    df = candidates(spark, [(1, 0, 1.0, None), (1, 5, 1.0, None), (1, 9, 1.0, None), (1, 16, 1.0, None), (1, 17, 1.0, None)])
    out = rows(A.mark_repeats(df, P), "case_day", "repeat")
    # 5 falls to 0; 9 is kept, being 9 days after 0; 16 falls to 9; 17 is kept, although 16 came right before
    assert out == [(day(0), False), (day(5), True), (day(9), False), (day(16), True), (day(17), False)]


def test_budget_ties_by_id_and_ledger_is_the_complement(spark, rows):
    items = [(i, 0, 2.0, None) for i in range(6)] + [(10, 0, 9.0, 1), (11, 0, 1.0, 9), (11, 3, 1.0, None)]
    df = candidates(spark, items)
    cases, ledger = A.admit(df, P)
    assert rows(cases, "case_id") == [("id-0-0",), ("id-1-0",)]
    reasons = {r["case_id"]: r["reason"] for r in ledger.collect()}
    assert reasons["id-10-0"] == "recovered" and reasons["id-11-3"] == "cooldown" and reasons["id-5-0"] == "capacity"
    assert cases.count() + ledger.count() == len(items) == len(reasons) + 2


@pytest.mark.parametrize("k", [2, 1000, 1001])
def test_budget_for_any_k_on_one_hot_day(spark, k):
    days = F.when(F.col("id") < 1500, F.lit(0)).otherwise(F.col("id") % 3)
    df = spark.range(1600).select(
        F.date_add(F.lit(day(0)), days.cast("int")).alias("case_day"), (F.col("id") % 7).cast("double").alias("score"), F.format_string("c%05d", "id").alias("case_id")
    )
    got = A.budget(df, k)
    assert "Window" in got._jdf.queryExecution().executedPlan().toString()
    kept = {(r["case_day"], r["case_id"]): r["rank"] for r in got.collect()}
    per_day = {}
    for r in df.collect():
        per_day.setdefault(r["case_day"], []).append((-r["score"], r["case_id"]))
    want = {(d, c): i + 1 for d, own in per_day.items() for i, (_, c) in enumerate(sorted(own)[:k])}
    assert kept == want


def test_entities_without_a_dimension_row_stay(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("events", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("true" if name == "events" else "c_custkey % 3 <> 0").write.parquet(f"{tmp_path}/{name}.parquet")
    of, whole = flow.base(spark, str(tmp_path)), flow.base(spark, sf)
    assert of.dense.count() == whole.dense.count() and of.observed.count() == whole.observed.count()
    assert of.dense.filter("group_id is null").select("entity_id").distinct().count() == whole.dense.filter("entity_id % 3 = 0").select("entity_id").distinct().count() > 0
    flags = flow.flags(of, P)
    assert flags.filter("group_id is null and load_dev is not null").count() > 0


def test_the_panel_is_shuffled_once(spark):
    """With broadcasts off, rows of entities and days meet one exchange, by entity."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flow.flags(flow.base(spark, "/root/testdata/sf0.001"), P)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lines = plan.split("\n")
    by_entity = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(entity_id#" in x and "group_id" not in x]
    assert len(by_entity) == 1 and "Union" in "".join(lines[by_entity[0] + 1 : by_entity[0] + 3])
    for i, x in enumerate(lines):
        keys = x.partition("Exchange hashpartitioning(")[2]
        if "day#" in keys:  # only groups by day, summed up or one row for each
            assert "entity_id" not in keys and "entity_id" not in lines[i + 1], x


def test_case_id_vector(spark):
    got = spark.range(1).select(A.case_id(F.lit(42), F.lit("2024-01-05").cast("date"), "v1").alias("i")).first()["i"]
    assert got == hashlib.sha256(b"42#2024-01-05#v1").hexdigest()


def test_burden_and_levels(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (False,)], "material boolean")
    r = A.burden(df).first()
    assert (r["judged"], r["flagged"], r["share"]) == (3, 1, 0.333333)
    z = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "z double")
    assert [x[0] for x in z.select(A.concern_level(F.col("z"), P)).collect()] == ["low", "moderate", "high"]


def test_rest_gap_across_chunks(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(1 if i % 3 else i % 5, base + dt.timedelta(minutes=7 * i), i) for i in range(200)]
    got = {r["event_id"]: r["gap_hours"] for r in B.rest_gaps(spark.createDataFrame(data, "entity_id int, ts timestamp_ntz, event_id int")).collect()}
    last = {}
    for e, ts, i in data:
        gap = None if e not in last else round((ts - last[e]).total_seconds() / 3600, 6)
        assert got[i] == pytest.approx(gap)
        last[e] = ts


def test_reports_never_reach_the_panel(spark):
    """A report-only day must stay unobserved."""
    sf = "/root/testdata/sf0.001"
    assert flow.records(spark, sf).filter("event_type = 'signup'").count() == 0
    observed = flow.base(spark, sf).dense.filter("load is not null").count()
    assert observed == flow.records(spark, sf).select("entity_id", F.to_date("ts")).distinct().count()
