import datetime as dt
import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from steadyline.config import Policy
from steadyline.operators import labels as L, models as M, ranking as K

P = Policy()


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [(i, rng.randrange(12) / 4, rng.random(), int(rng.random() < 0.35)) for i in range(513)]


@pytest.fixture(scope="module")
def ranked(spark, data):
    df = spark.createDataFrame(data, "row_id bigint, tied double, fine double, label int")
    return K.by_strategy(df, ["tied", "fine"]).cache()


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_exact_with_ties(data, ranked):
    got = {r["strategy"]: r["auc"] for r in K.roc_auc(K.sweep(ranked)).collect()}
    assert got["tied"] == pytest.approx(auc([(r[1], r[3]) for r in data]), abs=1e-6)
    assert got["fine"] == pytest.approx(auc([(r[2], r[3]) for r in data]), abs=1e-6)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert got["fine"] == pytest.approx(ev.evaluate(ranked.filter("strategy = 'fine'")), abs=1e-6)


def test_average_precision(data, ranked):
    got = {r["strategy"]: r["average_precision"] for r in K.average_precision(K.sweep(ranked)).collect()}
    for col, name in ((1, "tied"), (2, "fine")):
        total, want, hits, seen = sum(r[3] for r in data), 0.0, 0, 0
        for t in sorted({r[col] for r in data}, reverse=True):
            group = [r[3] for r in data if r[col] == t]
            hits, seen = hits + sum(group), seen + len(group)
            want += sum(group) / total * hits / seen
        assert got[name] == pytest.approx(want, abs=1e-6)


def test_precision_at_capacity_and_compare(data, ranked):
    at = K.precision_at(ranked, [1, 2, 5, 10])
    got = {(r["strategy"], r["percent"]): (r["k"], r["precision"]) for r in at.collect()}
    for col, name in ((1, "tied"), (2, "fine")):
        order = sorted(data, key=lambda r: (-r[col], r[0]))
        for p in (1, 2, 5, 10):
            k = math.ceil(p * len(data) / 100)
            assert got[(name, p)] == (k, pytest.approx(sum(r[3] for r in order[:k]) / k, abs=1e-6))
    table = {r["strategy"]: r for r in K.compare(at, [1, 10]).collect()}
    assert table["fine"]["top_10"] == got[("fine", 10)][1]


def test_capacity_is_rounded_up(spark):
    df = spark.range(5098).select(F.col("id").alias("row_id"), F.lit("s").alias("strategy"), F.lit(1.0).alias("score"), F.lit(1).alias("label"))
    assert sorted(r["k"] for r in K.precision_at(df, [1, 2, 5, 10]).collect()) == [51, 102, 255, 510]


def test_f1_sweep_and_choice(data, ranked):
    f1 = {r["strategy"]: r for r in K.f1_at(ranked, {"tied": 1.0}).collect()}["tied"]
    tp = sum(r[3] for r in data if r[1] >= 1.0)
    fp = sum(1 - r[3] for r in data if r[1] >= 1.0)
    fn = sum(r[3] for r in data if r[1] < 1.0)
    assert (f1["tp"], f1["fp"], f1["fn"]) == (tp, fp, fn) and f1["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn), abs=1e-6)
    swept = K.sweep(ranked)
    same = swept.filter("strategy = 'tied' and threshold = 1.0").first()
    assert (same["f1"], same["precision"], same["recall"]) == (f1["f1"], f1["precision"], f1["recall"])
    chosen = K.select_threshold(swept, 0.3)
    assert chosen.count() == swept.count()
    best = chosen.filter("chosen and strategy = 'tied'").collect()
    assert len(best) == 1 and best[0]["meets_floor"]
    assert best[0]["recall"] == chosen.filter("meets_floor and strategy = 'tied'").agg(F.max("recall")).first()[0]
    assert K.select_threshold(swept, 1.1).filter("chosen").count() == 0


def test_one_class_only(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(1, 0.2, label), (2, 0.3, label)], "row_id bigint, score double, label int").withColumn("strategy", F.lit("s"))
        assert K.roc_auc(K.sweep(df)).first()["auc"] is None


def d(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_label_edges(spark):
    data = [(1, d(i), (d(i) - dt.date(1970, 1, 1)).days) for i in range(20)]
    panel = spark.createDataFrame(data, "entity_id bigint, day date, day_no int")
    reports = spark.createDataFrame([(1, d(9), 4), (1, d(2), 1)], "entity_id bigint, day date, reports bigint")
    got = {r["day"]: (r["label"], r["full_horizon"]) for r in L.forward_label(panel, reports, F.lit(d(19)), P).collect()}
    assert got[d(1)] == (0, True)  # day 2 is tomorrow, day 9 is 8 days away
    assert got[d(2)] == (1, True)  # day 9 is exactly 7 days away; the report of the day itself does not count
    assert got[d(8)] == (1, True) and got[d(9)] == (None, True)
    assert got[d(12)][1] and not got[d(13)][1]
    cover = L.label_coverage(L.forward_label(panel, reports, F.lit(d(19)), P)).first()
    assert (cover["entity_days"], cover["usable"], cover["excluded"]) == (20, 9, 11)


def test_split_keeps_days_whole_and_in_order(spark):
    data = [(i, d(i // 10 if i < 90 else 9 + i % 3)) for i in range(120)]
    out = L.time_split(spark.createDataFrame(data, "id int, day date"))
    per_day = {}
    for r in out.collect():
        per_day.setdefault(r["day"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per_day.values())
    order = [next(iter(per_day[k])) for k in sorted(per_day)]
    assert order == sorted(order, key=["train", "validation", "test"].index) and set(order) == {"train", "validation", "test"}


def test_peek_is_noticed(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, d(i), i) for i in range(10)], "entity_id bigint, day date, v int")
    w = Window.partitionBy("entity_id").orderBy("day")
    cut = F.lit(d(5))
    assert L.peek_differences(df, lambda x: x.withColumn("f", F.lag("v").over(w)), cut).count() == 0
    assert L.peek_differences(df, lambda x: x.withColumn("f", F.lead("v").over(w)), cut).count() == 2


def test_models_rank_and_shrink(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        z = rng.gauss(0, 1)
        data.append((i, z, None if i % 9 == 0 else rng.gauss(0, 1), rng.gauss(0, 1), 1, int(z + rng.gauss(0, 0.7) > 0)))
    df = spark.createDataFrame(data, "row_id bigint, load_z double, errors_z double, load_slope7 double, rest_gap int, label int")
    plain, penalised = M.fit_logreg(df, 0.0), M.fit_logreg(df, 0.5)
    assert abs(plain.stages[-1].coefficients[0]) > abs(penalised.stages[-1].coefficients[0]) > 0
    scored = M.model_score(df, plain)
    assert scored.columns == df.columns + ["model_score"]
    assert K.roc_auc(K.sweep(K.by_strategy(scored, ["model_score"]))).first()["auc"] > 0.8
