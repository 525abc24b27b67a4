"""Cut points against a plain sort: many ties, a hot group, infinite and missing scores, ids beyond a double's precision."""

import random

import pytest
from pyspark.sql import functions as F

from steadyline.operators import selection as S

INF = float("inf")


def worth(s):
    return -INF if s is None or s != s else s


def found(spark, rows, cuts, **kw):
    df = spark.createDataFrame(rows, "g string, score double, id long").withColumn("id", F.col("id").cast("decimal(20,0)"))
    points = S.cut_points(df, spark.createDataFrame(cuts, "g string, k bigint"), "g", "score", "id", **kw)
    return {(r["g"], r["k"]): int(r["id"]) for r in points.collect()}


def expected(rows, cuts):
    out = {}
    for g, k in cuts:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-worth(r[1]), r[2]))
        if 1 <= k <= len(own):
            out[g, k] = own[k - 1][2]
    return out


@pytest.mark.parametrize("bins, left", [(1024, 1 << 16), (1024, 40), (4, 1), (16, 3)])
def test_cut_points_match_a_sort(spark, bins, left):
    draw = random.Random(bins)
    ids = draw.sample(range(10**6), 3000)
    kinds = [lambda: draw.gauss(0, 1), lambda: float(draw.randint(0, 3)), lambda: draw.choice([INF, -INF, None, float("nan"), 1.0]), lambda: draw.choice([1e308, -1e308, 5e-324, 0.0])]
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice(kinds)(), i) for i in ids]
    cuts = [(g, k) for g in ("a", "b", None, "none") for k in (1, 2, 60, 400, 599, 1500, 5000, 0)]
    assert found(spark, rows, cuts, bins=bins, left=left) == expected(rows, cuts)


def test_one_score_for_all(spark):
    rows = [("a", 2.0, 2**60 + i) for i in range(500)]  # ids that one double stands for many of
    cuts = [("a", k) for k in (1, 77, 500)]
    assert found(spark, rows, cuts, bins=8, left=2) == expected(rows, cuts)


def test_no_rows_no_cuts(spark):
    assert found(spark, [], [("a", 1)]) == {} and found(spark, [("a", 1.0, 1)], []) == {}


def test_rows_at_or_before_the_cut(spark):
    rows = [(1.0, 1), (1.0, 2), (None, 3), (0.5, 4), (float("nan"), 5)]
    df = spark.createDataFrame(rows, "score double, id long")
    at = lambda s, i: sorted(r["id"] for r in df.withColumns({"_s": F.lit(s).cast("double"), "_t": F.lit(i)}).where(S.among_strongest("score", "id", "_s", "_t")).collect())
    assert at(1.0, 1) == [1] and at(0.5, 4) == [1, 2, 4] and at(None, 3) == [1, 2, 3, 4] and at(None, 5) == [1, 2, 3, 4, 5]
