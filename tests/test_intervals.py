"""Interval joins against nested loops: lengths from one to millions, a hot key, ends that touch, rows that hold nothing."""

import random

import pytest
from pyspark.sql import functions as F

from steadyline.operators import intervals as I


def spans(draw, n, longest, hot=0.4):
    out = []
    for i in range(n):
        start = draw.randrange(longest * 5)
        length = draw.choice([0, 1, 2, 59, 60, 61, 3600, draw.randrange(1, longest), -5])
        out.append((draw.choice([1, 2, None]) if draw.random() > hot else 7, i, None if draw.random() < 0.03 else start, start + length))
    return out


def overlapping(a, b):
    real = lambda r: r[0] is not None and r[2] is not None and r[3] > r[2]
    return sorted((x[1], y[1]) for x in a for y in b if real(x) and real(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


@pytest.mark.parametrize("unit, longest", [(1, 300), (60, 100_000), (3600, 4_000_000)])
def test_overlaps_match_nested_loops(spark, unit, longest):
    draw = random.Random(unit)
    a, b = spans(draw, 150, longest), spans(draw, 200, longest)
    left = spark.createDataFrame(a, "k int, a bigint, s bigint, e bigint")
    right = spark.createDataFrame(b, "k int, b bigint, bs bigint, be bigint")
    got = I.overlap_join(left, right, ["k"], ("s", "e"), ("bs", "be"), unit)
    found = sorted((r["a"], r["b"]) for r in got.collect())
    assert found == overlapping(a, b) and len(found) > 20
    assert got.where(I.overlap_length(("s", "e"), ("bs", "be")) <= 0).count() == 0


def test_points_on_ends(spark):
    spans_ = spark.createDataFrame([(1, 10, 20), (1, 20, 20), (1, 20, 21)], "k int, s bigint, e bigint")
    points = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (1, None), (None, 15)], "k int, p bigint")
    at = lambda **kw: sorted((r["s"], r["p"]) for r in I.stabbing_join(spans_, points, ["k"], "s", "e", "p", 3, **kw).collect())
    assert at() == [(10, 10), (10, 19), (20, 20)] and at(after_start=True) == [(10, 19)]
    assert I.stabbing_join(spans_.limit(0), points, ["k"], "s", "e", "p", 3).count() == 0


def test_a_long_interval_is_few_rows(spark):
    rows = spark.range(1).select(F.lit(3).cast("bigint").alias("s"), F.lit(3 + 10**9).cast("bigint").alias("e"))
    height = I._height(rows, F.col("s"), F.col("e"))
    blocks = rows.select(F.explode(I._blocks(F.col("s"), F.col("e"), height)).alias("b")).select("b.*").collect()
    assert len(blocks) < 2 * (I.BASE - 1) * (height + 1)
    covered = sorted((r["block"] * I.BASE ** r["level"], (r["block"] + 1) * I.BASE ** r["level"]) for r in blocks)
    assert covered[0][0] == 3 and covered[-1][1] == 3 + 10**9 and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
