"""As-of join against a search in plain Python: a hot key, ties, NULLs, several chunks."""

import random

import pytest

from steadyline.operators.asof import asof_join


@pytest.mark.parametrize("strict", [False, True])
def test_last_row_up_to_each_time(spark, strict):
    draw = random.Random(6)
    key = lambda: draw.choice([7, 7, 7, 1, 2, None])
    time = lambda: draw.choice([None, *range(60), *range(60)])
    left = [(key(), time(), i, f"l{i}") for i in range(400)]
    right = [(key() if i % 9 else 3, time(), i, None if i % 5 == 0 else i * 10) for i in range(300)]
    got = asof_join(
        spark.createDataFrame(left, "k int, t int, i bigint, note string"), spark.createDataFrame(right, "k int, u int, j bigint, v bigint"),
        ["k"], "t", "u", "i", "j", ["j", "v"], strict=strict,
    )
    assert got.columns == ["k", "t", "i", "note", "asof_j", "asof_v"]
    found = {r["i"]: (r["note"], r["asof_j"], r["asof_v"]) for r in got.collect()}
    for k, t, i, note in left:
        fits = [r for r in right if None not in (k, t, r[1]) and r[0] == k and (r[1] < t if strict else r[1] <= t)]
        best = max(fits, key=lambda r: (r[1], r[2]), default=(None, None, None, None))
        assert found[i] == (note, best[2], best[3])
    assert len(found) == len(left)


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, 5, 0)], "k int, t int, i int")
    right = spark.createDataFrame([(1, 4, 9)], "k int, u int, j int")
    assert [tuple(r) for r in asof_join(left, right.limit(0), ["k"], "t", "u", "i", "j", ["u"]).collect()] == [(1, 5, 0, None)]
    assert asof_join(left.limit(0), right, ["k"], "t", "u", "i", "j", ["u"]).count() == 0
