"""Digest trees: the same answer as a full comparison, however keys are shared out, and few rows read."""

import pytest
from pyspark.sql import functions as F

from steadyline.sources import difference as D, publish


def table(spark, n=4000, hot=0.4):
    key = F.when(F.col("id") < n * hot, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id"))
    return spark.range(n).select(key.alias("k"), (F.col("id") % 50).alias("v"), F.when(F.col("id") % 3 == 0, F.lit("a#b")).alias("t"))


def test_same_tables_in_another_order_open_nothing(spark):
    a = table(spark)
    trees = [D.digest_tree(df, ["k"]) for df in (a, a.orderBy("v").repartition(3))]
    assert D.differing_buckets(*trees).count() == 0
    assert tuple(publish.same_content(a, a.orderBy(F.desc("v"))).first()) == (4000, 4000, 0, 0, True)


@pytest.mark.parametrize("bits", [1, 5, 16])
def test_differences_by_key(spark, bits):
    a = table(spark)
    b = a.where("k is null or k <> 3001").withColumn("v", F.when(F.col("k") == 2003, -1).otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(99_999, 1, None)], "k bigint, v bigint, t string")
    )
    got = {(r["k"], r["status"]) for r in D.row_differences(a, b, ["k"], bits).collect()}
    assert got == {(3001, "only_a"), (2003, "changed"), (99_999, "only_b")}
    again = a.unionByName(a.where("k = 7").limit(1)).unionByName(a.where("k is null").limit(1))
    assert {(r["k"], r["status"]) for r in D.row_differences(a, again, ["k"], bits).collect()} == {(7, "changed"), (None, "changed")}


def test_only_rows_of_open_buckets_are_compared(spark):
    a = table(spark, hot=0)
    b = a.withColumn("v", F.when(F.col("k") == 2003, -1).otherwise(F.col("v")))
    trees = [D.digest_tree(df, ["k"]) for df in (a, b)]
    buckets = D.differing_buckets(*trees)
    assert buckets.count() == 1 and 1 <= D.rest_of(a, trees[0], buckets).count() < 10
    assert tuple(publish.same_content(a, b).first()) == (4000, 4000, 1, 1, False)


def test_counts_of_repeated_rows_matter(spark):
    one = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    assert tuple(publish.same_content(one, one.unionByName(one.limit(1))).first())[:2] == (2, 3)
    assert not publish.same_content(one, one.unionByName(one.limit(1))).first()["same"]


def test_empty_tables_and_other_columns(spark):
    a = table(spark, 30)
    assert tuple(publish.same_content(a.limit(0), a.limit(0)).first()) == (0, 0, 0, 0, True)
    assert tuple(publish.same_content(a, a.limit(0)).first()) == (30, 0, 30, 0, False)
    with pytest.raises(ValueError):
        D.differing_buckets(D.digest_tree(a, ["k"]), D.digest_tree(a.drop("t"), ["k"]))
