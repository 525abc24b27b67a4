"""Kept summaries equal fresh ones, and only changed partitions are read."""

import pytest
from pyspark.sql import functions as F

from steadyline.operators import upkeep as U

@pytest.fixture
def rules(spark):
    return {"positive": F.col("v") > 0}


def rows_of(df):
    return {r["p"]: (r["rows"], r["present_v"], r["least_v"], r["greatest_v"], r["broken_positive"], r["read"]) for r in df.collect()}


def test_only_changed_partitions_are_read(spark, tmp_path, rules):
    path = str(tmp_path / "t")

    def add(rows, mode="append"):
        spark.createDataFrame(rows, "p string, v int").write.mode(mode).partitionBy("p").parquet(path)

    add([("a", 1), ("a", None), ("b", -2), (None, 4)])
    first = U.refreshed(spark, path, "p", ["v"], rules)
    assert rows_of(first) == {"a": (2, 1, 1, 1, 0, True), "b": (1, 1, -2, -2, 1, True), None: (1, 1, 4, 4, 0, True)}
    again = U.refreshed(spark, path, "p", ["v"], rules, first)
    assert {k: v[5] for k, v in rows_of(again).items()} == {"a": False, "b": False, None: False}
    add([("b", 7), ("c", 0), (None, -1)])
    third = U.refreshed(spark, path, "p", ["v"], rules, again)
    assert rows_of(third) == {"a": (2, 1, 1, 1, 0, False), "b": (2, 2, -2, 7, 1, True), "c": (1, 1, 0, 0, 1, True), None: (2, 2, -1, 4, 1, True)}
    whole = rows_of(U.refreshed(spark, path, "p", ["v"], rules))
    assert {k: v[:5] for k, v in whole.items()} == {k: v[:5] for k, v in rows_of(third).items()}
    found = {(r["check"], r["of"]): (r["rows"], r["findings"]) for r in U.total(third, ["v"], ["positive"]).collect()}
    assert found == {("missing", "v"): (7, 1), ("rule", "positive"): (7, 3)}
    add([("a", 3)], "overwrite")  # all other partitions are gone
    assert rows_of(U.refreshed(spark, path, "p", ["v"], rules, third)) == {"a": (1, 1, 3, 3, 0, True)}


def test_the_scan_is_pruned(spark, tmp_path, rules):
    path = str(tmp_path / "t")
    spark.range(40).select((F.col("id") % 4).alias("p"), F.col("id").alias("v")).write.partitionBy("p").parquet(path)
    plan = U.summarised(spark.read.parquet(path).where(F.col("p").isin([3])), "p", ["v"], rules)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p#" in plan.split("PartitionFilters: [")[1].split("]")[0]
