"""What a column derives from outlives files: renamed, staged, joined, published and read again."""

import pytest
from pyspark.sql import Window, functions as F

from steadyline.sources import guards, publish
from steadyline.sources.staging import staged


@pytest.fixture
def secret(spark):
    return spark.range(20).select("id", F.col("id").cast("string").alias("props"), (F.col("id") * 2).alias("value"))


def refused(df, column, *names):
    with pytest.raises(ValueError, match="forbidden"):
        guards.select_allowed(df, [column], list(names))


def test_renamed_staged_and_read_again_is_refused(spark, secret):
    table = staged(staged(secret.select("id", F.length("props").alias("size"), "value"), "a").withColumnRenamed("size", "n"), "b")
    refused(table, "n", "props")
    assert guards.select_allowed(table, ["id", "value"], ["props"]).count() == 20


def test_plain_read_of_staged_files_knows_too(spark, secret, tmp_path):
    guards.with_lineage(secret.select(F.upper("props").alias("x"), "value")).write.parquet(str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t")).groupBy("value").agg(F.max("x").alias("m"), F.count("*").alias("n"))
    refused(again, "m", "props")
    assert guards.select_allowed(again, ["value", "n"], ["props"]).count() == 20


def test_published_columns_and_folder_names(spark, secret, tmp_path):
    path = str(tmp_path / "b")
    table = secret.select("id", (F.length("props") % 2).alias("part"), "value")
    with pytest.raises(ValueError, match="forbidden"):
        publish.publish({"t": publish.Export(table, ["id", "part"], "part")}, path, "2024-01-30", "c", ["props"])
    publish.publish({"t": publish.Export(table, ["id", "part", "value"], "part")}, path, "2024-01-30", "c")
    back = publish.read_verified(spark, path, "t")
    refused(staged(back.withColumn("p", F.col("part") + 1), "again"), "p", "props")
    assert guards.select_allowed(back, ["id", "value"], ["props"]).count() == 20
    # the next bundle is refused before it is written, although its own plan names nothing forbidden
    with pytest.raises(ValueError, match="forbidden"):
        publish.publish({"u": publish.Export(back, ["part"])}, str(tmp_path / "c"), "2024-01-30", "c", ["props"])


def test_appended_actions_keep_their_origins(spark, secret, tmp_path):
    rows = secret.select(F.current_timestamp().alias("ts"), F.col("props").alias("note"))
    publish.append_actions(rows, str(tmp_path / "log"), "1")
    refused(spark.read.parquet(str(tmp_path / "log")), "note", "props")


def test_queries_of_every_kind(spark, secret):
    staged(secret.withColumn("pair", F.struct("props", "value")), "s").createOrReplaceTempView("lineage_s")
    secret.createOrReplaceTempView("lineage_t")
    cases = {
        "WITH x AS (SELECT props AS p, value FROM lineage_s) SELECT p AS a, value AS b FROM x": True,
        "SELECT (SELECT max(props) FROM lineage_s) AS a, value AS b FROM lineage_t": True,
        "SELECT a, value AS b FROM lineage_t LATERAL VIEW explode(array(props)) AS a": True,
        "SELECT value AS a, id AS b FROM lineage_t UNION ALL SELECT length(props), id FROM lineage_t": True,
        "SELECT max(pair.props) OVER (PARTITION BY id) AS a, id AS b FROM lineage_s": True,
        "SELECT t.value AS a, t.id AS b FROM lineage_t t LEFT SEMI JOIN lineage_s s ON t.props = s.props": False,
        "SELECT a, b FROM (SELECT id AS a, value AS b, props FROM lineage_t) WHERE props > '1'": False,
        "SELECT r.props AS a, t.id AS b FROM lineage_t t JOIN lineage_t r ON t.id = r.id": True,
    }
    for text, derives in cases.items():
        found = guards.origins(spark.sql(text))
        assert ("props" in found["a"], "props" in found["b"]) == (derives, False), text


def test_python_made_columns_derive_from_all_that_was_read(spark, secret):
    made = secret.select("id", "props").mapInArrow(lambda batches: batches, "id bigint, other string")
    assert "props" in guards.origins(made)["other"]
    assert "props" not in guards.origins(secret.select("id").mapInArrow(lambda b: b, "other bigint"))["other"]


def test_lineage_as_rows_and_self_joins(spark, secret):
    w = Window.partitionBy("id").orderBy("value")
    table = secret.withColumn("lag", F.lag("props").over(w))
    joined = table.alias("a").join(table.alias("b"), "id").select("id", F.col("a.lag").alias("l"), F.col("b.value").alias("v"))
    got = {r["column"]: set(r["origins"]) for r in guards.lineage(joined).collect()}
    assert "props" in got["l"] and "props" not in got["v"] and "props" not in got["id"]
