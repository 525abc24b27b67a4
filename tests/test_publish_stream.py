import datetime as dt
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from steadyline.operators import panel
from steadyline.sources import publish as S, staging
from steadyline.streaming import daily


@pytest.fixture
def table(spark):
    return spark.range(50).select("id", (F.col("id") % 3).alias("part"), (F.col("id") / 2).alias("x"), F.lit("m").alias("mood"))


def published(spark, table, path):
    S.publish({"t": S.Export(table, ["id", "part", "x"], "part")}, path, "2024-01-30", "abc", ["mood"])
    return path


def test_manifest_hashes_and_round_trip(spark, table, tmp_path, rows):
    path = published(spark, table, str(tmp_path / "b"))
    stored = spark.read.parquet(path + "/manifest").collect()
    assert stored and all(r["commit"] == "abc" and r["as_of"] == dt.date(2024, 1, 30) for r in stored)
    for r in stored:
        content = (Path(path) / "data" / r["file"]).read_bytes()
        assert (r["sha256"], r["length"]) == (hashlib.sha256(content).hexdigest(), len(content))
    back = S.read_verified(spark, path, "t").select("id", F.col("part").cast("bigint"), "x")
    assert S.same_content(back, table.select("id", "part", "x")).first()["same"]


def test_large_files_are_hashed_by_rows(spark, tmp_path):
    table = spark.range(4000).select("id", F.repeat(F.lit("x"), 50).alias("t"), F.array("id").alias("a"))
    path = str(tmp_path / "data")
    table.coalesce(1).write.parquet(f"{path}/t")
    table.limit(3).coalesce(1).write.parquet(f"{path}/small")
    bound = 3000
    first = {r["file"].split("/")[0]: r for r in S.manifest(spark, path, bound).collect()}
    assert first["t"]["length"] > bound >= first["small"]["length"]
    assert first["t"]["sha256"] is None and len(first["t"]["rows_sha256"]) == 64
    assert first["small"]["rows_sha256"] is None and len(first["small"]["sha256"]) == 64
    shuffled = str(tmp_path / "again" / "data")
    table.orderBy(F.desc("id")).coalesce(1).write.parquet(f"{shuffled}/t")
    assert S.manifest(spark, shuffled, bound).first()["rows_sha256"] == first["t"]["rows_sha256"]
    altered = str(tmp_path / "altered" / "data")
    table.withColumn("t", F.when(F.col("id") == 7, "y").otherwise(F.col("t"))).coalesce(1).write.parquet(f"{altered}/t")
    assert S.manifest(spark, altered, bound).first()["rows_sha256"] != first["t"]["rows_sha256"]


@pytest.mark.parametrize("bound", [100, 10_000_000])
def test_a_damaged_file_is_changed_whatever_its_size(spark, tmp_path, bound):
    path = tmp_path / "data"
    for name in ("t", "u"):
        spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(2).write.parquet(f"{path}/{name}")
    stored = spark.createDataFrame(S.manifest(spark, str(path), bound).collect(), S.manifest(spark, str(path), bound).schema)
    hurt = [sorted((path / "t").glob("*.parquet"))[0], *(path / "u").glob("*.parquet")]  # of u no file can be read
    for file in hurt:
        file.write_bytes(b"x" * file.stat().st_size)
        for crc in file.parent.glob(f".{file.name}.crc"):
            crc.unlink()
    gone = sorted((path / "t").glob("*.parquet"))[1]
    status = {r["file"]: r["status"] for r in S.verify_manifest(S.manifest(spark, str(path), bound), stored).collect()}
    assert status == {f"{f.parent.name}/{f.name}": "changed" for f in hurt} | {f"t/{gone.name}": "ok"}


def test_files_are_cut_by_bytes_and_only_the_read_table_is_verified(spark, tmp_path):
    wide = spark.range(300).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("t")).coalesce(1)
    path = str(tmp_path / "b")
    S.publish({"wide": S.Export(wide, ["id", "t"]), "other": S.Export(wide, ["id"])}, path, "2024-01-30", "abc", file_bytes=100_000)
    assert len(list((Path(path) / "data" / "wide").glob("*.parquet"))) >= 3
    for file in (Path(path) / "data" / "other").glob("*.parquet"):
        file.unlink()
    assert S.read_verified(spark, path, "wide").count() == 300
    with pytest.raises(Exception):
        S.read_verified(spark, path, "other")


def test_refusals(spark, table, tmp_path):
    with pytest.raises(ValueError, match="forbidden"):
        S.publish({"t": S.Export(table, ["id", "mood"])}, str(tmp_path / "x"), "2024-01-30", "abc", ["mood"])
    assert not (tmp_path / "x").exists()
    bad = table.withColumn("x", F.lit(float("nan")))
    with pytest.raises(ValueError, match="non-finite"):
        S.publish({"t": S.Export(bad, ["id", "x"])}, str(tmp_path / "y"), "2024-01-30", "abc")
    assert not (tmp_path / "y" / "manifest").exists()


def test_changed_missing_extra(spark, table, tmp_path):
    path = published(spark, table, str(tmp_path / "b"))
    expected = spark.read.parquet(path + "/manifest")
    files = sorted((Path(path) / "data").rglob("*.parquet"))
    assert len(files) >= 2
    content = files[0].read_bytes()
    files[0].write_bytes(content[:-1] + b"?")
    for crc in Path(path).rglob("*.crc"):
        crc.unlink()
    (files[0].parent / "added.parquet").write_bytes(content)
    lost = files[1].read_bytes()
    files[1].unlink()
    status = {r["status"] for r in S.verify_manifest(S.manifest(spark, path + "/data"), expected).collect()}
    assert {"changed", "missing", "extra"} <= status
    with pytest.raises(ValueError, match="do not match"):
        S.read_verified(spark, path, "t")
    files[0].write_bytes(content)
    files[1].write_bytes(lost)
    (files[0].parent / "added.parquet").unlink()
    spark.catalog.clearCache()
    assert S.verify_manifest(S.manifest(spark, path + "/data"), expected).filter("status <> 'ok'").count() == 0


def test_same_content_counts_duplicates(spark, table):
    one = S.same_content(table, table.union(table.limit(1))).first()
    assert (one["only_a"], one["only_b"], one["same"]) == (0, 1, False)
    before, after = S.fingerprint(table), S.fingerprint(table.filter("id < 49"))
    assert S.unchanged(before, S.fingerprint(table.repartition(4))).first()["unchanged"]
    assert not any(r["unchanged"] for r in S.unchanged(before, after).collect())


def test_append_keeps_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 2)) for i in range(6)], "seq int, ts timestamp_ntz")
    S.append_actions(rows.filter("seq < 4"), path, "a")
    S.append_actions(rows.filter("seq >= 4"), path, "b")
    S.append_actions(rows.filter("seq >= 4"), path, "b")  # a retry
    back = spark.read.parquet(path)
    assert back.count() == 6 and back.filter(F.col("day") == dt.date(2024, 1, 2)).count() == 3


def test_staging_uses_the_named_folder(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = staging.staging_root(spark)
    assert root == named if named else root
    assert staging.staged(spark.range(5)).count() == 5


def test_stream_gives_the_batch_result(spark, tmp_path):
    """Days before the watermark come out exactly as in the batch; the open days stay in state."""
    base = dt.datetime(2024, 1, 1)
    data = [(i % 3, base + dt.timedelta(hours=5 * i), i) for i in range(60)]
    src = str(tmp_path / "in")
    records = spark.createDataFrame(data, "entity_id bigint, ts timestamp, event_id bigint")
    records.filter("event_id < 40").coalesce(1).write.parquet(src)
    metrics = {"load": F.count("*")}

    def run():
        stream = spark.readStream.schema(records.schema).parquet(src)
        query = daily.append_stream(
            daily.entity_days_stream(stream, metrics), str(tmp_path / "out"), str(tmp_path / "ckpt"), "day"
        )
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    records.filter("event_id >= 40").coalesce(1).write.mode("append").parquet(src)
    run()
    got = {(r["entity_id"], r["day"]): r["load"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["entity_id"], r["day"]): r["load"] for r in panel.entity_days(records, metrics).collect()}
    closed = dt.date(2024, 1, 10)  # last record on the 13th, two days late allowed
    assert got == {k: v for k, v in batch.items() if k in got}
    assert {k for k in batch if k[1] < closed} <= set(got)
