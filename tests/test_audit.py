import hashlib

import pytest
from pyspark.sql import functions as F

from steadyline.functions.digests import fingerprint, payload
from steadyline.operators import audit as H

FIELDS = ["actor", "note"]
SEG = 4


@pytest.fixture(scope="module")
def events(spark):
    data = [("hot" if i % 3 else "cold", (i // 3 * 2 + i % 3 - 1) if i % 3 else i // 3, f"a{i % 5}", None if i % 7 == 0 else f"n#{i}\\") for i in range(60)]
    return spark.createDataFrame(data, "chain string, seq bigint, actor string, note string")


@pytest.fixture(scope="module")
def log(events, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("audit") / "log")
    H.chain(events, "chain", "seq", FIELDS, SEG).write.parquet(path)
    return spark.read.parquet(path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def text_of(value):
    return "\\N" if value is None else value.replace("\\", "\\\\").replace("#", "\\#")


def test_chain_matches_plain_python(events, log):
    got = {(r["chain"], r["seq"]): (r["prev_hash"], r["hash"]) for r in log.collect()}
    assert len(got) == events.count()
    last = {}
    for r in sorted(events.collect(), key=lambda r: (r["chain"], r["seq"])):
        seg = r["seq"] // SEG
        prev = sha(f"start#{r['chain']}#{seg}") if r["seq"] % SEG == 0 else last[r["chain"]]
        h = sha(prev + "#" + sha(text_of(r["actor"]) + "#" + text_of(r["note"])))
        assert got[(r["chain"], r["seq"])] == (prev, h)
        last[r["chain"]] = h


def broken(log, changed, heads=None):
    v = H.verify_chain(changed, "chain", "seq", FIELDS, SEG, heads)
    return {r["chain"]: (r["first_broken"], r["reason"]) for r in H.first_break(v, "chain", "seq").collect()}


def test_intact_then_altered_then_restored(log):
    heads = H.heads(log, "chain", "seq")
    assert broken(log, log, heads) == {}
    at = (F.col("chain") == "hot") & (F.col("seq") == 9)
    altered = log.withColumn("note", F.when(at, F.lit("other")).otherwise(F.col("note")))
    assert broken(log, altered, heads) == {"hot": (9, "payload")}
    verified = H.verify_chain(altered, "chain", "seq", FIELDS, SEG, heads)
    assert tuple(H.health(verified).first()) == (60, 1, False)
    restored = altered.drop("note").join(log.select("chain", "seq", "note"), ["chain", "seq"])
    assert H.health(H.verify_chain(restored, "chain", "seq", FIELDS, SEG, heads)).first()["healthy"]


def test_dropped_swapped_cut_and_rewritten(log, events):
    heads = H.heads(log, "chain", "seq")
    hot = F.col("chain") == "hot"
    assert broken(log, log.filter(~(hot & (F.col("seq") == 5))), heads) == {"hot": (6, "gap")}
    swapped = log.withColumn(
        "seq", F.when(hot & (F.col("seq") == 5), 6).when(hot & (F.col("seq") == 6), 5).otherwise(F.col("seq")).cast("bigint")
    )
    assert broken(log, swapped, heads)["hot"] == (5, "link")
    cut = log.filter(~(hot & (F.col("seq") >= 38)))
    assert broken(log, cut) == {}  # a cut tail is a valid prefix ...
    assert broken(log, cut, heads) == {"hot": (38, "tail")}  # ... and shows only against the stored heads
    forged = events.withColumn("note", F.when(hot & (F.col("seq") == 1), F.lit("forged")).otherwise(F.col("note")))
    assert broken(log, H.chain(forged, "chain", "seq", FIELDS, SEG), heads) == {"hot": (3, "head")}


def test_doubled_events_do_not_verify(log):
    heads = H.heads(log, "chain", "seq")
    again = log.filter("chain = 'hot' and seq = 6")
    verified = H.verify_chain(log.union(again).union(again), "chain", "seq", FIELDS, SEG, heads)
    wrong = sorted((r["chain"], r["seq"], r["reason"]) for r in verified.filter("not ok").collect())
    assert wrong == [("hot", 6, "duplicate"), ("hot", 7, "count")] and verified.filter("ok").count() == 59
    extra = heads.withColumn("events", F.when((F.col("chain") == "cold") & (F.col("segment") == 0), 3).otherwise(F.col("events")))
    assert broken(log, log, extra) == {"cold": (3, "count")}


def test_seal_covers_every_head(log):
    heads = H.heads(log, "chain", "seq")
    seal = H.seal(heads, "chain").first()
    assert seal == H.seal(heads.repartition(7), "chain").first()
    other = heads.withColumn("events", F.when((F.col("chain") == "hot") & (F.col("segment") == 2), 3).otherwise(F.col("events")))
    assert H.seal(other, "chain").first()["seal"] != seal["seal"]


def test_trail_and_purposes(spark, rows):
    log = spark.createDataFrame([(1, 1, "r", "p", "done"), (2, 2, "r", "p", "done"), (2, 3, "l", "p", "refused")], "ts int, seq int, role string, purpose string, outcome string")
    trail = H.action_trail(log.withColumn("entity_id", F.lit(5)), ["entity_id"])
    assert "entity_id" not in trail.columns and "seq" not in trail.columns and [r["role"] for r in trail.collect()] == ["l", "r", "r"]
    assert rows(H.purpose_summary(log)) == [("p", "l", "refused", 1), ("p", "r", "done", 2)]


def test_payload_escaping_and_fingerprint(spark):
    df = spark.createDataFrame([("a#", "b"), ("a", "#b"), (None, "x"), ("\\N", "x")], "x string, y string")
    assert df.select(payload("x", "y")).distinct().count() == 4
    a = fingerprint(df).first()
    assert a == fingerprint(df.repartition(3)).first()
    assert a["digest"] != fingerprint(df.union(df.limit(1))).first()["digest"]
    assert fingerprint(df.filter("false")).first()["rows"] == 0
