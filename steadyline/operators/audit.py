"""A hash-linked log: each event's hash covers the hash before it and its own payload.

A chain is serial by nature. To build long chains in parallel they are cut into segments of ``segment`` events; each
segment starts from a hash that names it, and the segment heads are themselves sealed. Verification needs no order at
all: an event's hash is recomputed from its own row, and its link is compared by an equi-join with the row before.
"""

from pyspark.sql import Column, DataFrame, functions as F

from steadyline.functions.digests import digest_sums, payload

SEGMENT = 128


def _start(chain: str, segment: Column) -> Column:
    return F.sha2(F.concat_ws("#", F.lit("start"), F.col(chain).cast("string"), segment.cast("string")), 256)


def chain(events: DataFrame, key: str, seq: str, fields: list[str], segment: int = SEGMENT) -> DataFrame:
    """Add segment, prev_hash and hash. ``seq`` counts from 0 without gaps within ``key``.

    Only digests enter the fold, so the size of the payloads does not matter.
    """
    number = F.floor(F.col(seq) / segment).cast("bigint")
    items = events.select(key, F.col(seq), number.alias("segment"), F.sha2(payload(*fields), 256).alias("_digest"))
    grouped = items.groupBy(key, "segment").agg(F.sort_array(F.collect_list(F.struct(seq, "_digest"))).alias("_items"))
    walk = F.aggregate(
        "_items",
        F.struct(_start(key, F.col("segment")).alias("h"), F.lit("").alias("path")),
        lambda acc, item: F.struct(
            F.sha2(F.concat_ws("#", acc["h"], item["_digest"]), 256).alias("h"),
            F.concat(acc["path"], acc["h"]).alias("path"),
        ),
    )
    # the fold is a select of its own: next to an explode it would run again for every row
    walked = grouped.select(key, "segment", "_items", walk.alias("_w"))
    paths = walked.select(key, "segment", "_items", F.concat("_w.path", "_w.h").alias("_path"))
    links = paths.select(key, "segment", "_path", F.posexplode("_items").alias("_i", "_item"))
    hashes = links.select(
        key,
        F.col(f"_item.{seq}").alias(seq),
        "segment",
        F.substring("_path", F.col("_i") * 64 + 1, F.lit(64)).alias("prev_hash"),
        F.substring("_path", F.col("_i") * 64 + 65, F.lit(64)).alias("hash"),
    )
    return events.join(hashes, [key, seq])


def heads(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Per chain and segment: number of events and last hash. Kept apart, it shows when a tail has been cut."""
    return log.groupBy(key, "segment").agg(F.count("*").alias("events"), F.max_by("hash", seq).alias("head"))


def seal(segment_heads: DataFrame, key: str) -> DataFrame:
    """One row that covers all heads, whatever their order; sums merge, so no task holds all heads."""
    rows = segment_heads.select(F.sha2(payload(key, "segment", "events", "head"), 256).alias("_d"))
    sums = rows.agg(F.count("*").alias("segments"), *digest_sums(F.col("_d")))
    parts = [F.col(f"part{i}").cast("string") for i in range(4)]
    return sums.select(
        "segments", F.sha2(F.concat_ws("#", F.col("segments").cast("string"), *parts), 256).alias("seal")
    )


def verify_chain(
    log: DataFrame, key: str, seq: str, fields: list[str], segment: int = SEGMENT, expected: DataFrame | None = None
) -> DataFrame:
    """Each event with ``ok`` and, if broken, the reason: duplicate, gap, link or payload.

    An event that stands there more than once is one row, with the reason duplicate. With the stored ``expected``
    heads also: tail (events missing at a segment's end), count (more or fewer events than were sealed, the end being
    there), and head (a segment that verifies in itself but was rewritten).
    """
    number = F.floor(F.col(seq) / segment).cast("bigint")
    # payloads are hashed where they are read; only digests are grouped and joined
    light = log.select(key, seq, "prev_hash", "hash", F.sha2(payload(*fields), 256).alias("_digest"))
    times = light.groupBy(key, seq).agg(F.count("*").alias("_times"), *[F.first(c).alias(c) for c in ("prev_hash", "hash", "_digest")])
    before = times.select(F.col(key), (F.col(seq) + 1).alias(seq), F.col("hash").alias("_before"))
    rows = times.join(before, [key, seq], "left")
    first = F.col(seq) % segment == 0
    link = F.when(first, _start(key, number)).otherwise(F.col("_before"))
    computed = F.sha2(F.concat_ws("#", F.col("prev_hash"), F.col("_digest")), 256)
    reason = (
        F.when(F.col("_times") > 1, F.lit("duplicate"))
        .when((F.col(seq) > 0) & F.col("_before").isNull(), F.lit("gap"))
        .when(~F.col("prev_hash").eqNullSafe(link), F.lit("link"))
        .when(~F.col("hash").eqNullSafe(computed), F.lit("payload"))
    )
    out = rows.select(key, seq, reason.isNull().alias("ok"), reason.alias("reason"))
    if expected is None:
        return out
    actual = log.groupBy(key, "segment").agg(F.count("*").alias("_events"), F.max(seq).alias("_last"), F.max_by("hash", seq).alias("_head"))
    due = F.col("segment") * segment + F.col("events") - 1
    short = F.col("_last").isNull() | (F.col("_last") < due)
    against_heads = expected.join(actual, [key, "segment"], "left").select(
        key,
        F.when(short, F.coalesce(F.col("_last") + 1, F.col("segment") * segment)).otherwise(F.col("_last")).cast("bigint").alias(seq),
        F.lit(False).alias("ok"),
        F.when(short, F.lit("tail"))
        .when(~F.col("_head").eqNullSafe(F.col("head")), F.lit("head"))
        .when(F.col("_events") != F.col("events"), F.lit("count"))
        .alias("reason"),
    )
    return out.unionByName(against_heads.filter(F.col("reason").isNotNull()))


def first_break(verified: DataFrame, key: str, seq: str) -> DataFrame:
    first = verified.filter(~F.col("ok")).groupBy(key).agg(F.min(F.struct(seq, "reason")).alias("_f"))
    return first.select(key, F.col(f"_f.{seq}").alias("first_broken"), F.col("_f.reason").alias("reason"))


def health(verified: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: healthy only while every event verifies and (if given) every published file matches its manifest."""
    chain_ok = verified.agg(
        F.count("*").alias("events"),
        F.count_if(~F.col("ok")).alias("broken"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("healthy"),
    )
    if files is None:
        return chain_ok
    files_ok = files.agg(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("ok")).scalar()
    return chain_ok.withColumn("healthy", F.col("healthy") & files_ok)


def action_trail(log: DataFrame, id_columns: list[str]) -> DataFrame:
    """Newest first, without the columns that identify a person; ``seq`` orders, but joins back to the event, so it goes too."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).drop(*id_columns, "seq")


def purpose_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("purpose", "role", "outcome").agg(F.count("*").alias("n"))
