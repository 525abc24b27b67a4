"""From time-stamped records to a dense entity x day panel."""

from pyspark.sql import Column, DataFrame, functions as F


def entity_days(records: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row per entity and day that has records. Partial aggregation absorbs heavy entities before the shuffle."""
    return records.groupBy("entity_id", F.to_date("ts").alias("day")).agg(
        *[expression.alias(name) for name, expression in metrics.items()]
    )


def spine(days: DataFrame, roster: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every roster entity on every calendar day. A day without records keeps NULL metrics; nothing is imputed."""
    skeleton = roster.withColumn("day", F.explode(F.sequence(first, last)))
    return merged(skeleton, days).withColumn("day_no", F.unix_date("day"))


def merged(skeleton: DataFrame, *facts: DataFrame) -> DataFrame:
    """``skeleton`` (entity_id, day, ...) with the columns of ``facts`` (entity_id, day, ...), NULL where they have no row.

    As a left join on (entity_id, day), by one shuffle of all rows by entity, which later windows by entity go on
    using. Each side has at most one row for an entity and day.
    """
    key = ["entity_id", "day"]
    parts = [skeleton.withColumn("_in", F.lit(True)), *facts]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in key]
    one = rows.repartition("entity_id").groupBy(*key).agg(*[F.max(c).alias(c) for c in columns])
    return one.filter("_in").drop("_in")


def group_calendar(context: DataFrame, roster: DataFrame, first: Column, last: Column) -> DataFrame:
    """``context`` (group_id, day, ...) with a row for each group of the roster on each day; groups x days, not entities."""
    every = roster.select("group_id").distinct().withColumn("day", F.explode(F.sequence(first, last)))
    known = context.withColumnsRenamed({"group_id": "_group", "day": "_day"})
    return every.join(known, F.col("group_id").eqNullSafe(F.col("_group")) & (F.col("day") == F.col("_day")), "left").drop("_group", "_day")


def spine_with_context(days: DataFrame, roster: DataFrame, calendar: DataFrame) -> DataFrame:
    """``spine``, each day with its group's columns. The join is of roster and groups, before there is a panel."""
    skeleton = roster.withColumnRenamed("group_id", "_group").join(calendar, F.col("_group").eqNullSafe(F.col("group_id"))).drop("_group")
    return merged(skeleton, days).withColumn("day_no", F.unix_date("day"))


def observed_span(days: DataFrame) -> tuple[Column, Column]:
    """First and last day as scalar subqueries, so that nothing passes through the driver."""
    return days.agg(F.min("day").alias("d")).scalar(), days.agg(F.max("day").alias("d")).scalar()
