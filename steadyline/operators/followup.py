"""Support options, whether they can be scheduled, and follow-ups that stay due until a person closes them."""

from pyspark.sql import Column, DataFrame, functions as F


def mapping_table(df: DataFrame, mapping: list[tuple[str, str, str]]) -> DataFrame:
    """Rule -> support option, with the mapping's own version."""
    return df.sparkSession.createDataFrame(mapping, "rule string, option string, mapping_version string")


def support_options(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Options per case, sorted, with the mapping version; a set over the mapping, so bounded by its size."""
    return (
        found.join(mapping, "rule")
        .groupBy("case_id", "mapping_version")
        .agg(F.sort_array(F.collect_set("option")).alias("options"))
    )


def duty_days(duties: DataFrame) -> DataFrame:
    """Days touched by a duty [start_ts, end_ts); a duty ending at midnight does not touch the next day."""
    last = F.to_date(F.col("end_ts") - F.expr("INTERVAL 1 MICROSECOND"))
    first = F.to_date("start_ts")
    whole = duties.filter(F.col("end_ts") > F.col("start_ts"))
    return whole.select("entity_id", F.explode(F.sequence(first, last)).alias("day")).distinct()


def feasibility(cases: DataFrame, busy_days: DataFrame, names: tuple[str, str, str], within: int = 3) -> DataFrame:
    """First of ``names``: the next day is free; second: a later day within reach is; third: none is.

    Each case asks about ``within`` days and meets at most one row per entity and day, so there is no interval join.
    """
    slots = cases.select("case_id", "entity_id", "case_day").withColumn(
        "_offset", F.explode(F.sequence(F.lit(1), F.lit(within)))
    )
    slots = slots.withColumn("day", F.date_add("case_day", F.col("_offset")))
    marked = slots.join(busy_days.select("entity_id", "day", F.lit(True).alias("_busy")), ["entity_id", "day"], "left")
    per_case = marked.groupBy("case_id", "entity_id").agg(
        F.count("_busy").alias("busy_days"),
        F.min(F.when(F.col("_busy").isNull(), F.col("_offset"))).alias("first_free"),
    )
    schedulable = (
        F.when(F.col("first_free") == 1, F.lit(names[0]))
        .when(F.col("first_free").isNotNull(), F.lit(names[1]))
        .otherwise(F.lit(names[2]))
    )
    return per_case.withColumn("feasibility", schedulable)


def followup_status(followups: DataFrame, as_of: Column) -> DataFrame:
    """``followups`` columns: followup_id, entity_id, due, done. Nothing completes itself."""
    status = (
        F.when(F.col("done").isNotNull() & (F.col("done") > F.col("due")), F.lit("done_late"))
        .when(F.col("done").isNotNull(), F.lit("done"))
        .when(F.col("due").isNull(), F.lit("unscheduled"))
        .when(F.col("due") < as_of, F.lit("overdue"))
        .when(F.col("due") == as_of, F.lit("due"))
        .otherwise(F.lit("upcoming"))
    )
    return followups.withColumn("status", status)


def requeue(queue: DataFrame, followups: DataFrame) -> DataFrame:
    """Entities with a case or with a due item, once each; the source says why they are back."""
    due = followups.filter(F.col("status").isin("due", "overdue")).select("entity_id", F.lit("followup").alias("source"))
    return (
        queue.select("entity_id", F.lit("case").alias("source"))
        .unionByName(due)
        .groupBy("entity_id")
        .agg(F.min("source").alias("source"), F.count("*").alias("items"))
    )


def follow_through(followups: DataFrame, roster: DataFrame) -> DataFrame:
    """Offered, schedulable, delivered, checked in time, per group. Counted per entity before the join."""
    per_entity = followups.groupBy("entity_id").agg(
        F.count("*").alias("offered"),
        F.count("due").alias("schedulable"),
        F.count("done").alias("delivered"),
        F.count_if(F.col("done") <= F.col("due")).alias("in_time"),
    )
    stages = ["offered", "schedulable", "delivered", "in_time"]
    return (
        per_entity.join(roster, "entity_id")
        .groupBy("group_id")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in stages])
    )


def next_step(cases: DataFrame, options: DataFrame, feasible: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """First matching step; ``cases`` carries the replayed state, ``names`` are those of ``feasibility``."""
    joined = cases.join(options.select("case_id", "options"), "case_id", "left").join(
        feasible.select("case_id", "feasibility"), "case_id", "left"
    )
    step = (
        F.when(F.col("state") == "closed", F.lit("none"))
        .when(F.col("state").isin("open", "reopened"), F.lit("acknowledge"))
        .when(F.col("options").isNull(), F.lit("talk_first"))
        .when(F.col("feasibility") == names[0], F.lit("schedule_support"))
        .when(F.col("feasibility") == names[1], F.lit("arrange_support_day"))
        .otherwise(F.lit("escalate_scheduling"))
    )
    return joined.withColumn("next_step", step)
