"""Counts and trends per group, and one entity's timeline."""

from pyspark.sql import DataFrame, Window, functions as F


def group_summary(roster: DataFrame, cases: DataFrame, feasible: DataFrame) -> DataFrame:
    """Members, members needing attention, constrained cases. Each input is reduced per group before the join."""
    members = roster.groupBy("group_id").agg(F.count("*").alias("members"))
    # two-step distinct count: one row per entity first, so a large group is not gathered in one place
    attention = (
        cases.groupBy("group_id", "entity_id").agg(F.lit(1).alias("_x")).groupBy("group_id").agg(F.count("*").alias("attention"))
    )
    constrained = (
        cases.select("case_id", "group_id")
        .join(feasible.filter(F.col("feasibility") == "constrained").select("case_id"), "case_id", "left_semi")
        .groupBy("group_id")
        .agg(F.count("*").alias("constrained"))
    )
    out = members.join(attention, "group_id", "left").join(constrained, "group_id", "left")
    return out.fillna(0, ["attention", "constrained"])


def group_trend(panel: DataFrame, grain: str = "week") -> DataFrame:
    """Load and errors per group and period, with the mean of up to four periods before it."""
    period = F.to_date(F.date_trunc(grain, F.col("day")))
    totals = panel.groupBy("group_id", period.alias("period")).agg(
        F.coalesce(F.sum("load"), F.lit(0)).alias("load"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.count("load").alias("observed_days"),
    )
    before = Window.partitionBy("group_id").orderBy("period").rowsBetween(-4, -1)
    return totals.withColumn("load_before", F.round(F.avg("load").over(before), 6))


def concentration(cases: DataFrame) -> DataFrame:
    """Share of all cases per group."""
    per_group = cases.groupBy("group_id").agg(F.count("*").alias("n"))
    total = per_group.agg(F.sum("n").alias("t")).scalar()
    return per_group.withColumn("share", F.round(F.col("n") / total, 6))


def dashboard(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals per region and group with subtotals. Counted per group before the rollup."""
    per_group = cases.groupBy("group_id").agg(
        F.count("*").alias("cases"), F.count_if(F.col("level") == "high").alias("high")
    )
    return (
        groups.join(per_group, "group_id", "left")
        .rollup("region_name", "group_name")
        .agg(
            F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"),
            F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        )
    )


def timeline(flags: DataFrame, cases: DataFrame) -> DataFrame:
    """Every calendar day of each entity with its signal and, where one was opened, its case."""
    marks = cases.select("entity_id", F.col("case_day").alias("day"), "case_id", "level")
    return flags.select("entity_id", "day", "load", "load_z", "material").join(marks, ["entity_id", "day"], "left")
