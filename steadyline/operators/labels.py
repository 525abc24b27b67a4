"""Forward-looking labels, chronological splits, and the check that features do not look ahead."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyline.config import Policy
from steadyline.functions.frames import by_day


def forward_label(panel: DataFrame, reports: DataFrame, last_day: Column, policy: Policy) -> DataFrame:
    """NULL without any report in the next ``horizon`` days; else 1 from ``positive_reports`` reports on, else 0.

    A window over the entity's own days replaces the interval join between days and reports.
    """
    ahead = F.sum("reports").over(by_day().rangeBetween(1, policy.horizon))
    return panel.join(reports, ["entity_id", "day"], "left").withColumns(
        {
            "label": F.when(ahead > 0, (ahead >= policy.positive_reports).cast("int")),
            "full_horizon": F.date_add("day", policy.horizon) <= last_day,
        }
    )


def label_coverage(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("entity_days"),
        F.count("label").alias("usable"),
        F.count_if(F.col("label").isNull()).alias("excluded"),
        F.count_if(F.col("label") == 1).alias("positive"),
    )


def time_split(df: DataFrame, train_percent: int = 60, validation_percent: int = 20) -> DataFrame:
    """Whole days in order: train, validation, test by cumulative row share. The cumulative sum is over day rows only."""
    per_day = df.groupBy("day").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.sum("_n").over(upto) * 100
    total = F.sum("_n").over(everything)
    split = (
        F.when(share <= train_percent * total, F.lit("train"))
        .when(share <= (train_percent + validation_percent) * total, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    # one row per calendar day: bounded, so it may be broadcast, and the rows are not shuffled by day
    return df.join(F.broadcast(per_day.select("day", split.alias("split"))), "day")


def peek_differences(panel: DataFrame, features: Callable[[DataFrame], DataFrame], cut_day: Column) -> DataFrame:
    """Rows whose features change when all days after ``cut_day`` are removed; must be none."""
    full = features(panel).filter(F.col("day") <= cut_day)
    short = features(panel.filter(F.col("day") <= cut_day))
    return full.exceptAll(short).unionByName(short.exceptAll(full))
