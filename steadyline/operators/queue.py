"""The bounded, ordered list that reviewers work through."""

from pyspark.sql import Column, DataFrame, functions as F

from steadyline.config import Policy
from steadyline.operators.access import authorised
from steadyline.operators.signals import level_rank


def _order() -> list[Column]:
    return [F.desc("case_day"), F.desc(level_rank(F.col("level"))), F.asc("case_id")]


def queue(cases: DataFrame) -> DataFrame:
    """Newest case day first, then concern level, then case id."""
    return cases.orderBy(*_order())


def queue_for(cases: DataFrame, account_id: str, accounts: DataFrame, matrix: DataFrame, purpose: str, k: int) -> DataFrame:
    """First ``k`` rows of an account's own queue: top-k per task, then merged."""
    return authorised(cases, account_id, accounts, matrix, purpose).orderBy(*_order()).limit(k)


def staleness(cases: DataFrame, as_of: Column, policy: Policy, wording: str) -> DataFrame:
    """Age of each case in days; ``wording`` is a format with one number, for those past the policy's limit."""
    age = F.date_diff(as_of, F.col("case_day"))
    chip = F.when(age > policy.stale_after, F.format_string(wording, age))
    return cases.withColumns({"age_days": age, "stale": age > policy.stale_after, "chip": chip})


def queue_header(cases: DataFrame, due: DataFrame, warnings: DataFrame) -> DataFrame:
    """Counts on top of the queue. ``due`` and ``warnings`` are one-row tables."""
    return cases.agg(
        F.count_if(F.col("state") != "closed").alias("open"),
        F.count_if(F.col("state") == "in_review").alias("in_review"),
    ).select("open", "in_review", due.scalar().alias("followups_due"), warnings.scalar().alias("warnings"))


def surfacing_reason(explained: DataFrame, default: str) -> DataFrame:
    """The strongest factor in words, or the ``default``."""
    top = F.try_element_at("factors", F.lit(1))
    words = F.concat(top["metric"], F.lit(": "), top["rule"])
    return explained.withColumn("surfaced", F.coalesce(words, F.lit(default)))


def signal_drift(cases: DataFrame, flags: DataFrame) -> DataFrame:
    """Latest judged signal per entity next to the day on which its case was opened."""
    latest = (
        flags.filter(F.col("material").isNotNull())
        .groupBy("entity_id")
        .agg(F.max("day").alias("signal_day"), F.max_by("material", "day").alias("signal"))
    )
    return cases.join(latest, "entity_id", "left").withColumn(
        "differs", F.coalesce(F.col("signal_day") != F.col("case_day"), F.lit(False))
    )
