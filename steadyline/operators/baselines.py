"""What is normal for this entity, what is normal for its group, and how far today departs from both."""

from pyspark.sql import DataFrame, Window, functions as F

from steadyline.config import Policy
from steadyline.functions.frames import by_day, ratio, trailing, with_frame_stats, with_slope
from steadyline.functions.ordered import Ordered


def personal_baseline(panel: DataFrame, metric: str, policy: Policy, median: bool = False) -> DataFrame:
    """Mean and spread of the entity's own trailing days, today left out; NULL with too few observed days."""
    frame = trailing(policy.baseline_days, 1)
    enough = F.col("_n") >= policy.min_observed
    columns = {
        f"{metric}_n": F.col("_n"),
        f"{metric}_mean": F.when(enough, F.col("_mean")),
        f"{metric}_sd": F.when(enough, F.col("_sd")),
    }
    out = with_frame_stats(panel, metric, frame)
    if median:
        out = out.withColumn("_median", F.expr(f"percentile({metric}, 0.5)").over(frame))
        columns[f"{metric}_median"] = F.when(enough, F.col("_median"))
    return out.withColumns(columns).drop("_n", "_mean", "_sd", "_median")


def lagged_baseline(panel: DataFrame, metric: str, policy: Policy) -> DataFrame:
    """Mean of older days only, so that a slow drift is still seen against where it started."""
    out = with_frame_stats(panel, metric, trailing(policy.lag_far, policy.lag_near), spread=False)
    lagged = F.when(F.col("_n") >= policy.min_observed, F.col("_mean"))
    return out.withColumn(f"{metric}_lagged_mean", lagged).drop("_n", "_mean")


def group_baseline(panel: DataFrame, metric: str, policy: Policy) -> DataFrame:
    """Per group and day: mean per observed member today, and over the trailing window.

    Reduced to groups x days before the window, so its size does not follow the number of entities.
    """
    daily = panel.groupBy("group_id", "day", "day_no").agg(
        F.sum(F.col(metric).cast("double")).alias("_total"), F.count(metric).alias("_members")
    )
    frame = trailing(policy.baseline_days, 1, key="group_id")
    daily = daily.withColumns({"_all": F.sum("_total").over(frame), "_seen": F.sum("_members").over(frame)})
    return daily.select(
        "group_id",
        "day",
        ratio(F.col("_total"), F.col("_members")).alias(f"{metric}_group_today"),
        F.when(F.col("_seen") >= policy.min_observed, F.col("_all") / F.col("_seen")).alias(f"{metric}_group_mean"),
    )


def with_group_context(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach the group columns. Done before the per-entity windows, so that those share one shuffle by entity."""
    return panel.join(groups, ["group_id", "day"], "left")


def deviation(panel: DataFrame, metric: str) -> DataFrame:
    """Departure from the own baseline, in units and in own spreads, and net of the group's departure."""
    own = F.col(metric) - F.col(f"{metric}_mean")
    shift = F.col(f"{metric}_group_today") - F.col(f"{metric}_group_mean")
    columns = {f"{metric}_dev": F.round(own, 6), f"{metric}_excess": F.round(own - shift, 6)}
    return own_z(panel.withColumns(columns), metric)


def own_z(panel: DataFrame, metric: str) -> DataFrame:
    """Departure in own spreads, without context."""
    z = F.when(F.col(f"{metric}_sd") > 0, (F.col(metric) - F.col(f"{metric}_mean")) / F.col(f"{metric}_sd"))
    return panel.withColumn(f"{metric}_z", F.round(z, 6))


def temporal_features(panel: DataFrame, metric: str, busy_run: int) -> DataFrame:
    """Previous observed value, trailing week total and slope, days since active, length of unbroken activity."""
    week = by_day().rangeBetween(-6, 0)
    before = by_day().rowsBetween(Window.unboundedPreceding, -1)
    active_day = F.when(F.col(metric).isNotNull(), F.col("day_no"))
    out = panel.withColumns(
        {
            f"{metric}_prev": F.last(metric, ignorenulls=True).over(before),
            f"{metric}_sum7": F.sum(metric).over(week),
            "rest_gap": F.when(
                F.col(metric).isNotNull(), F.col("day_no") - F.last(active_day, ignorenulls=True).over(before)
            ),
            "busy": F.count(metric).over(by_day().rangeBetween(-(busy_run - 1), 0)) == busy_run,
        }
    )
    return with_slope(out, metric, week, f"{metric}_slope7")


def rest_gaps(records: DataFrame) -> DataFrame:
    """Hours between consecutive records of an entity; heavy entities are spread over chunks."""
    run = Ordered(records.select("entity_id", "ts", "event_id"), ["entity_id"], ["ts", "event_id"], "gaps")
    rows = run.previous("ts", "previous_ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    return rows.select("entity_id", "event_id", F.round(seconds / 3.6e9, 6).alias("gap_hours"))


def entity_trend(deviations: DataFrame, metric: str, days_ago: int = 7) -> DataFrame:
    """Direction of the departure now against the same entity ``days_ago`` earlier."""
    now = F.col(f"{metric}_z")
    then = F.max(now).over(by_day().rangeBetween(-days_ago, -days_ago))
    trend = (
        F.when(now.isNull() | then.isNull(), F.lit("unknown"))
        .when(now - then >= 0.5, F.lit("rising"))
        .when(now - then <= -0.5, F.lit("falling"))
        .otherwise(F.lit("steady"))
    )
    return deviations.withColumns({f"{metric}_z_then": then, "trend": trend})
