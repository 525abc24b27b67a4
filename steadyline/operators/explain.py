"""Recorded evidence behind each case: value, reference, window, rule and policy version, or a stated absence."""

from pyspark.sql import Column, DataFrame, functions as F

from steadyline.config import Policy

PROVENANCE = ["metric", "value", "reference", "window_start", "window_end", "rule", "policy_version"]


def factors(cases: DataFrame, features: DataFrame, policy: Policy) -> DataFrame:
    """One row per case and rule that held on the case day."""
    day = F.col("case_day")

    def factor(hit: Column, metric: str, value: Column, reference: Column, far: int, near: int, rule: str) -> Column:
        return F.when(
            F.coalesce(hit, F.lit(False)),
            F.struct(
                F.lit(metric).alias("metric"),
                value.cast("double").alias("value"),
                F.round(reference.cast("double"), 6).alias("reference"),
                F.date_sub(day, far).alias("window_start"),
                F.date_sub(day, near).alias("window_end"),
                F.lit(rule).alias("rule"),
            ),
        )

    base = policy.baseline_days
    evidence = F.array(
        factor(F.col("load_z") >= policy.factor_z, "load", F.col("load"), F.col("load_mean"), base, 1,
               "load_above_own_normal"),
        factor(F.col("errors_z") >= policy.factor_z, "errors", F.col("errors"), F.col("errors_mean"), base, 1,
               "errors_above_own_normal"),
        factor(F.col("busy"), "rest", F.col("rest_gap"), F.lit(policy.busy_run), policy.busy_run - 1, 0, "no_free_day"),
        factor(
            F.col("load_mean") >= policy.drift_ratio * F.col("load_lagged_mean"), "drift",
            F.round("load_mean", 6), F.col("load_lagged_mean"), policy.lag_far, policy.lag_near, "normal_has_drifted_up",
        ),
    )
    at_case = features.select(
        "entity_id", F.col("day").alias("case_day"), "load", "load_mean", "errors", "errors_mean", "errors_z",
        "rest_gap", "busy", "load_lagged_mean",
    )
    joined = cases.select("case_id", "entity_id", "case_day", "load_z", "policy_version").join(
        at_case, ["entity_id", "case_day"]
    )
    rows = joined.select("case_id", "policy_version", F.explode(F.filter(evidence, lambda f: f.isNotNull())).alias("f"))
    return rows.select("case_id", *[F.col(f"f.{c}").alias(c) for c in PROVENANCE[:-1]], "policy_version")


def strength(factor: Column) -> Column:
    """Relative distance of value from reference."""
    return F.abs(factor["value"] - factor["reference"]) / F.greatest(F.abs(factor["reference"]), F.lit(1.0))


def explain(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Factors nested under the case, strongest first (a case has at most one per rule)."""
    item = F.struct("value", "reference", "metric")
    with_strength = found.withColumn("_item", F.struct((-F.round(strength(item), 6)).alias("s"), *PROVENANCE))
    nested = with_strength.groupBy("case_id").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    clean = F.transform("_items", lambda i: F.struct(*[i[c].alias(c) for c in PROVENANCE]))
    return cases.join(nested.select("case_id", clean.alias("factors")), "case_id", "left")


def explain_or_absent(cases: DataFrame, found: DataFrame) -> DataFrame:
    """As ``explain``, with the absence of evidence said in so many words."""
    explained = explain(cases, found)
    status = F.when(F.col("factors").isNull(), F.lit("not_recorded")).otherwise(F.lit("recorded"))
    return explained.withColumn("explanation_status", status)


def factor_count(cases: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy("case_id").agg(F.count("*").alias("_n"))
    return cases.join(counts, "case_id", "left").withColumn("factors", F.coalesce("_n", F.lit(0))).drop("_n")


def policy_at(cases: DataFrame, policies: DataFrame, last_day: Column) -> DataFrame:
    """Policy valid on the case day (valid_from inclusive, valid_to exclusive, open end allowed).

    The few validity intervals become one row per day, so this is an equi-join and not an interval scan per case. A day
    with two valid policies is refused, as it would count its cases twice.
    """
    end = F.least(F.date_sub(F.coalesce("valid_to", F.date_add(last_day, 1)), 1), last_day)
    per_day = policies.withColumn("_end", end).filter(F.col("_end") >= F.col("valid_from")).select(
        F.col("policy_version").alias("valid_version"), F.explode(F.sequence("valid_from", "_end")).alias("case_day")
    )
    several = F.raise_error(F.concat(F.lit("several policies are valid on "), F.col("case_day").cast("string")))
    per_day = per_day.groupBy("case_day").agg(F.count("*").alias("_n"), F.min("valid_version").alias("_version"))
    per_day = per_day.select("case_day", F.when(F.col("_n") == 1, F.col("_version")).otherwise(several.cast("string")).alias("valid_version"))
    # one row per calendar day, so it may be broadcast
    return cases.join(F.broadcast(per_day), "case_day", "left")


def untraceable(found: DataFrame) -> DataFrame:
    """Factors with a gap in their provenance; must be empty."""
    gap = F.lit(False)
    for column in PROVENANCE:
        gap = gap | F.col(column).isNull()
    return found.filter(gap)
