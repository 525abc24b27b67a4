"""From departures to a bounded set of cases: scores, materiality, persistence, recovery, repeats, capacity."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyline.config import Policy
from steadyline.functions.frames import by_day
from steadyline.functions.ordered import Ordered
from steadyline.sources.staging import staged


def rule_score(features: DataFrame, policy: Policy) -> DataFrame:
    """Count of simple operating rules that hold; NULL where the day cannot be judged."""
    def holds(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    points = holds(F.col("load_z") >= policy.rule_z) + holds(F.col("errors_z") >= policy.rule_z) + holds(F.col("busy"))
    return features.withColumn("rule_score", F.when(F.col("load_mean").isNotNull() & F.col("load").isNotNull(), points))


def temporal_score(features: DataFrame, policy: Policy) -> DataFrame:
    """Fixed weights on departures and slope; nothing is fitted."""
    def part(column: str, weight: float) -> Column:
        exact = F.coalesce(F.col(column), F.lit(0.0)).cast("decimal(18,6)")
        return exact * F.lit(str(weight)).cast("decimal(4,3)")

    # the inputs have six digits; decimal products keep them exact, so equal days get equal scores
    value = part("load_z", policy.w_load) + part("errors_z", policy.w_errors) + part("load_slope7", policy.w_slope)
    judged = F.col("load_mean").isNotNull() & F.col("load").isNotNull()
    return features.withColumn("temporal_score", F.when(judged, value.cast("double")))


def concern_level(z: Column, policy: Policy) -> Column:
    return (
        F.when(z >= policy.high_z, F.lit("high")).when(z >= policy.moderate_z, F.lit("moderate")).otherwise(F.lit("low"))
    )


def level_rank(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "moderate", 2).otherwise(1)


def material(deviations: DataFrame, metric: str, policy: Policy) -> DataFrame:
    """Is the rise large against the own spread, and more than the group's own rise? NULL stays NULL.

    A constant history has no spread; then the size of the rise alone decides.
    """
    large = F.when(F.col(f"{metric}_sd") > 0, F.col(f"{metric}_z") >= policy.min_z).when(
        F.col(f"{metric}_sd") == 0, F.lit(True)
    )
    rise = (F.col(f"{metric}_dev") >= policy.min_abs) & (F.col(f"{metric}_excess") > 0)
    return deviations.withColumn("material", large & rise)


def with_recovery(flags: DataFrame, policy: Policy) -> DataFrame:
    """Add ``calm_from``: the next day on which ``recover_days`` observed days in a row were not material."""
    n = policy.recover_days
    recent = by_day().rowsBetween(-(n - 1), 0)
    calm = (F.count(F.when(~F.col("material"), 1)).over(recent) == n)
    # latest first: "all later days" then grows row by row and is not recomputed for each
    later = Window.partitionBy("entity_id").orderBy(F.desc("day_no")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        flags.filter(F.col("material").isNotNull())
        .withColumn("_calm", F.when(calm, F.col("day")))
        .withColumn("calm_from", F.min("_calm").over(later))
        .drop("_calm")
    )


def episodes(flags: DataFrame, policy: Policy) -> DataFrame:
    """Runs of material observed days, at least ``persist_days`` long.

    Unobserved days are not in the sequence, so they neither lengthen nor break a run. ``case_day`` is the day on
    which the run reached the needed length; the scores are those of that day.
    """
    seen = flags.filter(F.col("material").isNotNull())
    position = F.row_number().over(by_day())
    runs = (
        seen.withColumn("_seq", position)
        .filter("material")
        .withColumn("_island", F.col("_seq") - F.row_number().over(by_day()))
        .withColumn(
            "_nth", F.row_number().over(Window.partitionBy("entity_id", "_island").orderBy("day_no"))
        )
    )
    admitted = F.col("_nth") == policy.persist_days

    def at_admission(column: str) -> Column:
        return F.max(F.when(admitted, F.col(column))).alias(column)

    found = runs.groupBy("entity_id", "group_id", "_island").agg(
        F.min("day").alias("start_day"),
        F.max("day").alias("end_day"),
        F.count("*").alias("length"),
        F.max(F.when(admitted, F.col("day"))).alias("case_day"),
        F.max("calm_from").alias("recovered_day"),
        *[at_admission(c) for c in ("load_z", "load_dev", "load_excess", "rule_score", "temporal_score")],
    )
    return found.filter(F.col("length") >= policy.persist_days).drop("_island")


def case_id(entity: Column, day: Column, version: str) -> Column:
    return F.sha2(F.concat_ws("#", entity.cast("string"), day.cast("string"), F.lit(version)), 256)


def candidates(found: DataFrame, policy: Policy) -> DataFrame:
    """Episodes as case candidates: stable id, level and ranking score."""
    return found.withColumns(
        {
            "case_id": case_id(F.col("entity_id"), F.col("case_day"), policy.version),
            "level": concern_level(F.coalesce("load_z", F.lit(0.0)), policy),
            "score": F.col("rule_score") + F.col("temporal_score"),
            "policy_version": F.lit(policy.version),
        }
    )


def retired(found: DataFrame, policy: Policy) -> Column:
    """True where the episode resolved by itself within the waiting time, before anyone would have acted."""
    return F.coalesce(F.col("recovered_day") <= F.date_add("case_day", policy.retire_within), F.lit(False))


def mark_repeats(found: DataFrame, policy: Policy) -> DataFrame:
    """Greedy per entity: a candidate within ``cooldown`` days of the last *kept* one is a repeat.

    A plain lag would compare with the last candidate, kept or not. An entity has at most one candidate per day, so the
    folded array is bounded by the calendar; one pass, no join.
    """
    rest = [c for c in found.columns if c not in ("entity_id", "case_day")]
    per_entity = found.groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct("case_day", *rest))).alias("_candidates")
    )
    kept = F.aggregate(
        "_candidates",
        F.array().cast("array<date>"),
        lambda acc, c: F.when(
            (F.size(acc) == 0) | (F.date_diff(c["case_day"], F.try_element_at(acc, F.lit(-1))) > policy.cooldown),
            F.concat(acc, F.array(c["case_day"])),
        ).otherwise(acc),
    )
    rows = per_entity.withColumn("_kept", kept).select("entity_id", "_kept", F.explode("_candidates").alias("_c"))
    return rows.select(
        "entity_id",
        *[F.col(f"_c.{c}").alias(c) for c in ("case_day", *rest)],
        (~F.array_contains("_kept", F.col("_c.case_day"))).alias("repeat"),
    )


def budget(found: DataFrame, k: int, by: str = "case_day") -> DataFrame:
    """The ``k`` strongest per ``by``, for any ``k``: ranks come from range-split chunks, so a crowded day is no hot spot."""
    ranked = Ordered(found, [by], [F.desc("score"), "case_id"], "budget").row_number("rank")
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("int")).select(*found.columns, "rank")


def admit(found: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(cases, ledger). Each candidate is either a case or in the ledger with the one reason it was dropped."""
    marked = staged(found.withColumn("_retired", retired(found, policy)), "candidates")
    live = mark_repeats(marked.filter("not _retired").drop("_retired"), policy)
    live = staged(live, "live")  # read by the ledger three times
    within = live.filter("not repeat").drop("repeat")
    cases = budget(within, policy.capacity_per_day)

    def dropped(df: DataFrame, reason: str) -> DataFrame:
        return df.select("case_id", "entity_id", "group_id", "case_day", "score", F.lit(reason).alias("reason"))

    ledger = (
        dropped(marked.filter("_retired"), "recovered")
        .unionByName(dropped(live.filter("repeat"), "cooldown"))
        .unionByName(dropped(within.join(cases.select("case_id"), "case_id", "left_anti"), "capacity"))
    )
    return cases, ledger


def report_effect(with_reports: DataFrame, without: DataFrame) -> DataFrame:
    """Absence of a voluntary report must never be evidence: cases with and without report rows must be the same."""
    a, b = staged(with_reports, "with_reports"), staged(without, "without_reports")
    gone, come = a.exceptAll(b), b.exceptAll(a)
    changed = gone.unionByName(come).agg(F.count("*").alias("changed"))
    return a.agg(F.count("*").alias("cases")).select("cases", changed.scalar().alias("changed"))


def burden(flags: DataFrame) -> DataFrame:
    """Share of judged entity-days that are flagged."""
    return flags.agg(
        F.count("material").alias("judged"),
        F.count_if("material").alias("flagged"),
        F.round(F.avg(F.col("material").cast("double")), 6).alias("share"),
    )


def funnel(flags: DataFrame, found: DataFrame, cases: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts from entity-days down to admitted cases, one row per stage."""
    daily = flags.agg(
        F.count("*").alias("entity_days"),
        F.count("load").alias("observed"),
        F.count("material").alias("judged"),
        F.count_if("material").alias("material"),
    )
    stages = ["entity_days", "observed", "judged", "material"]
    rows = daily.unpivot([], stages, "stage", "n")
    rows = rows.unionByName(found.agg(F.count("*").alias("n")).withColumn("stage", F.lit("persistent")))
    reasons = ledger.groupBy(F.concat(F.lit("dropped_"), "reason").alias("stage")).agg(F.count("*").alias("n"))
    return rows.unionByName(reasons).unionByName(
        cases.agg(F.count("*").alias("n")).withColumn("stage", F.lit("admitted"))
    )
