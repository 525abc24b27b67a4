"""The analysis run on the driver's tables, stage by stage.

``base``, ``cases_of``, ``flags_and_cases`` and ``scored`` write staged tables when called; the others only declare.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyline.config import DEFAULT_POLICY, Policy
from steadyline.operators import baselines as B, labels, panel, signals as A, workflow
from steadyline.sources.guards import select_allowed
from steadyline.sources.staging import staged
from steadyline.sources.tables import read_records, read_table

REPORT = "signup"  # voluntary report: labels only, never a feature
RECORD_COLUMNS = ["event_id", "ts", "entity_id", "event_type", "value"]
FORBIDDEN = ["props", "reports", "label"]  # may not reach a feature, under whatever name
ROLE_PURPOSES = [("reviewer", "support"), ("lead", "aggregate"), ("auditor", "audit"), ("operator", "infrastructure")]


def records(spark: SparkSession, sf_dir: str, with_reports: bool = True) -> DataFrame:
    """Operational records. Report rows are cut at the source: even an empty report-only day would shift baselines."""
    everything = read_records(spark, sf_dir)
    source = everything if with_reports else everything.filter(F.col("event_type") != REPORT)
    return select_allowed(source, RECORD_COLUMNS, FORBIDDEN).filter(F.col("event_type") != REPORT)


def report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voluntary reports per entity and day. Used by labels and evaluation only."""
    events = read_records(spark, sf_dir).filter(F.col("event_type") == REPORT)
    return events.groupBy("entity_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("reports"))


def days(facts: DataFrame) -> DataFrame:
    return panel.entity_days(
        facts,
        {
            "load": F.count("*"),
            "errors": F.count_if(F.col("event_type") == "error"),
            "value_sum": F.sum("value"),
        },
    )


@dataclass(frozen=True)
class Base:
    observed: DataFrame  # entity-days that have records, with their group
    members: DataFrame  # entities with their group
    dense: DataFrame  # every entity on every calendar day
    first_day: Column
    last_day: Column


def base(spark: SparkSession, sf_dir: str, with_reports: bool = True) -> Base:
    """Entities with records, each in its group; without a row in the dimension the group is NULL, and the entity stays."""
    # staged: the raw records are scanned once; roster, calendar and panel all read the small daily table
    daily = days(records(spark, sf_dir, with_reports))
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_key"), F.col("c_nationkey").alias("group_id"))
    observed = staged(daily.join(customers, F.col("entity_id") == F.col("_key"), "left").drop("_key"), "entity_days")
    members = observed.select("entity_id", "group_id").distinct()
    first, last = panel.observed_span(observed)
    dense = panel.spine(observed.drop("group_id"), members, first, last)
    return Base(observed.withColumn("day_no", F.unix_date("day")), members, dense, first, last)


def panel_with_context(of: Base, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The dense panel with group context; its rows are shuffled once, by entity."""
    calendar = panel.group_calendar(B.group_baseline(of.observed, "load", policy), of.members, of.first_day, of.last_day)
    return panel.spine_with_context(of.observed.drop("group_id", "day_no"), of.members, calendar)


def with_context(dense: DataFrame, observed: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Group context for a panel that is there already."""
    return B.with_group_context(dense, B.group_baseline(observed, "load", policy))


def features(dense: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """All columns of a judged day, from a panel with group context: one shuffle by entity, then windows only."""
    own = B.personal_baseline(dense, "load", policy)
    own = B.own_z(B.personal_baseline(own, "errors", policy), "errors")
    own = B.lagged_baseline(own, "load", policy)
    own = B.temporal_features(own, "load", policy.busy_run)
    judged = B.deviation(own, "load")
    return A.temporal_score(A.rule_score(judged, policy), policy)


def flags(of: Base, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return A.material(features(panel_with_context(of, policy), policy), "load", policy)


def found(flagged: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return A.candidates(A.episodes(A.with_recovery(flagged, policy), policy), policy)


def cases_of(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Admitted cases; staged, as they are few and most results join them more than once."""
    return staged(A.admit(found(flags(base(spark, sf_dir), policy), policy), policy)[0], "cases")


def flags_and_cases(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY) -> tuple[DataFrame, DataFrame]:
    """As ``cases_of``, with the judged panel staged as well, for results that read both."""
    flagged = staged(flags(base(spark, sf_dir), policy), "flags")
    return flagged, staged(A.admit(found(flagged, policy), policy)[0], "cases")


# ---- group dimension and accounts, derived from the region and nation tables ------------------------


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"), F.col("r_name").alias("region_name")
    )


def matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_PURPOSES, "role string, purpose string")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region a reviewer and a lead (the last lead holds a purpose its role must not have), and two accounts for all."""
    nation = read_table(spark, sf_dir, "nation")
    listed = F.sort_array(F.collect_set("n_nationkey")).alias("groups")
    regional, everywhere = nation.groupBy("n_regionkey").agg(listed), nation.agg(listed)

    def account(df, name, role, purposes):
        return df.select(name.alias("account_id"), F.lit(role).alias("role"), purposes.alias("purposes"), "groups")

    def held(*names):
        return F.array(*[F.lit(n) for n in names])

    region = F.col("n_regionkey")
    lead_purposes = F.when(region == 4, held("aggregate", "support")).otherwise(held("aggregate"))
    return (
        account(regional, F.concat(F.lit("reviewer-"), region), "reviewer", held("support"))
        .unionByName(account(regional, F.concat(F.lit("lead-"), region), "lead", lead_purposes))
        .unionByName(account(everywhere, F.lit("reviewer-all"), "reviewer", held("support")))
        .unionByName(account(everywhere, F.lit("auditor-all"), "auditor", held("audit")))
    )


# ---- action log, follow-ups, duties --------------------------------------------------------------------

ACTION_OF = {
    "view": "acknowledge",
    "click": "start_review",
    "purchase": "progress_support",
    "error": "close",
    "signup": "reopen",
}
REASON_CODES = [f"R{i}" for i in range(10)]
STATES = ["open", "acknowledged", "in_review", "support_planned", "support_completed", "closed", "reopened"]
TRANSITIONS = [
    ("acknowledge", "open", "acknowledged"),
    ("acknowledge", "reopened", "acknowledged"),
    ("start_review", "acknowledged", "in_review"),
    ("progress_support", "in_review", "support_planned"),
    ("progress_support", "support_planned", "support_completed"),
    ("close", "support_completed", "closed"),
    ("close", "in_review", "closed"),
    ("reopen", "closed", "reopened"),
]
SUPPORT_MAPPING = [
    ("load_above_own_normal", "review_workload", "m1"),
    ("errors_above_own_normal", "offer_practice_time", "m1"),
    ("no_free_day", "schedule_free_day", "m1"),
    ("normal_has_drifted_up", "review_workload", "m1"),
]
FEASIBILITY = ("now", "with_adjustment", "constrained")
OLDER = "older data: %d days"
UNSURFACED = "no new change; open until a person closes it"
LOG_ROLES = ["reviewer", "lead", "auditor"]
LOG_PURPOSES = ["support", "aggregate", "audit"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action log per entity: the event type gives the action, the number in ``props`` the rest."""
    events = read_table(spark, sf_dir, "events")
    action = F.lit(None).cast("string")
    for kind, name in ACTION_OF.items():
        action = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(action)
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    return events.withColumn("k", k).select(
        F.col("user_id").alias("case_id"),
        "ts",
        F.col("event_id").alias("seq"),
        action.alias("action"),
        F.when(F.col("k") % 4 == 0, _pick(STATES, F.col("k") % 7)).alias("expected_state"),
        F.concat(F.lit("R"), (F.col("k") % 12).cast("string")).alias("reason_code"),
        _pick(LOG_ROLES, F.col("k") % 3).alias("role"),
        _pick(LOG_PURPOSES, F.floor(F.col("k") / 2) % 3).alias("purpose"),
    )


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.replay(actions(spark, sf_dir), STATES, TRANSITIONS, REASON_CODES)


def cases_with_state(spark: SparkSession, sf_dir: str, cases: DataFrame) -> DataFrame:
    states = workflow.current_states(replayed(spark, sf_dir)).select(F.col("case_id").alias("entity_id"), "state")
    return cases.join(states, "entity_id", "left").withColumn("state", F.coalesce("state", F.lit("open")))


def followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated items: F is done, O is scheduled, P has no date yet."""
    orders = read_table(spark, sf_dir, "orders")
    due = F.when(F.col("o_orderstatus") != "P", F.date_add(F.to_date("o_orderdate"), 30))
    done = F.when(
        F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7 + 26).cast("int"))
    )
    return orders.select(
        F.col("o_orderkey").alias("followup_id"), F.col("o_custkey").alias("entity_id"), due.alias("due"), done.alias("done")
    )


def order_as_of(spark: SparkSession, sf_dir: str):
    return read_table(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate")).alias("d")).scalar()


def duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases as duties of ``value`` minutes."""
    events = read_records(spark, sf_dir).filter(F.col("event_type").isin("click", "purchase"))
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("value") * 60).cast("decimal(18,6)"))
    return events.select("entity_id", F.col("ts").alias("start_ts"), (F.col("ts") + length).alias("end_ts"))


def labelled(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    of = base(spark, sf_dir)
    return labels.forward_label(of.dense, report_days(spark, sf_dir), of.last_day, policy)


STRATEGIES = ["rule_score", "temporal_score", "load"]


def scored(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Judged entity-days with a full label horizon, split in time order; staged, as every metric reads it twice.

    Labels ride along the panel, so they share the shuffle by entity; no feature reads a report column.
    """
    of = base(spark, sf_dir)
    panel_rows = panel_with_context(of, policy)
    with_label = labels.forward_label(panel_rows, report_days(spark, sf_dir), of.last_day, policy).drop("reports")
    rows = features(with_label, policy).filter("full_horizon and label is not null and rule_score is not null")
    rows = staged(rows.withColumn("row_id", F.col("entity_id").cast("decimal(20,0)") * 100000 + F.col("day_no")), "judged")
    return labels.time_split(rows)
