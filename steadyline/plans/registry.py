"""Every operator on the driver's tables, by inventory number."""

from pyspark.sql import functions as F

from steadyline.config import DEFAULT_POLICY as P
from steadyline.operators import access as X
from steadyline.operators import audit as H
from steadyline.operators import baselines as B
from steadyline.operators import explain as E
from steadyline.operators import followup as U
from steadyline.operators import intervals
from steadyline.operators import labels as L
from steadyline.operators import merkle
from steadyline.operators import models as M
from steadyline.operators import quality as Q
from steadyline.operators import queue as R
from steadyline.operators import ranking as K
from steadyline.operators import signals as A
from steadyline.operators import summary as S
from steadyline.operators import upkeep
from steadyline.operators import workflow as W
from steadyline.operators.asof import asof_join
from steadyline.plans import flow
from steadyline.sources import difference, guards, publish, staging
from steadyline.sources.staging import staged
from steadyline.sources.tables import read_table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def s1_records(spark, sf):
    return flow.records(spark, sf)


@query
def s2_entity_days(spark, sf):
    return flow.days(flow.records(spark, sf)).withColumn("value_sum", F.round("value_sum", 4))


@query
def q5_kept_summaries(spark, sf):
    """Line items by flag, summarised; then late items of one flag arrive, and only that flag is read again."""
    path = staging.new_location(spark, "items")
    items = read_table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    items.write.partitionBy("l_returnflag").parquet(path)
    rules = {"small": F.col("l_quantity") <= 45, "taxed": F.col("l_tax") > 0}
    first = upkeep.refreshed(spark, path, "l_returnflag", ["l_discount"], rules)
    items.where("l_returnflag = 'R' and l_quantity < 10").write.mode("append").partitionBy("l_returnflag").parquet(path)
    return upkeep.refreshed(spark, path, "l_returnflag", ["l_discount"], rules, first).drop(upkeep.FILES)


@query
def q6_spine(spark, sf):
    return flow.base(spark, sf).dense.drop("day_no").withColumn("value_sum", F.round("value_sum", 4))


@query
def b1_personal_baseline(spark, sf):
    out = B.personal_baseline(flow.base(spark, sf).dense, "load", P, median=True)
    return out.select(
        "entity_id", "day", "load", "load_n", F.round("load_mean", 6).alias("load_mean"),
        F.round("load_sd", 6).alias("load_sd"), "load_median",
    )


@query
def b2_lagged_baseline(spark, sf):
    out = B.lagged_baseline(flow.base(spark, sf).dense, "load", P)
    return out.select("entity_id", "day", F.round("load_lagged_mean", 6).alias("load_lagged_mean"))


@query
def b3_group_baseline(spark, sf):
    out = B.group_baseline(flow.base(spark, sf).dense, "load", P)
    return out.select("group_id", "day", *[F.round(c, 6).alias(c) for c in ("load_group_today", "load_group_mean")])


@query
def b4_deviation(spark, sf):
    of = flow.base(spark, sf)
    out = B.deviation(B.personal_baseline(flow.panel_with_context(of, P), "load", P), "load")
    return out.select("entity_id", "group_id", "day", "load_dev", "load_excess", "load_z")


@query
def b5_temporal_features(spark, sf):
    out = B.temporal_features(flow.base(spark, sf).dense, "load", P.busy_run)
    return out.select("entity_id", "day", "load_prev", "load_sum7", "load_slope7", "rest_gap", "busy")


@query
def b6_rest_gap(spark, sf):
    return B.rest_gaps(flow.records(spark, sf))


@query
def b7_entity_trend(spark, sf):
    own = B.own_z(B.personal_baseline(flow.base(spark, sf).dense, "load", P), "load")
    return B.entity_trend(own, "load").select(
        "entity_id", "day", F.col("load_z").alias("z_now"), F.col("load_z_then").alias("z_then"), "trend"
    )


def _flags(spark, sf):
    return flow.flags(flow.base(spark, sf), P)


def _found(spark, sf):
    return flow.found(_flags(spark, sf), P)


@query
def a1_rule_score(spark, sf):
    return _flags(spark, sf).select("entity_id", "day", "rule_score")


@query
def a2_temporal_score(spark, sf):
    return _flags(spark, sf).select("entity_id", "day", "temporal_score")


@query
def a4_concern_level(spark, sf):
    return _found(spark, sf).select("case_id", "load_z", "level")


@query
def a5_material(spark, sf):
    return _flags(spark, sf).select("entity_id", "day", "load_z", "load_excess", "material")


@query
def a6_persistent(spark, sf):
    return _found(spark, sf).select("entity_id", "group_id", "start_day", "end_day", "length", "case_day")


@query
def a7_recovery(spark, sf):
    return _found(spark, sf).select("entity_id", "start_day", "end_day", "recovered_day")


@query
def a8_dedupe(spark, sf):
    found = _found(spark, sf)
    return A.mark_repeats(found.filter(~A.retired(found, P)), P).select("case_id", "entity_id", "case_day", "repeat")


CASE_COLUMNS = [
    "case_id", "entity_id", "group_id", "case_day", "start_day", "end_day", "length", "recovered_day", "load_z",
    "load_dev", "load_excess", "rule_score", "temporal_score", "level", "score", "policy_version",
]


@query
def a9_budget(spark, sf):
    return A.admit(_found(spark, sf), P)[0].select(*CASE_COLUMNS, "rank")


@query
def a10_suppressed(spark, sf):
    return A.admit(_found(spark, sf), P)[1]


@query
def a11_burden(spark, sf):
    return A.burden(_flags(spark, sf))


@query
def a12_funnel(spark, sf):
    flags = staged(_flags(spark, sf), "flags")
    found = flow.found(flags, P)
    return A.funnel(flags, found, *A.admit(found, P))


@query
def a13_case_id(spark, sf):
    return _found(spark, sf).select("entity_id", "case_day", "case_id")


@query
def a14_no_report_effect(spark, sf):
    def cases(with_reports):
        found = flow.found(flow.flags(flow.base(spark, sf, with_reports), P), P)
        return A.admit(found, P)[0].select(*CASE_COLUMNS)

    return A.report_effect(cases(True), cases(False))


# ---- sources and sinks -----------------------------------------------------------------------------


@query
def s3_allowed_columns(spark, sf):
    customers = read_table(spark, sf, "customer")
    return guards.select_allowed(customers, ["c_custkey", "c_nationkey", "c_mktsegment"], ["c_name", "c_acctbal"])


@query
def s3_lineage_of_files(spark, sf):
    """Columns of a table that was staged, renamed, joined, staged and read again: whether ``props`` lies behind them."""
    events = read_table(spark, sf, "events")
    first = staged(events.select("event_id", "user_id", "value", F.length("props").alias("size")), "first")
    totals = first.groupBy("user_id").agg(F.max("size").alias("widest"), F.count("value").alias("n"))
    renamed = first.join(totals, "user_id").select("event_id", F.col("size").alias("harmless"), "widest", "n", (F.col("value") + F.col("n")).alias("shifted"))
    table = staged(renamed, "second")
    found = [(c, "props" in names) for c, names in guards.origins(table).items()]
    counts = table.select(*[F.col(c).cast("double") for c in table.columns]).unpivot([], table.columns, "column", "value")
    marks = spark.createDataFrame(found, "column string, refused boolean")
    return counts.groupBy("column").agg(F.count("value").alias("rows")).join(marks, "column").select("column", "refused", "rows")


def _published(spark, sf):
    cases, ledger = A.admit(_found(spark, sf), P)
    path = staging.new_location(spark, "publish")
    exports = {
        "cases": publish.Export(cases, CASE_COLUMNS, "case_day"),
        "ledger": publish.Export(ledger, ["case_id", "group_id", "case_day", "reason"]),
    }
    publish.publish(exports, path, "2024-01-30", "none", forbidden=["reports", "signup", "label"])
    return path


@query
def s4_publish(spark, sf):
    return publish.read_verified(spark, _published(spark, sf), "cases").select(*CASE_COLUMNS)


@query
def s5_manifest(spark, sf):
    """A published table behind its manifest: each file listed with its length and hash, and the rows that they hold."""
    path = staging.new_location(spark, "publish")
    talk = publish.Export(read_table(spark, sf, "conversations"), ["conv_id", "turn", "role", "text"])
    publish.publish({"talk": talk}, path, "2024-01-30", "none")
    files = spark.read.parquet(path + "/manifest")
    held = publish.fingerprint(publish.read_verified(spark, path, "talk")).first()
    whole = F.bool_and((F.length("sha256") == 64) & (F.col("length") > 0)).alias("listed")
    return files.groupBy(F.substring_index("file", "/", 1).alias("dataset")).agg(whole).select(
        "dataset", "listed", F.lit(held["rows"]).cast("bigint").alias("rows"), F.lit(held["digest"]).alias("digest")
    )


@query
def s6_verify_manifest(spark, sf):
    """The files as they are, and against a manifest that names other hashes, lacks files and lists files never written."""
    path = _published(spark, sf)
    actual, stored = publish.manifest(spark, path + "/data"), spark.read.parquet(path + "/manifest")
    table = F.substring_index("file", "/", 1).alias("dataset")
    parts = [
        publish.verify_manifest(actual, expected).groupBy(table, "status").agg(F.lit(name).alias("against")).distinct()
        for name, expected in (("stored", stored), ("altered", _altered(stored)))
    ]
    return parts[0].unionByName(parts[1])


def _altered(stored):
    """Of a manifest: other hashes for the ledger, no cases, and the ledger's files once more under another name."""
    ledger = stored.filter(F.col("file").startswith("ledger/"))
    moved = ledger.withColumn("file", F.regexp_replace("file", "^ledger/", "lost/"))
    return ledger.withColumn("sha256", F.sha2("sha256", 256)).unionByName(moved)


@query
def s7_same_content(spark, sf):
    """Two runs of the entity-days, every column; sums are exact decimals, which do not depend on the order of rows."""
    def run():
        exact = flow.records(spark, sf).withColumn("value", F.col("value").cast("decimal(18,6)"))
        return flow.days(exact)

    return publish.same_content(staged(run(), "run_a"), staged(run(), "run_b"))


@query
def s7_row_differences(spark, sf):
    """Which entity-days differ between two runs, one of which lost a day, gained one and counted some loads anew."""
    days = staged(flow.days(flow.records(spark, sf)).select("entity_id", "day", "load", "errors"), "days")
    day = F.dayofmonth("day")
    moved = F.when((day == 1) & (F.col("entity_id") % 10 == 2), F.date_add("day", 400)).otherwise(F.col("day"))
    again = days.where(~((day == 5) & (F.col("entity_id") % 10 == 7))).select(
        "entity_id", moved.alias("day"), F.when((day == 9) & (F.col("entity_id") % 10 == 3), F.col("load") + 1).otherwise(F.col("load")).alias("load"), "errors"
    )
    return difference.row_differences(days, again, ["entity_id", "day"])


@query
def s8_fingerprint(spark, sf):
    return publish.fingerprint(read_table(spark, sf, "conversations"))


@query
def s9_nonfinite(spark, sf):
    return guards.nonfinite_counts(read_table(spark, sf, "lineitem"))


@query
def s10_ambiguous(spark, sf):
    """Ambiguous names of a join of two tables as they come, next to its size."""
    orders, lines = (read_table(spark, sf, t) for t in ("orders", "lineitem"))
    joined = orders.withColumn("comment", F.lit("o")).join(
        lines.withColumn("COMMENT", F.lit("l")).withColumn("o_orderkey_y", F.col("l_orderkey")), F.col("o_orderkey") == F.col("l_orderkey")
    )
    names = len(guards.ambiguous_columns(joined))
    return joined.agg(F.count("*").alias("rows")).select("rows", F.lit(names).alias("ambiguous"))


@query
def s11_currency(spark, sf):
    cases = flow.cases_of(spark, sf)
    as_of = flow.days(flow.records(spark, sf)).agg(F.max("day").alias("d")).scalar()
    return publish.currency(cases, as_of)


@query
def s12_append_actions(spark, sf):
    log, path = flow.actions(spark, sf), staging.new_location(spark, "action_log")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    publish.append_actions(log.filter(F.col("ts") < middle), path, "first")
    for _ in range(2):  # the second batch is sent again
        publish.append_actions(log.filter(F.col("ts") >= middle), path, "second")
    stored = spark.read.parquet(path)
    return stored.groupBy("day", "action").agg(F.count("*").alias("n"))


# ---- data quality ------------------------------------------------------------------------------------

BOUNDS = {"l_quantity": (1, 45), "l_discount": (0.0, 0.08), "l_extendedprice": (0.0, 90000.0)}
PLAUSIBLE = {
    "returned_is_finished": "not (l_returnflag = 'R' and l_linestatus = 'O')",
    "discount_below_price": "l_discount * l_extendedprice < l_extendedprice",
}
SEVERITY = [
    ("range_l_quantity", "warning"), ("range_l_discount", "warning"), ("range_l_extendedprice", "warning"),
    ("returned_is_finished", "warning"), ("discount_below_price", "error"), ("duplicate_key", "error"),
    ("orphan_l_orderkey", "error"), ("orphan_l_partkey", "notice"),
]
LINE_KEY = ["l_orderkey", "l_linenumber"]


@query
def q1_completeness(spark, sf):
    return Q.completeness(flow.base(spark, sf).dense, ["load", "errors", "value_sum"])


@query
def q2_range_check(spark, sf):
    return Q.range_check(read_table(spark, sf, "lineitem"), BOUNDS)


@query
def q3_plausibility(spark, sf):
    return Q.plausibility(read_table(spark, sf, "lineitem"), PLAUSIBLE)


@query
def q4_consistency(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    return Q.consistency(read_table(spark, sf, "lineitem"), LINE_KEY, [("l_orderkey", orders, "o_orderkey")])


def _findings(spark, sf):
    return q2_range_check(spark, sf).unionByName(q3_plausibility(spark, sf)).unionByName(q4_consistency(spark, sf))


@query
def q5_quality_summary(spark, sf):
    return Q.quality_summary(_findings(spark, sf), spark.createDataFrame(SEVERITY, "rule string, severity string"))


@query
def q7_gate(spark, sf):
    """Some rows get a NULL in their key: they must not pass."""
    lines = read_table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount")
    lines = lines.withColumn("l_linenumber", F.when(F.col("l_orderkey") % 50 != 0, F.col("l_linenumber")))
    return Q.gate(lines, LINE_KEY, F.col("l_discount") > 0.08)


# ---- access ----------------------------------------------------------------------------------------------

KEY = "demo-key"  # for the driver's made-up customers; a real key comes from a vault


def _roster(spark, sf):
    customers = read_table(spark, sf, "customer")
    return customers.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("group_id"))


def _rights(spark, sf):
    return flow.accounts(spark, sf), flow.matrix(spark)


@query
def p1_pseudonymise(spark, sf):
    return X.pseudonymise(_roster(spark, sf), "entity_id", KEY).withColumnRenamed("entity_id", "pseudonym")


@query
def p2_reidentify(spark, sf):
    identities = _roster(spark, sf).select("entity_id", X.pseudonym("entity_id", KEY).alias("pseudonym"))
    return X.reidentify(p1_pseudonymise(spark, sf), identities, "reviewer-1", *_rights(spark, sf), "support")


@query
def p3_strip_ids(spark, sf):
    return X.strip_ids(read_table(spark, sf, "customer"), ["c_custkey", "c_name"])


@query
def p4_authorised(spark, sf):
    """Three requests; the middle one holds a purpose that its role must not have, so it gets nothing."""
    asked = [("reviewer-1", "support"), ("lead-4", "support"), ("lead-4", "aggregate")]
    parts = [
        X.authorised(_roster(spark, sf), account, *_rights(spark, sf), purpose)
        .select("entity_id", "group_id", F.lit(account).alias("account_id"), F.lit(purpose).alias("purpose"))
        for account, purpose in asked
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def p5_effective_purpose(spark, sf):
    accounts = flow.accounts(spark, sf)
    declared = F.explode(F.array(*[F.lit(p) for _, p in flow.ROLE_PURPOSES])).alias("declared")
    return X.effective_purpose(accounts.select("account_id", declared), accounts)


@query
def p6_lookup(spark, sf):
    """Each customer is asked for, and as many identifiers that do not exist."""
    ids = F.explode(F.array(F.col("entity_id"), -F.col("entity_id") - 1)).alias("entity_id")
    scoped = X.authorised(_roster(spark, sf), "reviewer-2", *_rights(spark, sf), "support")
    return X.lookup(_roster(spark, sf).select(ids), scoped)


@query
def p7_redact(spark, sf):
    return X.redact(read_table(spark, sf, "documents").select("doc_id", "text"), "text")


def _queue(spark, sf):
    cases = flow.cases_of(spark, sf)
    return flow.cases_with_state(spark, sf, cases)


@query
def p8_filter_queue(spark, sf):
    """Each filter by itself, and all together."""
    steep = F.when(F.col("load_z") >= 2.5, F.lit("rising")).otherwise(F.lit("steady"))
    rows = staged(_queue(spark, sf).withColumn("trend", steep), "queue")
    filters = {
        "search": {"search": "1"}, "groups": {"groups": list(range(12))}, "levels": {"levels": ["moderate"]},
        "states": {"states": ["open", "acknowledged", "reopened"]}, "changes": {"changes": ["rising"]}, "first": {"first": "2024-01-18"}, "last": {"last": "2024-01-22"},
    }
    filters["all"] = {k: v for one in filters.values() for k, v in one.items()} | {"levels": ["moderate", "high"]}
    parts = [X.filter_queue(rows, **kw).select("case_id", F.lit(name).alias("filter")) for name, kw in filters.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def p9_directory(spark, sf):
    return X.directory(_roster(spark, sf), "reviewer-3", *_rights(spark, sf), "support")


@query
def p10_invalid_accounts(spark, sf):
    accounts = flow.accounts(spark, sf)
    return X.invalid_accounts(accounts, flow.matrix(spark))


@query
def p11_aggregate_only(spark, sf):
    """Rows left for a support purpose and for the aggregate purpose."""
    roster = _roster(spark, sf)
    parts = [
        X.enforce_aggregate_only(roster, p).agg(F.count("*").alias("rows")).withColumn("purpose", F.lit(p))
        for p in ("support", "aggregate")
    ]
    return parts[0].unionByName(parts[1])


@query
def p12_search_groups(spark, sf):
    return X.search_groups(flow.groups(spark, sf), "NATION_1")


@query
def p13_scope_counts(spark, sf):
    return X.scope_counts(_roster(spark, sf), flow.accounts(spark, sf))


# ---- explanation -----------------------------------------------------------------------------------------

FACTOR_COLUMNS = ["case_id", "metric", "value", "reference", "window_start", "window_end", "rule", "policy_version"]


def _explained(spark, sf):
    flagged, cases = flow.flags_and_cases(spark, sf)
    return cases, E.factors(cases, flagged, P)


@query
def e1_factors(spark, sf):
    return _explained(spark, sf)[1].select(*FACTOR_COLUMNS)


@query
def e2_explain(spark, sf):
    """Every case with its nested factors in order, one row for each; a case without any has one row of NULLs."""
    nested = E.explain(*_explained(spark, sf)).select("case_id", F.posexplode_outer("factors").alias("place", "f"))
    return nested.select("case_id", "place", *[F.col(f"f.{c}").alias(c) for c in FACTOR_COLUMNS if c != "case_id"])


@query
def e3_explain_or_absent(spark, sf):
    cases, found = _explained(spark, sf)
    return E.explain_or_absent(cases, found).select("case_id", "explanation_status")


@query
def e4_factor_count(spark, sf):
    return E.factor_count(*_explained(spark, sf)).select("case_id", "factors")


@query
def e5_policy_at(spark, sf):
    cases = flow.cases_of(spark, sf)
    policies = spark.createDataFrame(
        [("v1", "2024-01-01", "2024-01-16"), ("v2", "2024-01-16", None)], "policy_version string, f string, t string"
    ).select("policy_version", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))
    last_day = cases.agg(F.max("case_day").alias("d")).scalar()
    return E.policy_at(cases, policies, last_day).select("case_id", "case_day", "valid_version")


@query
def e6_untraceable(spark, sf):
    found = _explained(spark, sf)[1]
    return found.agg(F.count("*").alias("factors")).select(
        "factors", E.untraceable(found).agg(F.count("*").alias("n")).scalar().alias("untraceable")
    )


# ---- queue -----------------------------------------------------------------------------------------------


@query
def r1_queue(spark, sf):
    cases = flow.cases_of(spark, sf)
    return R.queue(cases).select("case_day", "level", "case_id")


@query
def r2_queue_for(spark, sf):
    cases = flow.cases_of(spark, sf)
    return R.queue_for(cases, "reviewer-all", *_rights(spark, sf), "support", 10).select("case_day", "level", "case_id")


@query
def r3_staleness(spark, sf):
    flagged, cases = flow.flags_and_cases(spark, sf)
    as_of = flagged.agg(F.max("day").alias("d")).scalar()
    return R.staleness(cases, as_of, P, flow.OLDER).select("case_id", "age_days", "stale", "chip")


@query
def r4_queue_header(spark, sf):
    status = U.followup_status(flow.followups(spark, sf), flow.order_as_of(spark, sf))
    due = status.agg(F.count_if(F.col("status").isin("due", "overdue")).alias("n"))
    warnings = _findings(spark, sf).join(
        spark.createDataFrame(SEVERITY, "rule string, severity string").filter("severity = 'warning'"), "rule"
    )
    return R.queue_header(_queue(spark, sf), due, warnings.agg(F.sum("n").cast("bigint").alias("n")))


@query
def r5_surfacing_reason(spark, sf):
    return R.surfacing_reason(E.explain(*_explained(spark, sf)), flow.UNSURFACED).select("case_id", "surfaced")


@query
def r6_signal_drift(spark, sf):
    flagged, cases = flow.flags_and_cases(spark, sf)
    return R.signal_drift(cases, flagged).select("case_id", "case_day", "signal_day", "signal", "differs")


# ---- workflow --------------------------------------------------------------------------------------------


@query
def w1_current_state(spark, sf):
    return W.current_states(flow.replayed(spark, sf))


@query
def w2_invalid_actions(spark, sf):
    return W.invalid_actions(flow.replayed(spark, sf))


@query
def w3_missing_reason(spark, sf):
    codes = spark.createDataFrame([(c,) for c in flow.REASON_CODES], "reason_code string")
    return W.missing_reason(flow.actions(spark, sf), codes).select("case_id", "seq", "action", "reason_code")


@query
def w4_conflicts(spark, sf):
    return W.conflicts(flow.replayed(spark, sf))


@query
def w5_history(spark, sf):
    return W.history(flow.replayed(spark, sf)).select("case_id", "seq", "action", "from_state", "to_state", "step")


@query
def w6_reopens(spark, sf):
    return W.reopens(flow.replayed(spark, sf))


@query
def w7_open_cases(spark, sf):
    states = W.current_states(flow.replayed(spark, sf)).select(F.col("case_id").alias("entity_id"), "state")
    return W.open_cases(states, _found(spark, sf)).select("entity_id", "state", "recovered_day")


@query
def w8_feedback(spark, sf):
    """Actions as feedback, keyed by their reason code, R11 standing for no key; those with a key come a second time."""
    key = F.when(F.col("reason_code") != "R11", F.col("reason_code")).alias("idempotency_key")
    log = flow.actions(spark, sf).select("case_id", key, "ts", "seq", "action")
    return W.feedback(log.unionByName(log.filter("idempotency_key is not null"))).select("case_id", "idempotency_key", "seq", "action")


# an older graph: cases could be closed unread, and not out of a running review
EARLIER_TRANSITIONS = [t for t in flow.TRANSITIONS if t != ("close", "in_review", "closed")] + [("close", "open", "closed")]


@query
def w9_graph_drift(spark, sf):
    """Moves seen in the log against an earlier declared graph."""
    log = flow.replayed(spark, sf).filter("accepted")
    seen = log.groupBy("action", "from_state", "to_state").agg(F.lit(1).alias("_x")).drop("_x")
    return W.graph_drift(staged(seen, "seen"), W.transition_table(seen, EARLIER_TRANSITIONS))


# ---- support and follow-up -------------------------------------------------------------------------------


def _feasible(spark, sf, cases):
    return U.feasibility(cases, U.duty_days(flow.duties(spark, sf)), flow.FEASIBILITY)


@query
def f1_support_options(spark, sf):
    found = _explained(spark, sf)[1]
    out = U.support_options(found, U.mapping_table(found, flow.SUPPORT_MAPPING))
    return out.select("case_id", "mapping_version", F.concat_ws(",", "options").alias("options"))


@query
def f2_feasibility(spark, sf):
    cases = flow.cases_of(spark, sf)
    return _feasible(spark, sf, cases).select("case_id", "busy_days", "first_free", "feasibility")


MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
HOUR = 3_600_000_000


@query
def f2_busy_time(spark, sf):
    """Per case: the duties that reach into the three days after it, and for how many seconds."""
    cases = flow.cases_of(spark, sf).select("case_id", "entity_id", F.date_add("case_day", 1).cast("timestamp_ntz").alias("from_ts"))
    window = cases.select("case_id", "entity_id", F.expr(MICROS.format("from_ts")).alias("w0")).withColumn("w1", F.col("w0") + 72 * HOUR)
    duties = flow.duties(spark, sf).select("entity_id", F.expr(MICROS.format("start_ts")).alias("d0"), F.expr(MICROS.format("end_ts")).alias("d1"))
    met = intervals.overlap_join(window, duties, ["entity_id"], ("w0", "w1"), ("d0", "d1"), HOUR)
    length = intervals.overlap_length(("w0", "w1"), ("d0", "d1"))
    sums = met.groupBy("case_id").agg(F.count("*").alias("duties"), F.sum(length).alias("micros"))
    return cases.select("case_id").join(sums, "case_id", "left").select(
        "case_id", F.coalesce("duties", F.lit(0)).cast("bigint").alias("duties"),
        F.floor(F.coalesce("micros", F.lit(0)) / 1_000_000).cast("bigint").alias("seconds"),
    )


@query
def f3_followup_status(spark, sf):
    return U.followup_status(flow.followups(spark, sf), flow.order_as_of(spark, sf))


@query
def f4_requeue(spark, sf):
    cases = flow.cases_of(spark, sf)
    return U.requeue(cases, f3_followup_status(spark, sf))


@query
def f5_follow_through(spark, sf):
    return U.follow_through(flow.followups(spark, sf), _roster(spark, sf))


@query
def f6_next_step(spark, sf):
    cases, found = _explained(spark, sf)
    options = U.support_options(found, U.mapping_table(found, flow.SUPPORT_MAPPING))
    out = U.next_step(flow.cases_with_state(spark, sf, cases), options, _feasible(spark, sf, cases), flow.FEASIBILITY)
    return out.select("case_id", "state", "feasibility", "next_step")


# ---- summaries -------------------------------------------------------------------------------------------


@query
def g1_group_summary(spark, sf):
    cases = flow.cases_of(spark, sf)
    return S.group_summary(_roster(spark, sf), cases, _feasible(spark, sf, cases))


@query
def g2_group_trend(spark, sf):
    return S.group_trend(flow.base(spark, sf).dense, "week")


@query
def g3_concentration(spark, sf):
    cases = flow.cases_of(spark, sf)
    return S.concentration(cases)


@query
def g4_dashboard(spark, sf):
    cases = flow.cases_of(spark, sf)
    return S.dashboard(cases, flow.groups(spark, sf))


@query
def g5_timeline(spark, sf):
    flagged, cases = flow.flags_and_cases(spark, sf)
    return S.timeline(flagged, cases)


@query
def r6_asof_error(spark, sf):
    """To each purchase the same entity's last error up to it: which one, and how many whole minutes before."""
    events = read_table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    bought, failed = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "error"))
    met = asof_join(bought, failed, ["user_id"], "ts", "ts", "event_id", "event_id", ["event_id", "ts"])
    minutes = F.expr("timestampdiff(MINUTE, asof_ts, ts)").alias("minutes")
    return met.select("event_id", "user_id", F.col("asof_event_id").alias("error_id"), minutes)


# ---- audit -----------------------------------------------------------------------------------------------

SEGMENT = 4  # short, so that even short conversations span segments
AUDITED = ["role", "text"]


def _chain(spark, sf):
    return H.chain(read_table(spark, sf, "conversations"), "conv_id", "turn", AUDITED, SEGMENT)


def _tampered(spark, sf):
    """A text altered, an event dropped, a tail cut, an event doubled: each in some conversations. Returns (log, stored heads)."""
    intact = staged(_chain(spark, sf), "audit_log")
    c, t = F.col("conv_id") % 10, F.col("turn")
    altered = F.when((c == 3) & (t == 1), F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    log = intact.withColumn("text", altered).filter(~((c == 5) & (t == 1)) & ~((c == 7) & (t >= 2)))
    log = log.unionByName(log.filter((c == 8) & (t == 0)))
    return log, H.heads(intact, "conv_id", "turn")


@query
def h1_chain(spark, sf):
    return _chain(spark, sf).select("conv_id", "turn", "segment", "prev_hash", "hash")


@query
def h1_heads_seal(spark, sf):
    return H.seal(H.heads(_chain(spark, sf), "conv_id", "turn"), "conv_id")


EVENT_ORDER = ["conv_id", "turn"]


def _numbered(events):
    return staged(merkle.leaves(events, EVENT_ORDER, AUDITED), "log_leaves")


@query
def h1_log_seal(spark, sf):
    """Seals of the log when it held half of its events, and now; and whether it only grew in between."""
    numbered = _numbered(read_table(spark, sf, "conversations"))
    now = merkle.tree(numbered)
    half = merkle.tree(numbered.where(F.col("position") < max(1, now.size // 2)))
    grew = bool(now.size) and merkle.consistent(merkle.consistency(now, half.size), half.root(), now.root())
    return merkle.seal(half).unionByName(merkle.seal(now)).withColumn("only_grew", F.lit(grew))


def _rewritten(events):
    """Texts altered after the log was sealed."""
    hit = (F.col("conv_id") % 10 == 3) & (F.col("turn") == 1)
    return events.withColumn("text", F.when(hit, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))


@query
def h2_inclusion(spark, sf):
    """Each event, some of them altered, against the sealed root by the siblings on its way up."""
    events = read_table(spark, sf, "conversations")
    numbered = _numbered(events)
    sealed = merkle.tree(numbered)
    proven = merkle.proofs(sealed).join(numbered.select(*EVENT_ORDER, "position"), "position")
    return merkle.verified(_rewritten(events), proven, sealed.root(), EVENT_ORDER, AUDITED)


@query
def h3_altered_events(spark, sf):
    """Which events differ from the sealed log, found from the root down."""
    events = read_table(spark, sf, "conversations")
    numbered = _numbered(events)
    found = merkle.differing(merkle.tree(numbered), merkle.tree(_numbered(_rewritten(events))))
    return found.join(numbered, "position").select("position", *EVENT_ORDER)


@query
def h2_verify_chain(spark, sf):
    log, stored = _tampered(spark, sf)
    return H.verify_chain(log, "conv_id", "turn", AUDITED, SEGMENT, stored)


@query
def h3_first_break(spark, sf):
    log, stored = _tampered(spark, sf)
    return H.first_break(H.verify_chain(log, "conv_id", "turn", AUDITED, SEGMENT, stored), "conv_id", "turn")


@query
def h4_health(spark, sf):
    log, stored = _tampered(spark, sf)
    intact = H.verify_chain(staged(_chain(spark, sf), "log"), "conv_id", "turn", AUDITED, SEGMENT, stored)
    broken = H.verify_chain(log, "conv_id", "turn", AUDITED, SEGMENT, stored)
    path = _published(spark, sf)
    actual, written = publish.manifest(spark, path + "/data"), spark.read.parquet(path + "/manifest")
    good, bad = (publish.verify_manifest(actual, m) for m in (written, _altered(written)))
    parts = [
        H.health(rows, files).withColumns({"log": F.lit(log), "files": F.lit(name)})
        for log, rows in (("intact", intact), ("tampered", broken))
        for name, files in (("none", None), ("good", good), ("bad", bad))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def h5_action_trail(spark, sf):
    trail = flow.replayed(spark, sf).select("case_id", "ts", "seq", "role", "action", "purpose", "accepted")
    return H.action_trail(trail, ["case_id"])


@query
def h6_purpose_summary(spark, sf):
    log = flow.replayed(spark, sf)
    outcome = F.when(F.col("accepted"), F.lit("done")).otherwise(F.lit("refused"))
    return H.purpose_summary(log.withColumn("outcome", outcome))


# ---- labels, ranking, models -----------------------------------------------------------------------------


@query
def l1_forward_label(spark, sf):
    return flow.labelled(spark, sf).select("entity_id", "day", "label", "full_horizon")


@query
def l2_label_coverage(spark, sf):
    return L.label_coverage(flow.labelled(spark, sf))


@query
def l3_time_split(spark, sf):
    return flow.scored(spark, sf).select("entity_id", "day", "label", "split")


def _ranked(spark, sf, split=None):
    rows = flow.scored(spark, sf)
    return K.by_strategy(rows.filter(F.col("split") == split) if split else rows, flow.STRATEGIES)


PERCENTS = [1, 2, 5, 10]


@query
def m3_roc_auc(spark, sf):
    return K.roc_auc(K.sweep(_ranked(spark, sf)))


@query
def m4_average_precision(spark, sf):
    return K.average_precision(K.sweep(_ranked(spark, sf)))


@query
def m5_precision_at(spark, sf):
    return K.precision_at(_ranked(spark, sf), PERCENTS)


@query
def m6_f1_at(spark, sf):
    return K.f1_at(_ranked(spark, sf), {"rule_score": 1.0, "temporal_score": 0.5, "load": 4.0})


@query
def m7_sweep(spark, sf):
    return K.sweep(_ranked(spark, sf))


@query
def m8_select_threshold(spark, sf):
    return K.select_threshold(K.sweep(_ranked(spark, sf, "validation")), 0.4)


@query
def m9_compare(spark, sf):
    return K.compare(K.precision_at(_ranked(spark, sf), PERCENTS), PERCENTS)


@query
def m10_no_peek(spark, sf):
    dense = staged(flow.base(spark, sf).dense, "spine")
    cut = F.lit("2024-01-20").cast("date")
    columns = [
        "entity_id", "day", "load_mean", "load_sd", "load_z", "errors_z", "load_dev", "load_excess", "load_lagged_mean", "load_prev",
        "load_sum7", "load_slope7", "rest_gap", "busy", "rule_score", "temporal_score",
    ]
    changed = L.peek_differences(dense, lambda d: flow.features(flow.with_context(d, d, P), P).select(*columns), cut)
    return dense.filter(F.col("day") <= cut).agg(F.count("*").alias("compared")).select(
        "compared", changed.agg(F.count("*").alias("n")).scalar().alias("changed")
    )


# weights as a model would have stored them
STORED = {"load_z": 0.4, "errors_z": 0.15, "load_slope7": 0.3, "rest_gap": -0.2, "intercept": -0.5}


def _fitted(spark, sf, reg):
    train = flow.scored(spark, sf).filter("split = 'train'")
    return M.first_order(train, M.coefficients(M.fit_logreg(train, reg)), reg)


@query
def m1_logreg(spark, sf):
    return _fitted(spark, sf, 0.0)


@query
def m2_logreg_l2(spark, sf):
    return _fitted(spark, sf, 0.1)


@query
def a3_model_score(spark, sf):
    """How well a score from stored weights ranks, next to the fixed scores it is only one of."""
    rows = flow.scored(spark, sf)
    test = staged(M.stored_score(rows.filter("split = 'test'"), STORED), "model_scores")
    return K.roc_auc(K.sweep(K.by_strategy(test, flow.STRATEGIES + ["model_score"])))
