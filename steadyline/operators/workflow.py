"""Case states by replaying the action log.

The log is append-only; a batch replay finds what was valid, what was refused and why. Spark holds no row lock, so a
second writer is not stopped but recognised: the action carries the state its author saw.
"""

from pyspark.sql import Column, DataFrame, functions as F

from steadyline.functions.ordered import Ordered, replay_states, state_letters


def transition_table(df: DataFrame, transitions: list[tuple[str, str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(transitions, "action string, from_state string, to_state string")


def _state_name(number: Column, states: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in states]), number + 1)


def _moves(states, transitions) -> Column:
    """Struct (source, target): letters of the states that this action leaves and reaches.

    Looked up by action and expected state; a stated expectation narrows the move to that one state.
    """
    table, letter = {}, dict(zip(states, state_letters(len(states))))
    for action, a, b in transitions:
        source, target = table.get((action, "*"), ("", ""))
        table[(action, "*")] = (source + letter[a], target + letter[b])
        table[(action, a)] = (letter[a], letter[b])

    def move(source: str, target: str) -> Column:
        return F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"))

    entries = [c for (action, state), (a, b) in table.items() for c in (F.lit(f"{action}|{state}"), move(a, b))]
    key = F.concat_ws("|", F.col("action"), F.coalesce("expected_state", F.lit("*")))
    return F.coalesce(F.create_map(*entries)[key], move("", ""))


def replay(
    actions: DataFrame, states: list[str], transitions: list[tuple[str, str, str]], codes: list[str] | None = None
) -> DataFrame:
    """Each action with the state before and after it, whether it was accepted, and the reason if not.

    ``transitions``: (action, from, to) over ``states``, of which the first is where a case begins.
    ``actions`` columns: case_id, ts, seq (unique), action, expected_state (NULL: not stated), reason_code, ...
    With ``codes``, an action without a listed reason code is refused too.
    """
    reasoned = F.lit(True) if codes is None else F.coalesce(F.col("reason_code").isin(codes), F.lit(False))
    move = _moves(states, transitions)
    source, target = [F.when(reasoned, move[c]).otherwise(F.lit("")) for c in ("source", "target")]
    rows = replay_states(actions, "case_id", ["ts", "seq"], source, target, len(states), 0)
    before = _state_name(F.col("state_before"), states)
    moved = F.col("state_before") != F.col("state_after")
    refusal = (
        F.when(moved, F.lit(None).cast("string"))
        .when(~reasoned, F.lit("missing_reason"))
        .when(F.col("expected_state").isNotNull() & (F.col("expected_state") != before), F.lit("conflict"))
        .otherwise(F.lit("invalid_transition"))
    )
    return rows.select(
        *actions.columns,
        before.alias("from_state"),
        _state_name(F.col("state_after"), states).alias("to_state"),
        moved.alias("accepted"),
        refusal.alias("refusal"),
    )


def current_states(replayed: DataFrame) -> DataFrame:
    """Latest state per case."""
    last = F.max_by("to_state", F.struct("ts", "seq"))
    return replayed.groupBy("case_id").agg(last.alias("state"), F.count_if("accepted").alias("accepted_actions"))


def invalid_actions(replayed: DataFrame) -> DataFrame:
    return replayed.filter("not accepted").select("case_id", "seq", "action", "from_state", "to_state", "refusal")


def missing_reason(actions: DataFrame, codes: DataFrame) -> DataFrame:
    """Actions whose reason code is not in the list (or not given)."""
    return actions.join(codes, "reason_code", "left_anti")


def conflicts(replayed: DataFrame) -> DataFrame:
    """Writers who acted on a state that had already changed."""
    return replayed.filter(F.col("refusal") == "conflict").select(
        "case_id", "seq", "action", "expected_state", F.col("from_state").alias("actual_state")
    )


def history(replayed: DataFrame) -> DataFrame:
    """Accepted actions, numbered per case; a case with very many actions is spread over chunks."""
    accepted = replayed.filter("accepted").select("case_id", "ts", "seq", "action", "from_state", "to_state", "role")
    return Ordered(accepted, ["case_id"], ["ts", "seq"], "history").row_number("step")


def reopens(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("case_id").agg(
        F.count_if(F.col("accepted") & (F.col("to_state") == "closed")).alias("closed_times"),
        F.count_if(F.col("accepted") & (F.col("to_state") == "reopened")).alias("reopened_times"),
    )


def open_cases(states: DataFrame, found: DataFrame) -> DataFrame:
    """Recovered by the data, yet not closed by a person: still open. ``states`` is keyed by entity here."""
    recovered = found.groupBy("entity_id").agg(
        F.max_by("recovered_day", "start_day").alias("recovered_day"), F.max("start_day").alias("start_day")
    )
    return states.join(recovered, "entity_id").filter(
        F.col("recovered_day").isNotNull() & (F.col("state") != "closed")
    )


def feedback(submissions: DataFrame) -> DataFrame:
    """First submission per case and idempotency key; a replay changes nothing. Pre-aggregates, so replays cost little.

    A submission without a key is no replay of another one, so all of those stay.
    """
    rest = [c for c in submissions.columns if c not in ("case_id", "idempotency_key")]
    # one pass: without a key the submission's own number tells it from the others
    own = F.when(F.col("idempotency_key").isNull(), F.col("seq")).alias("_own")
    first = F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("_first")
    kept = submissions.groupBy("case_id", "idempotency_key", own).agg(first)
    return kept.select("case_id", "idempotency_key", *[F.col(f"_first.{c}").alias(c) for c in rest])


def graph_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Moves that only one of two graph definitions has."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("second"))
    )
