"""Conversation structure repair by a suffix-shared DAWG.

Each row of a conversation is one letter: its role's initial and its fault. A conversation's letters are its signature.
Signatures are read from their ends: equal suffixes are one automaton node, which holds, for each state of the role
grammar ``(s?(ua)+)?``, the cost of the cheapest edits from there on and the first of them (ties: the ASCII-least). The
best audit suffix is then a path through shared nodes. Signatures come sorted by their reversed text, so a task meets
all that share a suffix one after the other and computes each node once; only what spans the border of two tasks is
computed in both.
"""

import hashlib
import os
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from steadyline.functions.ordered import CHUNK, KEY, Ordered
from steadyline.sources.staging import staged

BLANKS = " \t\n\x0b\x0c\r"  # \x20\x09-\x0D
INITIALS = "sua"  # any other initial is a fourth kind
FAULTS = ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5  # of a truncated row that stays
#: states of the grammar: nothing yet, after s, after u, after a; an end is allowed in the first and the last
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (NOTHING, AFTER_A)
SPEAKS = ("user", "user", "assistant", "user")  # whose turn it is where a row is inserted or gets another role
THEN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
NEVER = float("inf")


# ---- damage -------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after damage by CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops the row (it stays here, marked), 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes its role user.
    Null ids and turns stay null in the columns themselves.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    given = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return given.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("_kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_"),
    ).drop("_")


# ---- signatures ---------------------------------------------------------------------------------------


def _light(rows: DataFrame) -> DataFrame:
    """Rows without their texts: order, what decides on duplicates, and the letter as far as one row tells it."""
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        initial = F.when(F.col("role").startswith(letter), i).otherwise(initial)
    return rows.select(
        "conv_id", F.col("turn").isNotNull().cast("int").alias("has_turn"), "turn", "role", F.sha2("text", 256).alias("text_id"),
        initial.alias("initial"), fault.alias("fault"),
    )


ORDER = ["has_turn", "turn", "role", "text_id"]  # nulls first


def _letter(initial: Column, fault: Column) -> Column:
    return F.char((F.lit(ord("A")) + 4 * initial + fault).cast("bigint"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature), as a table: a letter for each row, in order of turn (nulls first), role and text's hash.

    A conversation is cut into chunks like any long key, so a task holds chunks and never all rows of a conversation; its
    signature, one byte for each row, is one value.
    """
    light = _light(rows)
    # blank rows are no duplicates, so theirs may be spread; a repeat is every row but the first of one role and text
    spread = F.when(F.col("fault") == 1, F.pmod(F.xxhash64("turn"), F.lit(1024))).otherwise(0)
    alike = Window.partitionBy("conv_id", "role", "text_id", spread).orderBy("has_turn", "turn")
    repeated = (F.col("fault") != 1) & (F.row_number().over(alike) > 1)
    marked = light.withColumn("repeat", repeated).select(
        "conv_id", *ORDER, "repeat", _letter(F.col("initial"), F.when(F.col("repeat"), 2).otherwise(F.col("fault"))).alias("letter")
    )
    # of equal rows the one that is no repeat comes first; the others are interchangeable
    order = [*ORDER, "repeat"]
    run = Ordered(staged(marked, "letters"), ["conv_id"], order, "conversation_rows")
    placed = run.df.withColumn("_at", F.row_number().over(Window.partitionBy(CHUNK, KEY).orderBy(*order)))
    turns = F.when(F.col("turn").isNotNull(), F.col("turn"))
    chunks = placed.groupBy(CHUNK, KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "letter"))), lambda s: s["letter"]), "").alias("_part"),
        F.min(turns).alias("_low"), F.max(turns).alias("_high"), F.count_distinct(turns).alias("_turns"),
    )
    # a turn whose rows lie on both sides of a border is counted in both chunks
    earlier = F.max("_high").over(Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("_shared", F.coalesce((earlier == F.col("_low")).cast("int"), F.lit(0)))
    whole = chunks.groupBy(KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(CHUNK, "_part"))), lambda s: s["_part"]), "").alias("signature"),
        F.coalesce(F.max("_high") - F.min("_low") + 1 - F.sum(F.col("_turns") - F.col("_shared")), F.lit(0)).cast("bigint").alias("gaps"),
    )
    return staged(whole.select(F.col(f"{KEY}.conv_id").alias("conv_id"), "gaps", "signature"), "signatures")


# ---- the automaton ------------------------------------------------------------------------------------


class Node(NamedTuple):
    """What a suffix of letters costs, by grammar state at its start, and the first edit of the cheapest way."""

    cost: tuple
    edit: tuple
    counts: tuple  # blank, duplicate, truncated, illegal in the suffix
    initial: str


def _with_inserts(cost: list, edit: list) -> tuple[tuple, tuple]:
    for _ in SPEAKS:  # a chain of inserts passes each state at most once
        for state, then in enumerate(THEN):
            new = COST[INSERT] + cost[then]
            if (new, INSERT) < (cost[state], edit[state]):
                cost[state], edit[state] = new, INSERT
    return tuple(cost), tuple(edit)


END = Node(*_with_inserts([0 if s in ENDS else NEVER for s in range(4)], [""] * 4), (0, 0, 0, 0), "")


def _kept(initial: str, state: int) -> int | None:
    """State after a kept row, None where the grammar refuses it."""
    if initial == "s":
        return AFTER_S if state == NOTHING else None
    return THEN[state] if initial and initial == SPEAKS[state][0] else None


def node(letter: str, rest: Node) -> Node:
    """The node of a letter before the suffix of ``rest``."""
    kind, fault = divmod(ord(letter) - ord("A"), 4)
    initial = (*INITIALS, "-")[kind]
    cost, edit = [], []
    for state in range(4):
        ways = [(COST[DELETE] + rest.cost[state], DELETE)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            extra = TRUNCATED_COST if FAULTS[fault] == "truncated" else 0
            ways.append((COST[REROLE] + extra + rest.cost[THEN[state]], REROLE))
            kept = _kept(initial, state)
            if kept is not None:
                ways.append((COST[KEEP] + extra + rest.cost[kept], KEEP))
        best = min(ways)
        cost.append(best[0])
        edit.append(best[1] if best[0] < NEVER else "")
    illegal = bool(rest.initial) and (initial, rest.initial) not in LEGAL
    counts = (fault == 1, fault == 2, fault == 3, illegal)
    return Node(*_with_inserts(cost, edit), tuple(a + b for a, b in zip(rest.counts, counts)), initial)


def extend(nodes: list[Node], last: str, signature: str) -> None:
    """From the path of ``last`` to that of ``signature``: the nodes of the suffix that both share stay."""
    reverse = signature[::-1]
    shared = len(os.path.commonprefix([last[::-1], reverse]))
    del nodes[shared + 1 :]
    for letter in reverse[shared:]:
        nodes.append(node(letter, nodes[-1]))


def audit(nodes: list[Node], signature: str) -> str:
    """The edits along the path from the whole signature to its end; ``nodes[i]`` is the suffix of i letters."""
    state, left, out = NOTHING, len(signature), []
    while edit := nodes[left].edit[state]:
        out.append(edit)
        if edit == INSERT:
            state = THEN[state]
            continue
        letter = signature[len(signature) - left]
        left -= 1
        if edit == REROLE:
            state = THEN[state]
        elif edit == KEEP:
            state = _kept((*INITIALS, "-")[(ord(letter) - ord("A")) // 4], state)
    return "".join(out)


def plans(signed: DataFrame) -> DataFrame:
    """``signed`` (a table with ``signature``) with blank, duplicate, truncated, illegal, cost and audit.

    Conversations are range-split by reversed signature and id, so a signature that many share is split as well.
    """
    kept = signed.columns
    made = {c: "bigint" for c in ("blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "string"}
    back = F.reverse("signature")
    split = signed.repartitionByRange(back, "conv_id").sortWithinPartitions(back, "conv_id")
    schema = T.StructType([*signed.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in made.items())).fields])

    def run(batches):
        nodes, last, found = [END], "", None
        for batch in batches:
            rows = []
            for signature in batch.column(kept.index("signature")).to_pylist():
                if signature != last or found is None:
                    extend(nodes, last, signature)
                    top, last = nodes[-1], signature
                    found = (*top.counts, top.cost[NOTHING], audit(nodes, signature))
                rows.append(found)
            made_columns = [pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(zip(*rows), made)]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *made_columns], names=[*kept, *made])

    return split.mapInArrow(run, schema)


# ---- repaired conversations -----------------------------------------------------------------------------


def _edited(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one partition: what is folded row by row below."""
    plan_columns = [f.name for f in planned.schema.fields if f.name not in ("conv_id", "signature")]
    plan = planned.select("conv_id", F.lit(0).alias("_kind"), F.struct(*plan_columns).alias("_plan"))
    light = rows.select(
        "conv_id", F.when(F.col("dropped"), 1).otherwise(2).alias("_kind"), F.col("turn").isNotNull().alias("_has_turn"), "turn", "role",
        F.sha2("text", 256).alias("_text_id"), F.when(~F.col("dropped"), F.col("text")).alias("text"),
    )
    both = plan.unionByName(light, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "_has_turn", "turn", "role", "_text_id")


def _walk(batches):
    """(conv_id, plan, lines): ``lines`` gives (edit, role, text) of the repaired conversation, one batch at a time.

    What a task holds is one plan and one batch. The last conversation of a batch may go on in the next one.
    """
    held = {}

    def lines(edits, role=None, text=None):
        """The inserts before the next edit, and that edit on the row."""
        for edit in edits:
            if edit == INSERT:
                yield edit, SPEAKS[held["state"]], ""
                held["state"] = THEN[held["state"]]
                continue
            if edit == REROLE:
                yield edit, SPEAKS[held["state"]], text
                held["state"] = THEN[held["state"]]
            elif edit == KEEP:
                yield edit, role, text
                held["state"] = _kept(role[:1], held["state"])
            return

    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        conv_ids, kinds = batch.column(at["conv_id"]).to_pylist(), batch.column(at["_kind"]).to_pylist()
        plan, roles, texts = (batch.column(at[c]) for c in ("_plan", "role", "text"))
        for i, (conv_id, kind) in enumerate(zip(conv_ids, kinds)):
            if "conv_id" not in held or held["conv_id"] != conv_id:
                if held:
                    yield held["conv_id"], held["plan"], lines(held["edits"]), True
                held = {"conv_id": conv_id, "plan": None, "state": NOTHING, "edits": iter("")}
            if kind == 0:
                held["plan"] = plan[i].as_py()
                held["edits"] = iter(held["plan"]["audit"])
            elif kind == 2:
                yield conv_id, held["plan"], lines(held["edits"], roles[i].as_py(), texts[i].as_py()), False
    if held:
        yield held["conv_id"], held["plan"], lines(held["edits"]), True


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations' rows, places from 1, deleted rows not among them.

    ``rows``: those of ``damaged`` or of the same columns; ``planned``: their ``plans``.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        place, out = 0, []
        for conv_id, _, lines, last in _walk(batches):
            for edit, role, text in lines:
                place += 1
                out.append((conv_id, place, edit, role, text))
            place = 0 if last else place
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    schema = f"conv_id {id_type}, place bigint, edit string, role string, text string"
    return _edited(rows, planned).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(t)) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def repair_report(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of the damaged ``rows``: gaps, fault counts, cost, audit, and the repaired text's hash.

    Null texts and roles are one space, so such a text is blank and such a role is none of the grammar's. Rows without
    turn come first. Rows of one turn go by role, then by their text's hash; rows equal in all are repeats of the first.
    Rows without conv_id are one conversation. A conversation with no row left has zeros, an empty audit and the empty
    text's hash. An empty table gives no rows; other columns are not looked at. Texts are shuffled once, and hashed as
    they stream past; a conversation's signature and audit, a byte for each row, are values in memory.
    """
    planned = staged(plans(signatures(rows.where(~F.col("dropped")))), "plans")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {id_type}, " + ", ".join(f"{n} bigint" for n in numbers) + ", audit string, repaired_sha256 string"

    def run(batches):
        digest, first, out = hashlib.sha256(), True, []
        for conv_id, plan, lines, last in _walk(batches):
            for _, role, text in lines:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if last:
                plan = plan or dict.fromkeys(numbers, 0) | {"audit": ""}
                out.append((conv_id, *[plan[n] for n in numbers], plan["audit"], digest.hexdigest()))
                digest, first = hashlib.sha256(), True
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return _edited(rows, planned).mapInArrow(run, schema)
