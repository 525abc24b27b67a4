"""Chat formatting from an event log, on SQL functions only.

A conversation is a log of events: a message is written by streamed deltas, rewritten by edits, and thrown away and
begun anew by regenerations. The log is folded by message first, so a long message meets as one value per task
before the conversation is put together, then rendered with a loss mask, and can be read back.
"""

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"


def escaped(text: Column) -> Column:
    """No control string can stand in the result: each "<|" becomes "%3C|"; "%" becomes "%25"."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def _role(role: Column) -> Column:
    """A role ends at the first line break, so its own ones are escaped too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("%0A"))


def _read_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("%0A"), F.lit("\n")))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of an event log.

    ``events``: conv_id, seq, message, kind, role, text. Deltas are joined in order of seq. An edit replaces what the
    message holds so far. A regeneration drops that and all later messages' events that came before it, then goes on
    with its own text. Ties of seq go by message, kind, role, text. Null texts and roles are empty, a null kind is a
    delta; a null conv_id is a conversation of its own. Repeated rows are repeated events. The role is that of the
    message's last event. Other columns are not looked at. No events: no messages.
    """
    e = events.select(
        "conv_id", "seq", "message", F.coalesce("kind", F.lit(DELTA)).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # the last regeneration of each message; small: one row for each message that has one
    again = e.where(F.col("kind") == REGENERATE).groupBy("conv_id", "message").agg(F.max("seq").alias("_seq"))
    cut = again.groupBy(F.col("conv_id").alias("_conv")).agg(F.collect_list(F.struct("message", "_seq")).alias("_cuts"))
    e = e.join(cut, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    dropped = F.exists("_cuts", lambda c: (c["message"] <= F.col("message")) & (c["_seq"] > F.col("seq")))
    e = e.where(F.coalesce(~dropped, F.lit(True)))
    order = F.struct("seq", "message", "kind", "role", "text")
    last = F.max(F.when(F.col("kind") != DELTA, F.col("seq")))  # what an edit or a regeneration replaces
    steps = e.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(order)).alias("_steps"), last.alias("_from"))
    kept = F.filter("_steps", lambda s: F.coalesce(s["seq"] >= F.col("_from"), F.lit(True)))
    # several replacements with one seq: the last in order counts
    text = F.array_join(F.transform(kept, lambda s: s["text"]), "")
    several = F.size(F.filter(kept, lambda s: s["kind"] != DELTA)) > 1
    walked = F.aggregate(kept, F.lit(""), lambda a, s: F.when(s["kind"] == DELTA, F.concat(a, s["text"])).otherwise(s["text"]))
    return steps.select(
        "conv_id", "message", F.element_at("_steps", -1)["role"].alias("role"), F.when(several, walked).otherwise(text).alias("text")
    )


def rendered(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation, messages in order.

    ``loss`` is the mask: for each text of ``loss_role``, the turn (from 0), where the text begins in the turn's
    block, and how many code points of the block it covers. A conversation has to fit in one string.
    """
    body = F.struct("message", "role", "text")
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(body)).alias("_turns"))
    head = lambda m: F.concat(_role(m["role"]), F.lit("\n"))
    blocks = F.transform("_turns", lambda m: F.concat(F.lit(OPEN), head(m), escaped(m["text"]), F.lit(CLOSE), F.lit("\n")))
    mask = F.transform("_turns", lambda m, i: F.struct(
        i.alias("turn"), (len(OPEN) + F.length(head(m))).alias("at"), F.length(escaped(m["text"])).alias("n"), (m["role"] == loss_role).alias("_in"),
    ))
    loss = F.transform(F.filter(mask, lambda m: m["_in"]), lambda m: F.struct(m["turn"].alias("turn"), m["at"].alias("at"), m["n"].alias("n")))
    return whole.select("conv_id", F.array_join(blocks, "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text), loss_text, chars), from ``formatted`` and ``loss`` alone; chars: its length."""
    # no block holds OPEN or CLOSE but at its ends, so cutting there is exact
    blocks = F.split(F.replace("formatted", F.lit(f"{CLOSE}\n"), F.lit("")), r"<\|im_start\|>", -1)
    split = formatted.select("conv_id", "loss", F.length("formatted").alias("chars"), F.slice(blocks, F.lit(2), F.size(blocks)).alias("_blocks"))
    at = lambda b: F.locate("\n", b)
    turns = F.transform("_blocks", lambda b: F.struct(
        _read_role(F.substring(b, F.lit(1), at(b) - 1)).alias("role"), unescaped(F.substring(b, at(b) + 1, F.length(b))).alias("text"),
    ))
    masked = F.transform("loss", lambda m: unescaped(F.substring(F.get("_blocks", m["turn"]), m["at"] - len(OPEN) + 1, m["n"])))
    return split.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "chars")
