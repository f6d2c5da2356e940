"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

The log holds events (conv_id, turn, message, seq, role, op, text); message tells apart what shares a turn. Per message, in seq order: `delta` appends its
text; `edit` replaces all text so far; `regenerate` drops all text so far. So a message is what follows its
last edit or regeneration. Messages in turn order make the conversation, which is rendered with marks around
each turn; control strings inside texts are escaped with a backslash and can be read back.

Collecting lists combines in the map tasks, so what reaches a task is a conversation's own size: the one
string it becomes anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "<|turn|>"
END = "<|end|>"
LEARNED_ROLE = "assistant"
# Control strings of this template and of others, after their first letter.
_CONTROL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    r"""Put one more backslash behind the first letter of every control string (or escaped one)."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", r"$1$2$3")


def _on_one_line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _lines_again(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def message_log(conversations: DataFrame) -> DataFrame:
    """Finished messages (conv_id, turn, role, text) as a log of one delta each; rows of the same turn stay apart as its messages 1, 2, ..."""
    apart = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return conversations.select("conv_id", "turn", apart.alias("message"), F.lit(0).cast("long").alias("seq"), "role", F.lit("delta").alias("op"), "text")


#: Characters that a delta of a streamed message has.
DELTA = 400


def streamed_log(conversations: DataFrame, piece: int = DELTA) -> DataFrame:
    """The log of a chat service whose final messages are these: texts come in deltas of `piece` characters.

    By a hash of the message, every third one was started otherwise and regenerated, and every third one has its
    first delta edited; an empty text is one empty delta.
    """
    messages = message_log(conversations).withColumn("text", F.coalesce("text", F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("text")), F.lit(piece))
    event = lambda seq, op, text: F.struct(seq.cast("long").alias("seq"), op.alias("op"), text.alias("text"))
    deltas = lambda later: F.transform(starts, lambda at, i: event(i + later, F.lit("delta"), F.substr("text", at, F.lit(piece))))
    kind = F.pmod(F.xxhash64("conv_id", "turn", "message"), F.lit(3))
    first = F.substring("text", 1, piece)
    drafted = F.array(event(F.lit(0), F.lit("delta"), F.reverse(first)), event(F.lit(1), F.lit("regenerate"), F.lit("")))
    edited = F.array(event(F.lit(0), F.lit("delta"), F.upper(first)), event(F.lit(1), F.lit("edit"), first))
    events = F.when(kind == 0, deltas(0)).when(kind == 1, F.concat(drafted, deltas(2))).otherwise(F.concat(edited, F.slice(deltas(1), F.lit(2), F.size(starts))))
    return messages.select("conv_id", "turn", "message", "role", F.explode(events).alias("event")).select("conv_id", "turn", "message", "event.seq", "role", "event.op", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages conv_id, turn, message, role, text.

    Null text counts as empty, null op as delta, null seq as first; the role is the smallest one that the
    message's events name. Events with equal seq are taken by op and text; repeated events count each time.
    A conversation that is null is one of its own; so is a null turn, before the others.
    """
    reset = F.col("op").isin("edit", "regenerate")
    event = F.struct(F.coalesce("seq", F.lit(-(2**63)).cast("long")).alias("seq"), F.when(reset, 0).otherwise(1).alias("later"), F.coalesce(F.col("text"), F.lit("")).alias("text"), (F.coalesce("op", F.lit("delta")) == "regenerate").alias("drop"))
    grouped = events.groupBy("conv_id", "turn", "message").agg(
        F.min("role").alias("role"),
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(reset, F.coalesce("seq", F.lit(-(2**63)).cast("long")))).alias("reset"),
    )
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset")) | ((e["seq"] == F.col("reset")) & ~e["drop"]))
    return grouped.select("conv_id", "turn", "message", "role", F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, and loss_mask, an array that tells of each turn whether it is learned.

    Turns are ordered by turn, then role and text, so ties and repeated rows have a defined order. A null role is
    written as an empty one; a line end in a role is written as %0A, a percent sign as %25.
    """
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    block = lambda t: F.concat(F.lit(TURN), _on_one_line(escape(t["role"])), F.lit("\n"), escape(t["text"]), F.lit(END))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", block), "").alias("formatted"),
        F.transform("turns", lambda t: t["role"] == LEARNED_ROLE).alias("loss_mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Add turns (role, text, learned), parsed from formatted and loss_mask."""
    blocks = F.filter(F.split("formatted", r"<\|turn\|>"), lambda b: b != "")
    body = lambda b: F.substring_index(b, END, 1)
    parsed = F.transform(
        blocks,
        lambda b, i: F.struct(
            unescape(_lines_again(F.substring_index(body(b), "\n", 1))).alias("role"),
            unescape(F.substr(body(b), F.locate("\n", body(b)) + 1)).alias("text"),
            F.get("loss_mask", i).alias("learned"),
        ),
    )
    return rendered.withColumn("turns", parsed)


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from what read_back gives."""
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rendered).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
