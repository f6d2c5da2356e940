r"""Conversation structure repair: the cheapest edits that turn a damaged conversation into a well-formed one.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Window functions flag each turn's
first fault (blank, duplicate, truncated), the turns of a conversation are collected in order, and one
`aggregate()` folds them: it carries four structs (cost, script), the cheapest way to have written nothing yet, or to
have written a system, user or assistant turn last. All is DataFrame functions; a conversation is one row, as its
repair is one text, and all steps share one shuffle by conv_id.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit for blank and duplicate turns), Insert an empty
user or assistant turn 2; a truncated turn that is not deleted adds 1. Of equally cheap scripts the one whose initials are
ASCII-least is taken. Two scripts that end in the same state after the same turns differ in a letter before either
ends (equal letters cost the same, and each further Insert costs more), so the smaller one stays smaller
whatever follows and the fold is exact.

A script holds two characters for each edit: its initial and the initial of the role it leaves (`-` for Delete). Equal
edits so far leave equal roles, so scripts are ordered as their initials are.

Nulls: a null role or text counts as one space (a blank text), a null turn comes before the others, null
conv_ids make one conversation. Turns of one number are taken by role and text, repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The cost of what cannot be.
NEVER = 1 << 40
_LEGAL = ("su", "ua", "au")


def damage(conversations: DataFrame) -> DataFrame:
    r"""conv_id, turn, role, text, absent: the table as a lossy log would give it, by crc32 of `conv_id:turn` modulo 20.

    0 drops the row (absent is true, so that its conversation stays known), 1 empties its text, 2 removes `[.!?]` from it,
    3 repeats the row, 4 sets its role to user.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    row = F.struct("conv_id", "turn", F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), (kind == 0).alias("absent"))
    return conversations.select(F.explode(F.array_repeat(row, F.when(kind == 3, 2).otherwise(1))).alias("row")).select("row.*")


def faults(rows: DataFrame) -> DataFrame:
    """Turns with fault (seen: which of equal turns it is; name: blank, duplicate, truncated or null), illegal (after the turn before it) and fresh_turn, dealt by conv_id.

    rows has conv_id, turn, role, text, absent; absent rows are kept for their conversation's sake and have no faults.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit(" "))
    order = ("turn", "role", "text")
    here = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), F.coalesce("absent", F.lit(False)).alias("absent")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "text").orderBy("turn"))
    within = Window.partitionBy("conv_id", "absent").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    flagged = here.select("*", seen.alias("seen")).select("*", F.lag("role").over(within).alias("role_before"), F.lag("turn").over(within).alias("turn_before"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    pair = F.concat(F.substring("role_before", 1, 1), F.substring("role", 1, 1))
    return flagged.select(
        "conv_id", *order, "absent",
        F.when(~F.col("absent"), F.struct("seen", fault.alias("name"))).alias("fault"),
        (~F.col("absent") & F.col("role_before").isNotNull() & ~pair.isin(*_LEGAL)).alias("illegal"),
        (~F.col("absent") & F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))).alias("fresh_turn"),
    )


def _way(cost: Column | int, script: Column | str) -> Column:
    cost, script = (x if isinstance(x, Column) else F.lit(x) for x in (cost, script))
    return F.struct(cost.cast("long").alias("cost"), script.alias("script"))


def _then(way: Column, cost: Column | int, code: Column | str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["script"], code if isinstance(code, Column) else F.lit(code)))


def _ways(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _given(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _with_inserts(ways: Column) -> Column:
    """Any inserts at this place: a user turn where one may follow, then an assistant turn."""
    user = F.least(ways["user"], *(_then(ways[w], INSERT, "Iu") for w in ("none", "system", "assistant")))
    return _given(user, lambda u: _ways(ways["none"], ways["system"], u, F.least(ways["assistant"], _then(u, INSERT, "Ia"))))


def _with_turn(ways: Column, turn: Column) -> Column:
    """One turn kept, given another role, or deleted."""
    gone = lambda w: _then(ways[w], DELETE, "D-")
    extra = F.when(turn["fault"]["name"].isin("blank", "duplicate"), NEVER).when(turn["fault"]["name"] == "truncated", TRUNCATED).otherwise(0)
    first = F.substring(turn["role"], 1, 1)

    def into(role: str) -> tuple[Column, Column]:
        kept = first == role
        return F.when(kept, KEEP).otherwise(REROLE) + extra, F.when(kept, f"K{role}").otherwise(f"R{role}")

    system = F.when(first == "s", KEEP + extra).otherwise(NEVER)
    return _ways(
        gone("none"),
        F.least(gone("system"), _then(ways["none"], system, "Ks")),
        F.least(gone("user"), *(_then(ways[w], *into("u")) for w in ("none", "system", "assistant"))),
        F.least(gone("assistant"), _then(ways["user"], *into("a"))),
    )


def _script(turns: Column) -> Column:
    start = _ways(_way(0, ""), _way(NEVER, ""), _way(NEVER, ""), _way(NEVER, ""))
    step = lambda ways, turn: _given(_with_inserts(ways), lambda w: _with_turn(w, turn))
    return F.aggregate(turns, start, step, lambda ways: _given(_with_inserts(ways), lambda w: F.least(w["none"], w["assistant"])))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    rows has conv_id, turn, role, text and may have absent. The counts are of the rows as given; gaps is the number of
    turns missing between the first and the last. turns is the repaired conversation, an array of (role, text). A conversation of
    absent rows only has zeros and an empty audit. Further columns are left out.
    """
    flagged = faults(rows if "absent" in rows.columns else rows.withColumn("absent", F.lit(False)))
    count = lambda condition, name: F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias(name)
    turn = F.struct("turn", "role", "text", "fault")
    number = F.when(~F.col("absent"), F.col("turn"))
    folded = flagged.groupBy("conv_id").agg(
        F.coalesce(F.max(number) - F.min(number) + 1 - F.sum(F.col("fresh_turn").cast("long")), F.lit(0)).alias("gaps"),
        *(count(F.col("fault.name") == name, name) for name in ("blank", "duplicate", "truncated")),
        count(F.col("illegal"), "illegal"),
        F.array_sort(F.collect_list(F.when(~F.col("absent"), turn))).alias("given"),
    )
    best = folded.select("*", _script(F.col("given")).alias("best"))
    #: One item per turn, with the inserts before it, and one of inserts at the end.
    items = F.regexp_extract_all(F.col("best.script"), F.lit("(?:I[ua])*(?:D-|[KR][sua])|(?:I[ua])+"), F.lit(0))
    message = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    whole = lambda initial: F.when(initial == "u", "user").otherwise("assistant")

    def written(item: Column) -> Column:
        step = item["step"]
        inserts = F.transform(F.regexp_extract_all(step, F.lit("I([ua])"), F.lit(1)), lambda initial: message(whole(initial), F.lit("")))
        edit, initial = F.substring(step, -2, 1), F.substring(step, -1, 1)
        own = F.array(message(F.when(edit == "K", item["turn"]["role"]).otherwise(whole(initial)), item["turn"]["text"]))
        return F.when(edit.isin("K", "R"), F.concat(inserts, own)).otherwise(inserts)

    paired = F.arrays_zip(items.alias("step"), F.col("given").alias("turn"))
    return best.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
        F.col("best.cost").alias("cost"),
        F.regexp_replace("best.script", "(.).", "$1").alias("audit"),
        F.flatten(F.transform(paired, written)).alias("turns"),
    )


def digests(repaired: DataFrame) -> DataFrame:
    """The columns of repair with repaired_sha256 (of `role:text`, one turn per line) in place of turns."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select(*(c for c in repaired.columns if c != "turns"), F.sha2(lines, 256).alias("repaired_sha256"))
