"""Conversation repair against all edit scripts of small conversations, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

from lexloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, absent string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def by_all_scripts(rows):
    """The row of the contract for one conversation, from every script of at most two inserts in a place."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults]):
        for holes in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, written = 0, "", []
            for hole, edit, fault, row in itertools.zip_longest(holes, edits, faults, rows):
                for role in hole:
                    cost, audit = cost + 2, audit + "I"
                    written.append(({"u": "user", "a": "assistant"}[role], ""))
                if edit is None:
                    continue
                audit += edit[0]
                cost += {"K": 0, "R": 2, "D": 3}[edit[0]] + (fault == "truncated" and edit != "D")
                if edit != "D":
                    written.append(({"K": row[2], "Ru": "user", "Ra": "assistant"}[edit], row[3]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in written)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in written))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": best[0],
        "audit": best[1],
        "repaired_sha256": hashlib.sha256(best[2].encode()).hexdigest(),
    }


def test_repair_equals_all_scripts(spark):
    draw, rows = random.Random(5), []
    texts = ["Yes.", "No?", "open end", "done!  \n", "", " \t", None, "Yes.", "a.b", "ünï.", " "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    for conv in range(150):
        rows += [(conv, draw.choice([turn, turn, turn + 3, None]), draw.choice(roles), draw.choice(texts)) for turn in range(draw.randint(1, 3))]
    rows += [(None, 1, "user", "no id."), (None, None, None, None)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).drop("absent")
    out = repair.digests(repair.repair(repair.damage(table))).collect()
    assert sorted({r[0] for r in rows}, key=str) == sorted((r["conv_id"] for r in out), key=str)
    for r in out:
        given = damaged([x for x in rows if x[0] == r["conv_id"]])
        assert {k: v for k, v in r.asDict().items() if k != "conv_id"} == by_all_scripts(given), given


def test_a_truncated_turn_comes_before_its_repetition(spark):
    rows = [(1, 0, "user", "one"), (1, 0, "user", "one"), (1, 1, "assistant", "two.")]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (out["audit"], out["cost"], out["duplicate"], out["truncated"]) == ("KDK", 4, 1, 1)
    assert [tuple(t) for t in out["turns"]] == [("user", "one"), ("assistant", "two.")]


def test_conversations_without_rows_and_long_ones(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.digests(repair.repair(none.drop("absent"))).collect() == []
    gone = spark.createDataFrame([(4, 0, "user", "x", True)], "conv_id long, turn long, role string, text string, absent boolean")
    empty = hashlib.sha256(b"").hexdigest()
    assert repair.digests(repair.repair(gone)).first().asDict() == {"conv_id": 4, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    long = [(9, i, ["user", "assistant"][i % 2], f"turn {i}. " + "word " * (50_000 if i == 7 else 1) + "end.") for i in range(3000)]
    out = repair.repair(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).first()
    assert out["audit"] == "K" * 3000 and out["cost"] == 0 and [tuple(t) for t in out["turns"]] == [r[2:] for r in long]


def test_roles_of_chats_are_read_back(spark):
    from lexloom.llm import chat

    roles = ["user", "a\nb", "100%", "%0A", "%250A", "x\n</s>%", "", None]
    rows = [(1, i, r, f"text {i}") for i, r in enumerate(roles)]
    out = chat.read_back(chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r or "", t) for _, _, r, t in rows]
