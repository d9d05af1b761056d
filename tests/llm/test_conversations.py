"""Operator 11 against brute force: every sequence of edits of short conversations."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm import conversations
from skirmish.llm.conversations import SPACE

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
LEGAL = {"", *("s" * s + "ua" * n for s in (0, 1) for n in range(1, 9))}


def brute(rows):
    """The result of one conversation's (turn, role, text), by trying every edit of every row, with up to two insertions anywhere."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        visible = text.strip(SPACE)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for edits in product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits, strict=True)):
            continue
        base = sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (f == "truncated" and e != "D") for f, e in zip(faults, edits, strict=True))
        for inserted in product((0, 1, 2), repeat=len(rows) + 1):
            if sum(inserted) > 2:
                continue
            audit = "I" * inserted[0] + "".join(e + "I" * n for e, n in zip(edits, inserted[1:], strict=True))
            if best and (base + 5 * sum(inserted), audit) >= best[:2]:
                continue
            row, made = iter(rows), []
            for e in audit:
                _, role, text = next(row) if e != "I" else (None, None, "")
                if e != "D":
                    made.append((e, role, text))
            given = [role[:1] if e == "K" else None for e, role, _ in made]
            for target in LEGAL:
                if len(target) == len(given) and all(g == t if g is not None else t in "ua" for g, t in zip(given, target, strict=True)):
                    out = "\n".join(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[t]}:{text}" for (e, role, text), t in zip(made, target, strict=True))
                    best = (base + 5 * sum(inserted), audit, out)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        *best[:2],
        hashlib.sha256(best[2].encode()).hexdigest(),
    )


def random_conversations(n, longest=5, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(6)])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "Who?", "no end", " \t", None, "Ünïcode! \n"])))
    return rows


def run(spark, rows):
    found = conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r[0]: tuple(r)[1:] for r in found}


def test_equal_to_all_sequences_of_edits(spark):
    rows = random_conversations(400)
    found = run(spark, rows)
    assert len(found) == 400
    for conv, result in found.items():
        assert result == brute([r[1:] for r in rows if r[0] == conv]), conv


def test_conversations_over_several_batches(spark):
    rows = random_conversations(60, longest=40, seed=2)
    whole = run(spark, rows)
    # Workers don't see patched settings, so the walk runs here.
    walked = {}
    for conv in range(60):
        walker, c = conversations.Walker(), conversations.Conversation(conv)
        seen = set()
        for turn, role, text in sorted(((t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            visible = text.strip(SPACE)
            fault = "b" if not visible else "r" if (role, text) in seen else "t" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            c.add(turn, role.encode(), text.encode(), role[:1] if role[:1] in ("s", "u", "a") else "?", fault)
            if len(c.rows) >= 3:
                walker.walk([c], 0)
        last = walker.walk([c], 1)[0]
        walked[conv] = (c.gaps(), *c.faults.values(), c.illegal, last.cost, last.audit, last.digest.hexdigest())
    assert walked == whole


def test_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(5000)] + [(1, 2500, "tool", "in between")] + [(k, 0, "user", "Alone.") for k in range(2, 40)]
    found = run(spark, rows)
    assert found[1][5] == 2 and found[1][6].count("K") == 5000 and found[1][6].count("D") == 1
    kept = "\n".join(f"{r}:{t}" for _, _, r, t in sorted(rows[:5000], key=lambda x: x[1]))
    assert found[1][7] == hashlib.sha256(kept.encode()).hexdigest()
    assert found[2] == (0, 0, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 1, "user", ""), (2, None, "user", "A."), (2, None, "assistant", "B."), (3, 1, "user", "x" * 300_000 + "."), (3, 1, "user", "x" * 300_000 + "."), (3, 9, "assistant", "Fine.")]
    found = run(spark, rows)
    for conv in (None, 1, 2, 3):
        assert found[conv] == brute([r[1:] for r in rows if r[0] == conv]), conv
    assert run(spark, []) == {}
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS again", "'x' AS present", "'x' AS fault", "'x' AS initial", "'x' AS audit")
    assert {r[0]: tuple(r)[1:] for r in conversations.repair(clash).collect()} == found


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, cast(X'ff2e' AS string) AS text UNION ALL SELECT 1L, 1L, 'assistant', 'Ok.'")
    (row,) = conversations.repair(df).collect()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256(b"user:\xff.\nassistant:Ok.").hexdigest()


def test_repaired_turns_have_the_digest(spark):
    df = spark.createDataFrame(random_conversations(80, longest=9, seed=3), SCHEMA)
    repaired = conversations.repair(df)
    turns = conversations.repaired_turns(df, repaired).collect()
    for row in repaired.collect():
        own = sorted((t["position"], f"{t['role']}:{t['text']}") for t in turns if t["conv_id"] == row["conv_id"])
        assert [p for p, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(x for _, x in own).encode()).hexdigest() == row["repaired_sha256"]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    found = conversations.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = []
    for c, t, role, text in rows:
        key, role, text = f"{' ' if c is None else c}:{' ' if t is None else t}", role or " ", text or " "
        fault = zlib.crc32(key.encode()) % 20
        row = (c, t, "user" if fault == 4 else role, {1: "", 2: "One Two" if len(text) > 1 else text}.get(fault, text), fault != 0)
        expected += [row] * (1 + (fault == 3))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("kind", ["sd", "ut", "?", "a"])
def test_every_state_can_go_on(kind):
    assert {s for k, s, *_ in conversations.moves() if k == kind} == {0, 1, 2, 3}
    assert {x[0] for x in conversations.endings()} == {0, 1, 2, 3}


def test_dropped_conversations_are_named(spark):
    df = spark.createDataFrame([(5, 0, "user", "Hello.")], SCHEMA)
    (row,) = conversations.repair(df, F.lit(False)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
