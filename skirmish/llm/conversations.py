"""Conversation structure repair (operator 11): the cheapest edits that make a conversation's roles follow a grammar.

The grammar is a small automaton over role initials; the default reads ``(s?(ua)+)?``. A turn is kept, given another role, or deleted, and turns with an empty text may be inserted. Each edit has a
cost, blank and repeated turns must be deleted, and keeping a truncated turn costs more. Of the cheapest edits those whose initials come first in ASCII order are taken.

Spark deals rows by the hash of their conversation and sorts them there; a task reads them as a stream, in batches of bounded size, whose turns a recursive DuckDB query walks through:
each recursion advances one turn for all conversations of the batch and keeps, for each conversation and grammar state, the minimum cost and its audit (``USING KEY``, so
only the present turn's rows are held). A conversation that goes on in the next batch starts there from its states, so its length has no limit; the SHA-256 of its repaired
turns goes along for each state. That digest needs a conversation's turns in order, so a conversation is one task's stream at least; it is never held as a whole but for its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import BATCH_BYTES, texts_of

#: The roles that edits may give, by initial; the automaton (state, initial) -> state, where 0 is its first state, and the states it may end in. Each state takes one of these roles.
ROLES = {"u": "user", "a": "assistant"}
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
NEXT = {state: initial for state, initial in GRAMMAR if initial in ROLES}
LEGAL_PAIRS = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The turns of a batch, and those of one conversation among them.
BATCH_TURNS, LONG_TURNS = 16_384, 1024
#: ASCII white space; a turn of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"


def insertions() -> list[tuple[int, int, int, str]]:
    """(state, next, cost, edits): what insertions alone reach; no cheapest ones pass a state twice."""
    out = []
    for state in NEXT:
        at, edits = state, ""
        while (state, at) not in {x[:2] for x in out}:
            out.append((state, at, INSERT * len(edits), edits))
            at, edits = GRAMMAR[at, NEXT[at]], edits + "I"
    return out


def endings() -> list[tuple[int, int, str]]:
    """(state, cost, edits): the cheapest insertions that let a conversation end."""
    return [(state, *min((cost, edits) for s, at, cost, edits in insertions() if s == state and at in ENDS)) for state in NEXT]


def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, state, next, cost, edits) of one turn, with insertions before it. A turn's kind is its role's initial, ``?`` for one that the grammar doesn't have, and ``d`` if it must be deleted or ``t`` if it is truncated."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for initial in "sua?":
        for fault in ("", "d", "t"):
            for state, at, cost, edits in insertions():
                steps = [(at, DELETE, "D")]
                if fault != "d":
                    more = TRUNCATED * (fault == "t")
                    steps += [(GRAMMAR[at, NEXT[at]], REROLE + more, "R")]
                    steps += [(after, KEEP + more, "K") for key, after in GRAMMAR.items() if key == (at, initial)]
                for after, step, edit in steps:
                    key, value = (initial + fault, state, after), (cost + step, edits + edit)
                    best[key] = min(best.get(key, value), value)
    return [(*key, *value) for key, value in best.items()]


#: ``prior`` orders the audits before the batch; no two of a conversation are equal or one the other's beginning, as all end with the same turn.
WALK = """
CREATE OR REPLACE TEMP TABLE walked AS
WITH RECURSIVE walk(conv, state, turn, cost, prior, audit) USING KEY (conv, state) AS (
  SELECT conv, state, 0::BIGINT, cost, prior, '' FROM begun
  UNION
  SELECT conv, next, turn, best.cost, best.prior, best.audit
  FROM (
    SELECT w.conv, m.next, w.turn + 1 AS turn, min({'cost': w.cost + m.cost, 'prior': w.prior, 'audit': w.audit || m.edits}) AS best
    FROM walk w JOIN turns t ON t.conv = w.conv AND t.turn = w.turn JOIN moves m ON m.kind = t.kind AND m.state = w.state
    GROUP BY w.conv, m.next, w.turn
  )
)
SELECT conv, state, cost, prior, audit FROM walk
"""
BEST = "SELECT conv, best.cost, best.prior, best.audit FROM (SELECT conv, min({'cost': w.cost + e.cost, 'prior': w.prior, 'audit': w.audit || e.edits}) AS best FROM walked w JOIN endings e USING (state) WHERE conv < ? GROUP BY conv) ORDER BY conv"


@dataclass
class Walked:
    """A grammar state of a conversation: cost, audit, and the digest of the repaired turns so far."""

    state: int = 0
    cost: int = 0
    audit: str = ""
    digest: hashlib._Hash = field(default_factory=hashlib.sha256)
    begun: bool = False

    def after(self, cost: int, edits: str, rows: list[tuple[bytes, bytes]]) -> Walked:
        """What ``edits`` of the ``rows`` that follow make of it."""
        out = Walked(self.state, cost, self.audit + edits, self.digest.copy(), self.begun)
        row = iter(rows)
        for edit in edits:
            role, text = next(row) if edit != "I" else (b"", b"")
            if edit != "D":
                initial = role[:1].decode() if edit == "K" else NEXT[out.state]
                role = role if edit == "K" else ROLES[initial].encode()
                out.digest.update(b"\n" * out.begun + role + b":" + text)
                out.state, out.begun = GRAMMAR[out.state, initial], True
        return out


@dataclass
class Conversation:
    """A conversation in the stream: its counts so far, its states before the turns that wait, and these."""

    conv_id: object
    states: list[Walked] = field(default_factory=lambda: [Walked()])
    rows: list[tuple[bytes, bytes]] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys("brt", 0))
    illegal: int = 0
    last: str = ""
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: bytes, text: bytes, initial: str, fault: str) -> None:
        self.rows.append((role, text))
        self.kinds.append(initial + ("d" if fault in "br" else fault) if fault else initial)
        if fault:
            self.faults[fault] += 1
        self.illegal += bool(self.last) and self.last + initial not in LEGAL_PAIRS
        self.last = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def gaps(self) -> int:
        return 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns


class Walker:
    """Walks batches of conversations through the grammar in DuckDB."""

    def __init__(self) -> None:
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "512MB", "temp_directory": ""})
        for name, columns, rows in (("moves", "kind VARCHAR, state INTEGER, next INTEGER, cost BIGINT, edits VARCHAR", moves()), ("endings", "state INTEGER, cost BIGINT, edits VARCHAR", endings())):
            self.db.execute(f"CREATE TABLE {name} ({columns})")
            self.db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)

    def walk(self, going: list[Conversation], ended: int) -> list[Walked]:
        """Walk all waiting turns. The first ``ended`` conversations end: their cheapest repairs are returned. The others keep their states."""
        begun = [(i, w.state, w.cost, prior) for i, c in enumerate(going) for prior, w in enumerate(c.states)]
        turns = [(i, k, kind) for i, c in enumerate(going) for k, kind in enumerate(c.kinds)]
        for name, columns, rows in (("begun", (("conv", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("prior", pa.int64())), begun), ("turns", (("conv", pa.int64()), ("turn", pa.int64()), ("kind", pa.string())), turns)):
            self.db.register(name, pa.table([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(columns), columns, strict=True)], [n for n, _ in columns]))
        self.db.execute(WALK)
        best = self.db.execute(BEST, [ended]).fetchall()
        out = [going[i].states[prior].after(cost, audit, going[i].rows) for i, cost, prior, audit in best]
        left: dict[int, list[Walked]] = {}
        for i, cost, prior, audit in self.db.execute("SELECT conv, cost, prior, audit FROM walked WHERE conv >= ?", [ended]).fetchall():
            left.setdefault(i, []).append(going[i].states[prior].after(cost, audit, going[i].rows))
        for i, states in left.items():
            going[i].states = sorted(states, key=lambda w: w.audit)
            going[i].rows, going[i].kinds = [], []
        return out


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each ``conv_id`` of ``turns`` (conv_id, turn, role, text), null included.

    A conversation's rows are in order of ``turn`` (nulls first), then role and text. Null roles and texts count as one space. Rows for which ``present`` isn't true only name their conversation. Each row's first
    fault counts: blank (nothing but ASCII white space), duplicate (its role and text are in an earlier row of the conversation), truncated (the last other character is none of ``.!?``). ``gaps``: turn
    numbers that are missing between the smallest and the largest. ``illegal``: neighbouring role initials that aren't in ``LEGAL_PAIRS``. ``audit``: the initials of the edits Keep, Rerole, Delete and Insert
    in order. ``repaired_sha256``: of the repaired ``role:text`` joined by newlines, by their bytes. A conversation without rows has zeros, an empty audit and the hash of nothing. An empty role has no
    initial that the grammar takes. Other columns aren't read, so none can clash; no rows, no result. :func:`repaired_turns` gives the repaired turns.
    """
    present = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", F.when(present, F.col("turn").cast("long")).alias("turn"), present.alias("present"), F.when(present, role).alias("role"), F.when(present, text).alias("text"))
    # Everything below stays within this dealing by conversation.
    dealt = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn")) > 1
    visible = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(visible == "", "b").when(F.col("again"), "r").when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    initial = F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("?")
    ordered = dealt.withColumn("again", again).sortWithinPartitions("conv_id", "turn", "role", "text")
    streamed = ordered.select("conv_id", "present", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), initial.alias("initial"), fault.alias("fault"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    turns.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, going, waiting, id_type = None, [], 0, None

        def ended(n: int) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for c, w in zip(going[:n], walker.walk(going, n), strict=True):
                for column, value in zip(columns, (c.conv_id, c.gaps(), *c.faults.values(), c.illegal, w.cost, w.audit, w.digest.hexdigest()), strict=True):
                    column.append(value)
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            walker, id_type = walker or Walker(), batch.column("conv_id").type
            whole = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "initial", "fault")), texts_of(batch, "role"), texts_of(batch), strict=True)
            for conv_id, there, turn, initial, fault, role, text in whole:
                if not going or conv_id != going[-1].conv_id:
                    going.append(Conversation(conv_id))
                if there:
                    going[-1].add(turn, role, text, initial, fault)
                    waiting += 1
                if waiting >= BATCH_TURNS or len(going[-1].rows) >= LONG_TURNS or len(going) > BATCH_TURNS:
                    yield ended(len(going) - 1)
                    going, waiting = going[-1:], 0
        if going:
            yield ended(len(going))

    return streamed.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, repaired: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, position, role, text): the turns that the edits in ``repaired`` (conv_id, audit) make of ``turns``, in order of ``position`` from 0."""
    rows = turns.where(F.lit(True) if present is None else present)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).select("conv_id", "role", "text", F.row_number().over(order).alias("row"))
    edits = repaired.select("conv_id", F.posexplode(F.split("audit", "")).alias("place", "edit")).where("edit != ''")
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumns({"row": F.count_if(F.col("edit") != "I").over(so_far).cast("int"), "position": (F.count_if(F.col("edit") != "D").over(so_far) - 1)})
    same = edits["conv_id"].eqNullSafe(numbered["conv_id"]) & (edits["row"] == numbered["row"]) & (edits["edit"] != "I")
    found = edits.where("edit != 'D'").join(numbered, same, "left").select(edits["conv_id"], "position", "edit", F.coalesce("role", F.lit("")).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    by_conv = Window.partitionBy("conv_id")
    system = F.max((F.col("position") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s")).over(by_conv).cast("int")
    given = F.when(F.pmod(F.col("position") - system, F.lit(2)) == 0, ROLES["u"]).otherwise(ROLES["a"])
    return found.withColumn("role", F.when(F.col("edit") == "K", F.col("role")).otherwise(given)).select("conv_id", "position", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): ``conversations`` with the faults that the query plants, by the hash of conversation and turn."""
    role, text, *key = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text", "conv_id", "turn"))
    fault = F.pmod(F.crc32(F.concat_ws(":", *key).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("fault") != 0).alias("present"), copies.alias("copy")).drop("copy")
