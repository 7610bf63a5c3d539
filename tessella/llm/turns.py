"""Conversation structure repair: the cheapest edits after which a conversation's roles alternate.

Roles count by their initials, which must read (s?(ua)+)?. Conversations are dealt by a hash of their id and streamed in order of
turns. In each batch one recursive DuckDB query advances every conversation of the batch by a turn a step, and keeps for every grammar
state the cheapest cost and the least of its audits. Long conversations are cut in segments that start from every state and are put
together afterwards, so a batch takes SEGMENT steps whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, owns_memory

#: The grammar as an automaton: 0 nothing yet, 1 after the system's turn, 2 after the user's, 3 after the assistant's. Fixed values.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
#: What ends a conversation in each state: so many inserted turns.
CLOSE = (0, 2, 1, 0)
#: Costs of the edits and of a truncated turn that stays. Fixed values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
INITIALS = ("s", "u", "a", "")
#: Turns and bytes of a batch, and turns of one conversation that form a segment.
BATCH_TURNS, BATCH_TEXT, SEGMENT = 8192, 8 << 20, 64

_WALK = """
WITH RECURSIVE walk(seg, t, start, q, best) AS (
  SELECT seg, 0, start, start, {'cost': 0::BIGINT, 'audit': ''} FROM entries
  UNION ALL
  SELECT w.seg, w.t + 1, w.start, m.after, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edits})
  FROM walk w JOIN turns r ON r.seg = w.seg AND r.t = w.t + 1 JOIN moves m ON m.before = w.q AND m.kind = r.kind
  GROUP BY w.seg, w.t, w.start, m.after
)
SELECT w.seg, w.start, w.q, w.best.cost, w.best.audit FROM walk w JOIN entries e ON e.seg = w.seg AND e.start = w.start AND e.length = w.t
"""


def moves() -> list[tuple[int, int, int, int, str]]:
    """(before, kind of turn, after, cost, edits): up to two inserted turns and what happens to the turn itself.

    Kind 0 must go; 1 to 4 are turns with the initials in INITIALS, 5 to 8 the same, truncated. A third insertion in a row comes back to an
    earlier state, so it is never cheapest.
    """
    out = []
    for before in range(4):
        at = before
        for n in range(3):
            for kind in range(9):
                out.append((before, kind, at, n * INSERT + DELETE, "I" * n + "D"))
                if kind:
                    cost = n * INSERT + (TRUNCATED if kind > 4 else 0)
                    if after := STEPS.get((at, INITIALS[(kind - 1) % 4])):
                        out.append((before, kind, after, cost + KEEP, "I" * n + "K"))
                    out.append((before, kind, STEPS[at, WANTED[at]], cost + REROLE, "I" * n + "R"))
            at = STEPS[at, WANTED[at]]
    return out


@cache
def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    con.execute("CREATE TABLE moves(before INT, kind INT, after INT, cost INT, edits VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    return con


class _Path:
    """The best way into one state so far: cost, place among the audits of the conversation's other states, edits, hash of the repaired turns."""

    __slots__ = ("cost", "rank", "audit", "sha", "any")

    def __init__(self, cost: int = 0, rank: int = 0, audit: tuple | None = None, sha=None, some: bool = False):
        self.cost, self.rank, self.audit, self.sha, self.any = cost, rank, audit, sha or hashlib.sha256(), some

    def after(self, cost: int, edits: str, state: int, turns: list[tuple[str, str]]) -> _Path:
        out = _Path(self.cost + cost, 0, (self.audit, edits), self.sha.copy(), self.any)
        shown = "".join(f"\n{x}" for x in repaired(edits, state, turns))
        if shown:
            out.sha.update((shown if self.any else shown[1:]).encode())
            out.any = True
        return out

    def edits(self) -> str:
        parts, at = [], self.audit
        while at:
            parts.append(at[1])
            at = at[0]
        return "".join(reversed(parts))


def repaired(edits: str, state: int, turns: list[tuple[str, str]]) -> Iterator[str]:
    """role:text of what the edits leave of (role, text) turns, from a grammar state on."""
    at = iter(turns)
    for edit in edits:
        if edit == "I":
            role, text = ROLES[WANTED[state]], ""
        else:
            role, text = next(at)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[WANTED[state]]
        state = STEPS[state, role[:1]]
        yield f"{role}:{text}"


class _Conversation:
    """One conversation while its turns come in: counts, and the best path into each state."""

    def __init__(self, key):
        self.key, self.paths, self.pending = key, {0: _Path()}, []
        self.low = self.high = self.last = self.initial = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def kind(self, turn: int | None, role: str, text: str, first: bool) -> int:
        if turn is not None:
            if self.last != turn:
                self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.last = self.high = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        seen = text.rstrip(BLANKS)
        if not seen:
            self.blank += 1
            return 0
        if not first:
            self.duplicate += 1
            return 0
        kind = INITIALS.index(initial) + 1 if initial in ("s", "u", "a") else 4
        if seen[-1] not in ".!?":
            self.truncated += 1
            kind += 4
        return kind

    def advance(self, found: dict[int, list[tuple[int, int, str]]], turns: list[tuple[str, str]]) -> None:
        """Over one segment; found: for a start state (state, cost, edits)."""
        best = {}
        for start, ends in found.items():
            p = self.paths.get(start)
            for state, cost, edits in ends if p else ():
                key = (p.cost + cost, p.rank, edits)
                if state not in best or key < best[state][0]:
                    best[state] = key, start, cost
        paths = {state: self.paths[start].after(cost, key[2], start, turns) for state, (key, start, cost) in best.items()}
        for rank, (_, state) in enumerate(sorted((key[1:], state) for state, (key, _, _) in best.items())):
            paths[state].rank = rank
        self.paths = paths

    def row(self) -> tuple:
        _, state = min((((p.cost + CLOSE[q] * INSERT), p.rank, "I" * CLOSE[q]), q) for q, p in self.paths.items())
        last = self.paths[state].after(CLOSE[state] * INSERT, "I" * CLOSE[state], state, [])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, last.cost, last.edits(), last.sha.hexdigest()


class _Batch:
    """Segments of conversations that are advanced together."""

    def __init__(self):
        self.segments: list[tuple[_Conversation, list[tuple[str, str]], tuple[int, ...]]] = []
        self.seg, self.t, self.kinds, self.bytes = [], [], [], 0

    def add(self, c: _Conversation, kind: int, role: str, text: str) -> None:
        if not c.pending or len(c.pending[-1]) >= SEGMENT:
            c.pending.append([])
            fresh = len(c.pending) == 1 and c.paths.keys() == {0}
            self.segments.append((c, c.pending[-1], (0,) if fresh else (0, 1, 2, 3)))
        c.pending[-1].append((role, text))
        self.seg.append(len(self.segments) - 1)
        self.t.append(len(c.pending[-1]))
        self.kinds.append(kind)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.t) >= BATCH_TURNS or self.bytes >= BATCH_TEXT

    def run(self) -> None:
        if not self.t:
            return
        con = _connection()
        starts = [(i, s, len(turns)) for i, (_, turns, begin) in enumerate(self.segments) for s in begin]
        con.register("turns", pa.table({"seg": pa.array(self.seg, pa.int32()), "t": pa.array(self.t, pa.int32()), "kind": pa.array(self.kinds, pa.int32())}))
        con.register("entries", pa.table(dict(zip(("seg", "start", "length"), (pa.array(x, pa.int32()) for x in zip(*starts, strict=True)), strict=True))))
        found: list[dict[int, list]] = [{} for _ in self.segments]
        for seg, start, state, cost, audit in con.execute(_WALK).fetchall():
            found[seg].setdefault(start, []).append((state, cost, audit))
        con.unregister("turns")
        con.unregister("entries")
        for (c, turns, _), ends in zip(self.segments, found, strict=True):
            c.advance(ends, turns)
            c.pending = []


def _repair(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("turns", _connection.cache_clear)
        batch, done, now = _Batch(), [], None

        def shown(rows: list[_Conversation]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*(c.row() for c in rows), strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for key, present, turn, role, text, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or key != now.key:
                    if now:
                        done.append(now)
                    now = _Conversation(key)
                if present:
                    batch.add(now, now.kind(turn, role, text, first), role, text)
                if batch.full():
                    batch.run()
                    batch = _Batch()
                    if done:
                        yield shown(done)
                    done = []
            if len(done) >= BATCH_TURNS:
                batch.run()
                batch = _Batch()
                yield shown(done)
                done = []
        batch.run()
        if now:
            yield shown([*done, now])

    return run


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conv_id.

    conversations has conv_id, turn, role, text, and may have present, false where a row only says that its conversation exists; other columns aren't read. Null roles and
    texts are one space; null ids form one conversation; null turns come first and count in no gap. Rows of one turn are taken by role and text,
    repeated rows one after the other, each after the first a duplicate. A turn's first fault counts: blank, duplicate, truncated. A role without an initial of
    its own (empty, or another letter) fits nowhere and must be given another role or go. No rows give no rows.

    One shuffle by conv_id. A conversation is read by one task, as the digest of its turns is made in their order, but as a stream: of any conversation only
    a batch of turns is held, with the four best edits so far (as long as the result itself).
    """
    bounded_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce("present", F.lit(True)) if "present" in conversations.columns else F.lit(True)
    rows = conversations.select("conv_id", present.alias("present"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("first", F.row_number().over(same) == 1)
    rows = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", F.desc("first"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, {COUNTS}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return rows.mapInArrow(_repair(to_arrow_schema(StructType.fromDDL(out))), out)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the conversations after repair(), by joins of the edits with the turns they belong to.

    What repair() says of odd rows holds here. Conversations of which nothing stays have no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations if "present" not in conversations.columns else conversations.where(F.coalesce("present", F.lit(True)))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).withColumn("at", F.row_number().over(order) - 1)
    # edits end with what happens to a turn; those after the last turn stand alone
    edits = repair(conversations).select("conv_id", F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[DKR]|I+$)"), F.lit(1))).alias("at", "edits"))
    both = edits.join(rows, edits.conv_id.eqNullSafe(rows.conv_id) & (edits["at"] == rows["at"]), "left").select(edits.conv_id, edits["at"], "edits", "role", "text")
    one = both.select("conv_id", "at", "role", "text", F.posexplode(F.split("edits", "")).alias("i", "edit")).where("edit <> 'D' and edit <> ''")
    line = Window.partitionBy("conv_id").orderBy("at", "i")
    one = one.withColumn("place", F.row_number().over(line) - 1)
    # the first place may be the system's; every other role follows from the place
    system = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    role = F.when((F.col("place") - F.col("system")) % 2 == 0, "user").otherwise("assistant")
    one = one.withColumn("system", system)
    return one.select("conv_id", F.col("place").cast("long").alias("place"), "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(role).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by crc32("conv_id:turn") % 20. 0 drops a row (present is false), 1 empties its text, 2 takes its
    [.!?], 3 repeats it, 4 makes its role user. Nulls are one space, also in the key."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(shown("role"))
    rows = conversations.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


#: The same faults, and the cheapest edits by a recursion over every row of every conversation that carries the repaired text along.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), '') AS k
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(k, lambda c: ord(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded)
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM damaged
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS t FROM counted
), faults AS (
  SELECT conv_id, turn, role, text, t, role[1:1] AS c, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY t) AS before
  FROM numbered
), steps(q, c, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(q, edits, said, after) AS (
  VALUES (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3)
  UNION ALL
  SELECT i.q, i.edits || 'I', i.said || CASE s.c WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END, s.after FROM inserts i JOIN steps s ON s.q = i.after AND s.c <> 's' WHERE len(i.edits) < 2
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS t, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS best FROM conversations
  UNION ALL
  SELECT conv_id, t, q, min({'cost': cost, 'audit': audit, 'said': said}) FROM (
    SELECT w.conv_id, f.t, i.after AS q, w.best.cost + 2 * len(i.edits) + 3 AS cost, w.best.audit || i.edits || 'D' AS audit, w.best.said || i.said AS said
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.t = w.t + 1 JOIN inserts i ON i.q = w.q
    UNION ALL
    SELECT w.conv_id, f.t, s.after, w.best.cost + 2 * len(i.edits) + CASE WHEN s.c = f.c THEN 0 ELSE 2 END + CASE f.fault WHEN 'truncated' THEN 1 ELSE 0 END,
      w.best.audit || i.edits || CASE WHEN s.c = f.c THEN 'K' ELSE 'R' END, w.best.said || i.said || chr(10) || CASE WHEN s.c = f.c THEN f.role WHEN s.c = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text
    FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.t = w.t + 1 JOIN inserts i ON i.q = w.q JOIN steps s ON s.q = i.after
    WHERE f.fault NOT IN ('blank', 'duplicate') AND (s.c = f.c OR s.c <> 's')
  ) GROUP BY conv_id, t, q
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + 2 * len(i.edits), 'audit': w.best.audit || i.edits, 'said': w.best.said || i.said}) AS best
  FROM walk w LEFT JOIN (SELECT conv_id, max(t) AS t FROM faults GROUP BY conv_id) n ON n.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts i ON i.q = w.q AND i.after IN (0, 3)
  WHERE w.t = coalesce(n.t, 0) GROUP BY w.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, c) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  e.best.cost AS cost, e.best.audit AS audit, sha256(e.best.said[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
