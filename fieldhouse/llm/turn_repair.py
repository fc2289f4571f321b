"""Repair of conversation structure: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

Rows of a conversation are ordered by turn (nulls first), equal turns by role, then text; repeated rows stay. Each row has at
most one fault, the first that fits: blank (no character but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space is not one of `.!?`). Edits: Keep 0, Rerole to user or
assistant 2, Delete 3 (required for blank and duplicate rows), Insert an empty user or assistant turn 2; a truncated row
that stays adds 1.

The edit lattice has a node for each number of rows consumed and each state of the grammar (4). Dijkstra's search runs over
it from both ends: forward and reverse heaps meet, and both go on until the sum of their least keys exceeds the best cost, so
that every crossing of equal cost is known. Among all paths through those crossings the one with the ASCII-least audit
(initials of the edits in order) is walked letter by letter over the nodes of the optimal paths, without storing strings.
An audit determines the repaired turns: insertions and reroles can only give the one role that the grammar asks for.

Rows are partitioned by conversation and sorted, and tasks stream over them: a task holds one conversation at a time. A
conversation is the record of this operator and must fit a task's memory, at about 400 bytes a row besides its texts;
rows with null conv_id are one conversation. Null roles and texts read as one space, so they are blank or have no legal
role; a role's initial is its first character, an empty role has none and cannot be kept. Extra columns are ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.util import small_batches, trimmed

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. A role's initial moves one to the next.
STATES = 4
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that a chosen (reroled or inserted) turn leads to, and the states that it comes from.
CHOSEN = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
ENDS = (0, 3)
NAMES = {2: "user", 3: "assistant"}
FINE, TRUNCATED, LOST = 0, 1, 2

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


class Lattice:
    """Edges between nodes `rows consumed * 4 + state`, for rows with these role initials and faults."""

    def __init__(self, initials: list[str], faults: bytes):
        self.initials, self.faults, self.n = initials, faults, len(faults)

    def onward(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(letter, next node, cost) in the order of the letters."""
        i, state = divmod(node, STATES)
        if i < self.n:
            yield "D", node + STATES, DELETE
        yield "I", node - state + CHOSEN[state], INSERT
        if i < self.n and self.faults[i] != LOST:
            kept = MOVES.get((state, self.initials[i]))
            if kept is not None:
                yield "K", (i + 1) * STATES + kept, CUT * self.faults[i]
            yield "R", (i + 1) * STATES + CHOSEN[state], REROLE + CUT * self.faults[i]

    def back(self, node: int) -> Iterator[tuple[int, int]]:
        """(previous node, cost)."""
        i, state = divmod(node, STATES)
        for before in BEFORE[state]:
            yield i * STATES + before, INSERT
        if i:
            yield node - STATES, DELETE
            if self.faults[i - 1] != LOST:
                cut = CUT * self.faults[i - 1]
                for before in BEFORE[state]:
                    yield (i - 1) * STATES + before, REROLE + cut
                for before in range(STATES):
                    if MOVES.get((before, self.initials[i - 1])) == state:
                        yield (i - 1) * STATES + before, cut


def cheapest(initials: list[str], faults: bytes) -> tuple[int, str]:
    """The least cost and, among the audits of that cost, the ASCII-least."""
    lattice = Lattice(initials, faults)
    goals = {lattice.n * STATES + state for state in ENDS}
    far = 1 << 60
    reach: list[dict[int, int]] = [{0: 0}, dict.fromkeys(goals, 0)]  # tentative costs from the start, to the end
    done: list[dict[int, int]] = [{}, {}]
    heaps = [[(0, 0)], [(0, g) for g in sorted(goals)]]
    best = 0 if 0 in goals else far
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, node = heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = cost
        other = reach[1 - side]
        best = min(best, cost + other.get(node, far))
        for *_, to, step in lattice.back(node) if side else lattice.onward(node):
            if cost + step < reach[side].get(to, far):
                reach[side][to] = cost + step
                heappush(heaps[side], (cost + step, to))
                best = min(best, cost + step + other.get(to, far))
    return best, _least_audit(lattice, goals, done[0], done[1], best)


def _least_audit(lattice: Lattice, goals: set[int], forward: dict[int, int], reverse: dict[int, int], best: int) -> str:
    """Every node of an optimal path is settled from one side at least. Nodes settled from the start are kept if they end a path
    at the best cost, an edge crosses from them to the other side at that cost, or leads to such a node; then the least letter
    is walked."""
    useful: set[int] = set()

    def leads(cost: int, to: int, step: int) -> bool:
        if to in reverse:
            return cost + step + reverse[to] == best
        return to in useful and forward[to] == cost + step

    for node in sorted(forward, key=lambda v: (forward[v], v // STATES), reverse=True):  # edges of cost 0 consume a row
        cost = forward[node]
        if (node in goals and cost == best) or reverse.get(node, -1) == best - cost or any(leads(cost, to, step) for _, to, step in lattice.onward(node)):
            useful.add(node)
    at, cost, letters = {0}, 0, []
    while not (cost == best and at & goals):
        steps: dict[str, tuple[set[int], int]] = {}
        for node in at:
            for letter, to, step in lattice.onward(node):
                if leads(cost, to, step):
                    steps.setdefault(letter, (set(), step))[0].add(to)
        letter = min(steps)
        at, step = steps[letter]
        cost += step
        letters.append(letter)
    return "".join(letters)


def faults_of(rows: list[tuple[str, str]]) -> tuple[bytes, list[int]]:
    """The kind of each (role, text) for the search, and the counts of blank, duplicate and truncated rows."""
    seen, kinds, counts = set(), bytearray(), [0, 0, 0]
    for row in rows:
        said = row[1].rstrip(SPACE)
        fault = 0 if not said else 1 if row in seen else 2 if said[-1] not in ".!?" else None
        seen.add(row)
        if fault is not None:
            counts[fault] += 1
        kinds.append(FINE if fault is None else TRUNCATED if fault == 2 else LOST)
    return bytes(kinds), counts


def repaired_turns(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    out, state, at = [], 0, 0
    for letter in audit:
        if letter == "K":
            state = MOVES[state, rows[at][0][:1]]
            out.append(rows[at])
        elif letter != "D":
            state = CHOSEN[state]
            out.append((NAMES[state], rows[at][1] if letter == "R" else ""))
        at += letter != "I"
    return out


def _repair(conv_id: int | None, turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    kinds, (blank, duplicate, truncated) = faults_of(rows)
    initials = [role[:1] for role, _ in rows]
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(initials, kinds)
    return conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, [{"role": r, "text": t} for r, t in repaired_turns(rows, audit)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition, one after the other."""
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    now: object = _stream  # no conversation yet
    turns: list[int | None] = []
    rows: list[tuple[str, str]] = []
    out: list[tuple] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), f.type) for column, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        for conv_id, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
            if now is _stream or conv_id != now:
                if now is not _stream:
                    out.append(_repair(now, turns, rows))
                    if len(out) >= 500 or size > 8_000_000:
                        yield flushed()
                        out, size = [], 0
                now, turns, rows = conv_id, [], []
            if present:
                turns.append(turn)
                rows.append((role, text))
                size += len(text)
    if now is not _stream:
        out.append(_repair(now, turns, rows))
        yield flushed()


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conv_id: gaps in the turn numbers, counts of faults and of illegal neighbours, the cost and audit of the
    cheapest edits, and the repaired turns. Rows for which `present` is not true name their conversation but are no turns."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("present"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(trimmed(_stream), RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as op11 damages them, by crc32 of `conv_id:turn` (nulls: one space) modulo 20, with whether a row is left."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(times).alias("copy")).drop("copy")


def contract(conversations: DataFrame) -> DataFrame:
    """The columns of op11, over the damaged conversations."""
    rows = damaged(conversations)
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repair(rows, F.col("present")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256")
    )


#: crc32 of a key, bit by bit: the first bit of each byte takes the byte in.
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(8 * length(k)), lambda i: CASE WHEN i % 8 = 0 THEN CAST(unicode(substr(k, CAST(i // 8 AS BIGINT) + 1, 1)) AS BIGINT) ELSE 0 END)), lambda c, x: xor((xor(c, x) >> 1), CAST(3988292384 AS BIGINT) * (xor(c, x) & 1))), 4294967295)"
#: A state's least (cost, audit) as one string: nine digits, then the audit; null where it cannot be reached.
_ADD = "lpad(CAST(CAST(substr({0}, 1, 9) AS BIGINT) + {1} AS VARCHAR), 9, '0') || substr({0}, 10) || '{2}'"


def _closed(q: str) -> list[str]:
    """Four expressions: each state with up to two insertions after the row, from the columns q0 to q3."""
    ins = [_ADD.format(f"{q}{k}", INSERT, "I") for k in range(STATES)]
    twice = {k: _ADD.format(f"({ins[k]})", INSERT, "I") for k in range(STATES)}
    return [f"{q}0", f"{q}1", f"least({q}2, {ins[0]}, {ins[1]}, {ins[3]})", f"least({q}3, {ins[2]}, {twice[0]}, {twice[1]})"]


def _stepped() -> list[str]:
    """Four expressions over the closed states c0 to c3 and the row's initial r and kind."""
    drop = [_ADD.format(f"c{k}", DELETE, "D") for k in range(STATES)]
    keep = {k: _ADD.format(f"c{k}", "f", "K") for k in range(STATES)}
    role = {k: _ADD.format(f"c{k}", f"{REROLE} + f", "R") for k in range(STATES)}
    stay = lambda initial, k: f"CASE WHEN r = '{initial}' AND f < 2 THEN {keep[k]} END"
    chosen = lambda k: f"CASE WHEN f < 2 THEN {role[k]} END"
    to_user = ", ".join(f"{stay('u', k)}, {chosen(k)}" for k in (0, 1, 3))
    return [drop[0], f"least({drop[1]}, {stay('s', 0)})", f"least({drop[2]}, {to_user})", f"least({drop[3]}, {stay('a', 2)}, {chosen(2)})"]


def _oracle() -> str:
    closed = ", ".join(f"{x} AS c{k}" for k, x in enumerate(_closed("q")))
    stepped = ", ".join(f"{x} AS q{k}" for k, x in enumerate(_stepped()))
    letters = "list_transform(range(1, length(audit) + 1), lambda i: substr(audit, i, 1))"
    return f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM source),
rows AS (
  SELECT row_number() OVER (ORDER BY turn NULLS FIRST) AS id, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER w AS n, left(role, 1) AS r, lag(left(role, 1)) OVER w AS r0, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY id) AS again
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id)),
faulty AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN said = '' OR again > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f FROM placed),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3 FROM source
  UNION ALL
  SELECT conv_id, n, {stepped} FROM (
    SELECT w.conv_id, p.n, p.r, p.f, {closed} FROM walk w JOIN faulty p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.n = w.n + 1) AS z),
least_cost AS (
  SELECT conv_id, least(q0, c3) AS won FROM (SELECT conv_id, n, {closed}, q0 FROM walk) AS y
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
audits AS (SELECT conv_id, CAST(substr(won, 1, 9) AS BIGINT) AS cost, substr(won, 10) AS audit FROM least_cost),
letters AS (SELECT conv_id, cost, audit, unnest({letters}) AS letter, unnest(range(1, length(audit) + 1)) AS place FROM audits),
turns AS (
  SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY place) AS n, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY place) AS m,
    sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS every FROM letters),
told AS (
  SELECT t.conv_id, string_agg(CASE WHEN letter = 'K' THEN p.role WHEN (t.m - t.every % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE p.text END, chr(10) ORDER BY place) AS lines
  FROM turns t LEFT JOIN faulty p ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.n = t.n WHERE letter <> 'D' GROUP BY t.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (n > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  a.cost, a.audit, sha256(coalesce(t.lines, '')) AS repaired_sha256
FROM audits a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE_SQL = _oracle()
