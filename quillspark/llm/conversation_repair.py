"""Repairing the structure of conversations by alignment to an alternating grammar.

A conversation should have the role initials ``(s?(ua)+)?``.  Its turns are
aligned to the grammar's string of each feasible length (Wagner-Fischer), only
in the band of cells that the cheapest alignment so far leaves open (Ukkonen),
and of equally cheap alignments the one with the least audit counts.

Turns go by in order, in blocks of bounded size.  A block is aligned from each
state the turns before it can have ended in, and a state keeps the cheapest
way to it: its cost, its audit and the running hash of the repaired text.  A
conversation of any length therefore needs the memory of one block and of its
own audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, ship

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns that are aligned at once.  The result does not depend on it.
BLOCK = 24
#: What may end a text, and what doesn't count as text.
ENDS, BLANKS = ".!?", " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
#: After them the conversation may end.
FINAL = frozenset(("", "a"))
FAR = 1 << 60
#: What any end of a conversation costs more, at most, after the inner initial than after the outer one.
DETOURS = {"": {"a": DELETE, "u": DELETE + INSERT}, "s": {"a": 0, "u": INSERT}, "u": {"a": INSERT}, "a": {"u": INSERT}}

REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass(frozen=True)
class Turn:
    initial: str
    role: str
    text: str
    must_go: bool
    truncated: bool


def targets(state: str, length: int) -> Iterator[str]:
    """The strings of ``length`` initials that may follow ``state``, the last initial so far ("" at the start)."""
    first, second = ("a", "u") if state == "u" else ("u", "a")
    yield (first + second) * (length // 2) + first * (length % 2)
    if state == "" and length:
        yield "s" + "ua" * ((length - 1) // 2) + "u" * ((length - 1) % 2)


def align(turns: list[Turn], target: str, most: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that turn ``turns`` into ``target``, the least audit of equals; None if they cost over ``most``.

    The matrix holds the cost from each cell to the end, so the audit is read
    from its front: at each cell the least letter that stays cheapest.
    """
    n, m = len(turns), len(target)
    free = [0] * (n + 1)  # turns that may stay, among the first i
    for i, t in enumerate(turns):
        free[i + 1] = free[i] + (not t.must_go)
    spare = most - DELETE * (n - free[n])
    need = lambda d: INSERT * d if d > 0 else -DELETE * d  # noqa: E731  at least, to move d diagonals
    skew = m - free[n]
    band = [d for d in range(-free[n], m + 1) if need(d) + need(skew - d) <= spare]
    if not band:
        return None
    low, high = band[0], band[-1]
    cost = [[FAR] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = cost[i], cost[i + 1] if i < n else None
        for j in range(min(m, free[i] + high), max(0, free[i] + low) - 1, -1):
            best = FAR
            if below is not None:
                t = turns[i]
                best = DELETE + below[j]
                if j < m and not t.must_go:
                    if t.initial == target[j]:
                        best = min(best, below[j + 1] + TRUNCATED * t.truncated)
                    elif target[j] != "s":
                        best = min(best, below[j + 1] + REROLE + TRUNCATED * t.truncated)
            elif j == m:
                best = 0
            if j < m and target[j] != "s":
                best = min(best, INSERT + row[j + 1])
            row[j] = best
    if cost[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = cost[i][j]
        if i < n and left == DELETE + cost[i + 1][j]:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and left == INSERT + cost[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].initial == target[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def alignments(turns: list[Turn], state: str, ends: frozenset[str] | None = None) -> dict[str, tuple[int, str]]:
    """For each state in which ``turns`` can end after ``state`` (of ``ends`` only, if given): (cost, audit) of the cheapest edits.

    Lengths are tried from the number of turns that may stay outwards, so the
    first costs are low and the bands of the others narrow; a direction ends
    where the difference in length alone costs more than what it could better.
    """
    stay = sum(not t.must_go for t in turns)
    base = DELETE * (len(turns) - stay)
    # deleting every turn, and then adding one or two, is always possible
    ceiling = DELETE * len(turns) + 2 * INSERT
    found: dict[str, tuple[int, str]] = {}

    def better(target: str) -> None:
        q = target[-1] if target else state
        if ends is None or q in ends:
            got = align(turns, target, found[q][0] if q in found else ceiling)
            if got is not None and (q not in found or got < found[q]):
                found[q] = got

    if state in ("", "s"):
        better("")
    if state == "":
        better("s")
    open_ = [q for q in "ua" if ends is None or q in ends]  # what any length may end in
    for lengths, step in ((range(stay, -1, -1), DELETE), (range(stay + 1, stay + 2 + ceiling // INSERT), INSERT)):
        for length in lengths:
            if base + step * abs(length - stay) > max(found.get(q, (ceiling,))[0] for q in open_):
                break
            for target in targets(state, length):
                if target not in ("", "s") or state in "ua" and state:
                    better(target)
    return found


class Repair:
    """The cheapest ways through one conversation's turns so far, a way for each state they can end in."""

    def __init__(self):
        self.ways = {"": (0, "", hashlib.sha256(), True)}  # cost, audit where the ways differ, hash, nothing yet
        self.agreed: list[str] = []
        self.block: list[Turn] = []

    def add(self, turn: Turn) -> None:
        if len(self.block) == BLOCK:
            self._close(None)
        self.block.append(turn)

    def _close(self, ends: frozenset[str] | None) -> None:
        best: dict[str, tuple[int, str, str, str]] = {}
        for state, (cost, audit, _, _) in self.ways.items():
            for q, (more, edits) in alignments(self.block, state, ends).items():
                now = (cost + more, audit + edits, state, edits)
                if q not in best or now[:2] < best[q][:2]:
                    best[q] = now
        if ends is not None:  # the conversation is over
            best = dict([min(best.items(), key=lambda x: x[1][:2])])
        # a way that costs more than another one and the detour from there can't become the cheapest
        best = {q: x for q, x in best.items() if all(p not in best or x[0] <= best[p][0] + more for p, more in DETOURS.get(q, {}).items())}
        ways = {q: (cost, audit, *self._text(state, edits)) for q, (cost, audit, state, edits) in best.items()}
        known = _common([x[1] for x in ways.values()])
        if known:
            self.agreed.append(next(iter(ways.values()))[1][:known])
        self.ways = {q: (cost, audit[known:], digest, empty) for q, (cost, audit, digest, empty) in ways.items()}
        self.block = []

    def _text(self, state: str, edits: str):
        """The hash of the way to ``state`` after ``edits`` of the block, and whether nothing is in it."""
        _, _, digest, empty = self.ways[state]
        digest, at = digest.copy(), 0
        for e in edits:
            turn = None if e == "I" else self.block[at]
            at += e != "I"
            if e == "D":
                continue
            if e == "K":
                state, role = turn.initial, turn.role
            else:
                state = "a" if state == "u" else "u"
                role = NAMES[state]
            digest.update(("" if empty else "\n").encode() + f"{role}:{turn.text if turn else ''}".encode())
            empty = False
        return digest, empty

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired text)."""
        self._close(FINAL)
        ((cost, audit, digest, _),) = self.ways.values()
        return cost, "".join(self.agreed) + audit, digest.hexdigest()


def _common(texts: list[str]) -> int:
    """The length of the longest common prefix."""
    low, high = min(texts), max(texts)
    return next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of ``rows`` (conv_id, turn, role, text), damaged by a checksum of their names.

    A twentieth of the rows each: gone, without text, without end
    marks, twice, said by the user.  Nulls of role and text are one space, and
    so they are in the name; conv_id and turn themselves stay null.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text, gone): the columns of REPAIRED.

    Rows that are ``gone`` only say that their conversation exists.  Turns go
    by turn, nulls first, then by role and text, so ties have an order too; of
    equal rows the one that repeats the other is second.
    One task reads a conversation in this order and keeps one block of it: the
    hash of the repaired text cannot be made in parts.
    """
    ship(rows.sparkSession)
    mark = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank: Column = mark == ""
    seen = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    flagged = rows.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(F.col("gone"), "gone").when(blank, "blank").when(F.col("again"), "duplicate").when(~F.substring(mark, -1, 1).isin(*ENDS), "truncated")
    ordered = flagged.select("conv_id", "turn", "role", "text", "again", fault.alias("fault")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again").drop("again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        name, any_, last_role = None, False, None
        fixed, counts, first_turn, last_turn, turns = Repair(), {}, None, None, 0

        def close() -> None:
            gaps = last_turn - first_turn + 1 - turns if turns else 0
            out.append((name, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], *fixed.finish()))

        for batch in batches:
            for conv, turn, role, text, fault_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any_ or conv != name:
                    if any_:
                        close()
                    name, any_, last_role = conv, True, None
                    fixed, counts, first_turn, last_turn, turns = Repair(), dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None, None, 0
                if fault_ == "gone":
                    continue
                if turn is not None and turn != last_turn:
                    first_turn = turn if turns == 0 else first_turn
                    last_turn, turns = turn, turns + 1
                if fault_:
                    counts[fault_] += 1
                initial = role[:1]
                counts["illegal"] += last_role is not None and last_role + initial not in LEGAL
                last_role = initial
                fixed.add(Turn(initial, role, text, fault_ in ("blank", "duplicate"), fault_ == "truncated"))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if any_:
            close()
        yield _batch(out)

    return ordered.mapInArrow(run, REPAIRED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 9
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in REPAIRED.split(", ")])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation.

    A conversation whose rows are all gone has zeros, an empty audit and the
    hash of nothing; rows without a conv_id are one conversation; an empty
    table gives no rows.
    """
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


#: The same by an automaton over the initial of the last turn: each turn is kept, changed or deleted after at most two insertions.
OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
steps AS (SELECT name, 4294967295::BIGINT AS c, 1 AS i FROM (SELECT DISTINCT name FROM named)
  UNION ALL
  SELECT name, list_reduce([xor(c, ascii(substr(name, i, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), i + 1
  FROM steps WHERE i <= length(name)),
checked AS (SELECT name, xor(c, 4294967295) % 20 AS h FROM steps WHERE i = length(name) + 1),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM named JOIN checked USING (name) WHERE h <> 0),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS mark
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN mark = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(mark, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM turns),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
inserts(before, now, more, letters, added) AS (
  VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('', 'u', 3, 'I', 'user:|'), ('s', 'u', 3, 'I', 'user:|'), ('a', 'u', 3, 'I', 'user:|'), ('u', 'a', 3, 'I', 'assistant:|'),
         ('', 'a', 6, 'II', 'user:|assistant:|'), ('s', 'a', 6, 'II', 'user:|assistant:|'), ('a', 'a', 6, 'II', 'user:|assistant:|'), ('u', 'u', 6, 'II', 'assistant:|user:|')),
ways AS (
  SELECT conv_id, 1::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM counts
  UNION ALL
  SELECT conv_id, i, state, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS r FROM (
      SELECT w.conv_id, w.i + 1 AS i, e.state, w.cost + s.more + e.cost AS cost, w.audit || s.letters || e.letter AS audit, w.said || replace(s.added, '|', chr(10)) || e.said AS said
      FROM ways w JOIN inserts s ON w.state = s.before JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i,
      LATERAL (SELECT unnest([
        {'state': s.now, 'cost': 4, 'letter': 'D', 'said': '', 'ok': true},
        {'state': f.initial, 'cost': CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END, 'letter': 'K', 'said': f.role || ':' || f.text || chr(10),
         'ok': f.fault NOT IN ('blank', 'duplicate') AND ((f.initial = 's' AND s.now = '') OR (f.initial = 'u' AND s.now <> 'u') OR (f.initial = 'a' AND s.now = 'u'))},
        {'state': CASE WHEN s.now = 'u' THEN 'a' ELSE 'u' END, 'cost': CASE WHEN f.fault = 'truncated' THEN 6 ELSE 3 END, 'letter': 'R', 'said': CASE WHEN s.now = 'u' THEN 'assistant:' ELSE 'user:' END || f.text || chr(10),
         'ok': f.fault NOT IN ('blank', 'duplicate')}], recursive := true)) e
      WHERE e.ok)) WHERE r = 1),
ended AS (
  SELECT w.conv_id, w.cost + s.more AS cost, w.audit || s.letters AS audit, w.said || replace(s.added, '|', chr(10)) AS said
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n + 1 JOIN inserts s ON w.state = s.before WHERE s.now IN ('', 'a')),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(said, greatest(length(said) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id
"""
