"""Repair of a conversation's structure by A* on its edit lattice.

A node of the lattice is (rows consumed, state of the grammar ``(s?(ua)+)?`` of role initials). Keep
costs 0, Rerole (to user or assistant, whichever the state wants) 2, Delete 3, Insert of an empty
turn 2; a truncated row that isn't deleted adds 1. The heuristic is the suffix sum of what can't
be avoided: 3 for each row that must go, 1 for each truncated one. It never falls by more than an
edge costs, so a node is settled when it is first taken. The queue is keyed (cost plus heuristic,
audit); at one node equal costs never belong to an audit and its own prefix, so the first
audit taken is the least in ASCII. Audits are linked backwards with skips, so comparing two
takes some log of their length.

Spark does the rest. Damage and faults are column expressions; conversations are streamed in the
order of their rows, first as a byte a row, from which the edits are found, then as whole rows
behind their edits, which are applied and hashed row by row: no text of a conversation waits
for another. Equal rows are found by a window over digests inside a conversation's partition.

Cases: null conv_id, turn, role or text read as one space in the checksum, and role and text as one
space in the row, which makes a null text blank; rows without a conv_id are one conversation of
null conv_id; rows of equal turn stand in the order of role, then of the MD5 of their text; rows
repeated in full are duplicates; a conversation all of whose rows are dropped has zeros, an empty
audit and the empty string's hash; very long texts are read whole; an empty table gives no rows;
further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import handing_back, table, written
from .corpus_sql import CRC_TABLE, crc32_sql

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
INITIALS = "sua"


class Audit:
    """Letters of edits, linked backwards; ``jump`` skips, so that any place is found in log steps."""

    __slots__ = ("length", "letter", "up", "jump")

    def __init__(self, letter: str = "", up: Audit | None = None):
        self.letter = letter
        if up is None:
            self.length, self.up, self.jump = 0, self, self
            return
        self.length, self.up = up.length + 1, up
        far = up.jump
        self.jump = far.jump if up.length - far.length == far.length - far.jump.length else up

    def back_to(self, length: int) -> Audit:
        at = self
        while at.length > length:
            at = at.jump if at.jump.length >= length else at.up
        return at

    def __lt__(self, other: Audit) -> bool:
        n = min(self.length, other.length)
        a, b = self.back_to(n), other.back_to(n)
        if a is b:
            return self.length < other.length
        while a.up is not b.up:
            a, b = (a.up, b.up) if a.jump is b.jump else (a.jump, b.jump)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, at = [], self
        while at.length:
            out.append(at.letter)
            at = at.up
        return "".join(reversed(out))


def _goes(state: int, initial: int) -> int:
    """The state after a turn of that initial (0 system, 1 user, 2 assistant), or -1.
    States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant."""
    if initial == 0:
        return 1 if state == 0 else -1
    if initial == 1:
        return 2 if state != 2 else -1
    return 3 if initial == 2 and state == 2 else -1


def wanted(state: int) -> int:
    return 2 if state == 2 else 1


def repair(rows: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows, each 4 * initial (3: another) + fault."""
    n = len(rows)
    charge = [DELETE if r & 3 in (BLANK, DUPLICATE) else TRUNCATED if r & 3 == CUT_OFF else 0 for r in reversed(rows)]
    rest = [*accumulate(charge, initial=0)][::-1]
    queue: list[tuple[int, Audit, int, int, int]] = [(rest[0], Audit(), 0, 0, 0)]
    settled = set()
    while True:
        _, audit, i, state, cost = heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and state in (0, 3):
            return cost, str(audit)

        def go(letter: str, to: int, at: int, price: int) -> None:
            if (at, to) not in settled:
                heappush(queue, (cost + price + rest[at], Audit(letter, audit), at, to, cost + price))

        want = wanted(state)
        go("I", _goes(state, want), i, INSERT)
        if i == n:
            continue
        initial, fault = rows[i] >> 2, rows[i] & 3
        go("D", state, i + 1, DELETE)
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED if fault == CUT_OFF else 0
        if (to := _goes(state, initial)) >= 0:
            go("K", to, i + 1, more)
        if initial != want:
            go("R", _goes(state, want), i + 1, REROLE + more)


_repaired_short = lru_cache(1 << 16)(repair)


def damaged(conversations: DataFrame) -> DataFrame:
    """c, none (the conv_id, and whether it is null), t, still (the turn, and whether it isn't null),
    role, text, gone. Dropped rows stay, marked, so that their conversation isn't forgotten."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("c"),
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("t"),
        F.col("turn").isNotNull().alias("still"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy").withColumn("m", F.md5("text"))


ORDER = ["still", "t", "role", "m"]


def _faults(rows: DataFrame) -> DataFrame:
    """Rows as c, none, t, still, gone, code: 4 * initial + fault, in the order of conversations."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate(INITIALS)], F.lit(3))
    rows = rows.withColumns({"own": own, "initial": initial}).drop("text").repartition("c", "none")
    again = F.row_number().over(Window.partitionBy("c", "none", "gone", "role", "m").orderBy("still", "t")) > 1
    fault = F.when((F.col("own") != BLANK) & again, DUPLICATE).otherwise(F.col("own"))
    return rows.withColumn("code", (4 * F.col("initial") + fault).cast("int")).sortWithinPartitions("c", "none", *ORDER).select("c", "none", "t", "still", "gone", "code")


class _Conversation:
    """What is known of a conversation whose rows come in order, in parts."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.turns, self.least, self.most = 0, None, None

    def add(self, t: np.ndarray, still: np.ndarray, code: np.ndarray) -> None:
        self.codes += code.astype(np.uint8).tobytes()
        t = t[still]
        if len(t):
            self.turns += int((t[1:] != t[:-1]).sum()) + (int(t[0]) != self.most)
            self.least = int(t[0]) if self.least is None else self.least
            self.most = int(t[-1])

    def found(self) -> tuple:
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        fault, pair = codes & 3, 4 * (codes[:-1] >> 2).astype(int) + (codes[1:] >> 2)
        cost, audit = (_repaired_short if len(codes) <= 32 else repair)(bytes(self.codes))
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        illegal = int((~np.isin(pair, (1, 4 + 2, 8 + 1))).sum())  # su, ua, au
        return (gaps, *(int((fault == k).sum()) for k in (BLANK, DUPLICATE, CUT_OFF)), illegal, cost, audit)


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_KINDS = "c bigint, none boolean, " + ", ".join(f"{x} bigint" for x in FOUND[:-1]) + ", audit string"


def edits(rows: DataFrame) -> DataFrame:
    """c, none, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``damaged``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, _Conversation()
        for x in batches:
            c, none, t, still, gone, code = (x[k].to_numpy() for k in ("c", "none", "t", "still", "gone", "code"))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (none[1:] != none[:-1])) + 1
            done = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)]):
                if a == b:
                    continue
                if now != (own := (int(c[a]), bool(none[a]))):
                    if now:
                        done.append((*now, *held.found()))
                    now, held = own, _Conversation()
                left = ~gone[a:b].astype(bool)
                held.add(t[a:b][left], still[a:b][left].astype(bool), code[a:b][left])
            yield pd.DataFrame(done, columns=["c", "none", *FOUND])
        if now:
            yield pd.DataFrame([(*now, *held.found())], columns=["c", "none", *FOUND])

    return _faults(rows).mapInPandas(handing_back(run), _KINDS)


class _Applied:
    """The repaired rows of a conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.h, self.any = audit, 0, 0, hashlib.sha256(), False

    def _put(self, initial: int, role: str, text: str) -> None:
        self.state = _goes(self.state, initial)
        self.h.update(("\n" * self.any + f"{role}:{text}").encode())
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            want = wanted(self.state)
            self._put(want, "user" if want == 1 else "assistant", "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        letter, want = self.audit[self.at], wanted(self.state)
        self.at += 1
        if letter == "K":
            self._put(INITIALS.index(role[0]), role, text)
        elif letter == "R":
            self._put(want, "user" if want == 1 else "assistant", text)

    def digest(self) -> str:
        self._inserts()
        return self.h.hexdigest()


def applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: each conversation's edits come first, its rows after them."""
    lead = found.select("c", "none", F.lit(0).alias("kind"), *[F.col(x).cast("bigint") for x in FOUND[:-1]], "audit")
    both = rows.where("not gone").withColumn("kind", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    both = both.repartition("c", "none").sortWithinPartitions("c", "none", "kind", *ORDER)
    both = both.select("c", "none", "kind", "role", "text", *[F.coalesce(x, F.lit(0)).alias(x) for x in FOUND[:-1]], "audit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, held = None, None
        columns = ["c", "none", *FOUND, "repaired_sha256"]
        for x in batches:
            done = []
            for kind, role, text, *lead in x[["kind", "role", "text", *columns[:-1]]].itertuples(index=False):
                if kind == 0:
                    if held:
                        done.append((*head, held.digest()))
                    head, held = lead, _Applied(lead[-1])
                else:
                    held.add(role, text)
            yield pd.DataFrame(done, columns=columns)
        if held:
            yield pd.DataFrame([(*head, held.digest())], columns=columns)

    return both.mapInPandas(handing_back(run), _KINDS + ", repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations)
    out = applied(rows, written(edits(rows), "edits"))
    return out.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), *FOUND, "repaired_sha256")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _costs(x: str, more: str, letter: str) -> str:
    """SQL: an entry (nine digits of cost, then the audit) one edit on; null stays null."""
    return f"(lpad(CAST(CAST(left({x}, 9) AS INT) + {more} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}')"


_FROM_ANY = ", ".join(_costs(s, "2 + cut", "R") for s in ("s0", "s1", "s3"))
OP12_SQL = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations CROSS JOIN crc),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) u(copy)),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM g),
f AS (SELECT *, right(rtrim(text, {_WS}), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM h),
e AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, last = '' AS blank, last <> '' AND again > 1 AS duplicate, CAST(last <> '' AND again = 1 AND last NOT IN ('.', '!', '?') AS INT) AS cut FROM f),
a AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM d)
  UNION ALL
  SELECT conv_id, i, {_costs("s0", "3", "D")},
    CASE WHEN free AND initial = 's' THEN least({_costs("s1", "3", "D")}, {_costs("s0", "cut", "K")}) ELSE {_costs("s1", "3", "D")} END,
    CASE WHEN free AND initial = 'u' THEN least({_costs("s2", "3", "D")}, {_FROM_ANY}, {", ".join(_costs(s, "cut", "K") for s in ("s0", "s1", "s3"))}) WHEN free THEN least({_costs("s2", "3", "D")}, {_FROM_ANY}) ELSE {_costs("s2", "3", "D")} END,
    CASE WHEN free AND initial = 'a' THEN least({_costs("s3", "3", "D")}, {_costs("s2", "cut", "K")}, {_costs("s2", "2 + cut", "R")}) WHEN free THEN least({_costs("s3", "3", "D")}, {_costs("s2", "2 + cut", "R")}) ELSE {_costs("s3", "3", "D")} END
  FROM (SELECT e.conv_id, e.i, s0, s1, s2, least(s3, {_costs("s2", "2", "I")}) AS s3, initial, cut, NOT blank AND NOT duplicate AS free
    FROM (SELECT conv_id, i, s0, s1, least(s2, {_costs("s0", "2", "I")}, {_costs("s1", "2", "I")}, {_costs("s3", "2", "I")}) AS s2, s3 FROM a) b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated FROM e GROUP BY conv_id),
j AS (SELECT conv_id, count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM e) GROUP BY conv_id),
b AS (SELECT a.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, j.illegal, least(s0, s3, {_costs("s2", "2", "I")}, {_costs(_costs("s0", "2", "I"), "2", "I")}, {_costs(_costs("s1", "2", "I"), "2", "I")}) AS best
  FROM a JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id AND n.n = a.i JOIN j ON j.conv_id IS NOT DISTINCT FROM a.conv_id),
l AS (SELECT conv_id, p, substr(best, CAST(9 + p AS INT), 1) AS letter FROM b, unnest(range(1, len(best) - 8)) u(p)),
q AS (SELECT conv_id, p, letter, sum(CAST(letter <> 'I' AS INT)) OVER w AS i, sum(CAST(letter <> 'D' AS INT)) OVER w AS made FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
t AS (SELECT q.conv_id, p, letter, made, e.role, e.text, max(CAST(made = 1 AND letter = 'K' AND e.initial = 's' AS INT)) OVER (PARTITION BY q.conv_id) AS system FROM q LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id AND e.i = q.i AND letter <> 'I'),
o AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM t WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(best, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id"""
