"""Repair of conversations to the least cost, by Hirschberg's divide and conquer over four states.

A conversation is to read, by the initials of its roles, ``(s?(ua)+)?``. The automaton of that has four states: nothing
yet, after a system turn, after a user's, after an assistant's. Each row is kept, given another role or deleted, and
turns may be inserted before it or at the end; the letters of these edits (K, R, D, I) in order are the *audit*. Of the
cheapest repairs the one with the ASCII-least audit is meant.

**Divide and conquer.** A pass from the front gives for each state the least cost of reaching it after the first half of
the rows, and the order of the least audits that do; a pass from the back the least costs of going on from it. The
states of least sum are the optimal crossings. Two audits that have consumed the same rows never start one another, as
both end with a row's own edit, so the crossing with the least audit so far is on the least audit of all. Both halves
are solved the same way; nothing but vectors of four numbers is held beside the result.

**Long conversations** are cut: rows in order go to pieces of at most ``PIECE_ROWS`` rows (or ``PIECE_BYTES``), wherever a
task's range ends or a piece is full. A piece is summed up by its least costs from each state to each, and the order of
the audits; from these the states at all borders follow as above, and then each piece is solved by itself. So no
conversation, however long, is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.common import crc32_sql
from riskloom.operators.joining import lookup_join, shuffle_join
from riskloom.sources import freeze

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text of a piece.
PIECE_ROWS, PIECE_BYTES = 4096, 8 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a turn of a role; the others cannot follow.
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only turn of user or assistant that can follow a state.
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_BLANK = " \t\n\v\f\r"
NORMAL, CUT, GONE = range(3)


def _inserted(state: int, count: int) -> int:
    for _ in range(count):
        state = _AFTER[state, _NEXT[state]]
    return state


#: Costs of the inserts that end a conversation after each state.
TAIL = [min(k * INSERT for k in range(3) if _inserted(s, k) in (START, ASSISTANT)) for s in range(4)]


def _steps(initial: str, fault: int) -> list[list[tuple[int, str]]]:
    """For a row, from each state to each: the least cost and of such edits the ASCII-least."""
    table = [[(_FAR, "")] * 4 for _ in range(4)]
    for start, count in product(range(4), range(3)):
        at, cost = _inserted(start, count), count * INSERT
        ways = [(DELETE, "D", at)]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            ways.append((REROLE + more, "R", _AFTER[at, _NEXT[at]]))
            if (at, initial) in _AFTER:
                ways.append((more, "K", _AFTER[at, initial]))
        for price, letter, to in ways:
            table[start][to] = min(table[start][to], (cost + price, "I" * count + letter))
    return table


#: By code of a row: three times the place of its initial in "sua" (else 3), and its fault.
STEPS = [_steps(initial, fault) for initial in ("s", "u", "a", "") for fault in (NORMAL, CUT, GONE)]


def code_of(role: str, fault: int) -> int:
    return 3 * ({"s": 0, "u": 1, "a": 2}.get(role[:1], 3)) + fault


Vector = tuple[list[int], list[int]]  # costs, and places of the least audits among the four


def _onward(vector: Vector, step) -> Vector:
    """The vector after a step: ``step[s][t]`` is (cost, anything that orders what leads from s to different t)."""
    cost, place = vector
    reached, keys = [_FAR] * 4, [(9, "")] * 4
    for t in range(4):
        best = None
        for s in range(4):
            price, way = step[s][t]
            if cost[s] < _FAR and price < _FAR:
                found = (cost[s] + price, place[s], way)
                if best is None or found < best:
                    best = found
        if best is not None:
            reached[t], keys[t] = best[0], best[1:]
    order = sorted((t for t in range(4) if reached[t] < _FAR), key=lambda t: keys[t])
    return reached, [order.index(t) if t in order else 9 for t in range(4)]


def _at(state: int) -> Vector:
    return [0 if s == state else _FAR for s in range(4)], [0 if s == state else 9 for s in range(4)]


def _backward(codes: bytes, low: int, high: int, cost: list[int]) -> list[int]:
    for i in range(high - 1, low - 1, -1):
        step = STEPS[codes[i]]
        cost = [min(min(step[s][t][0] + cost[t], _FAR) for t in range(4)) for s in range(4)]
    return cost


def _crossing(vector: Vector, onward: list[int]) -> int:
    return min(range(4), key=lambda s: (vector[0][s] + onward[s], vector[1][s]))


def _solve(codes: bytes, low: int, high: int, start: int, end: int, out: list[str]) -> None:
    if high - low == 1:
        out.append(STEPS[codes[low]][start][end][1])
        return
    middle = (low + high) // 2
    vector = _at(start)
    for i in range(low, middle):
        vector = _onward(vector, STEPS[codes[i]])
    state = _crossing(vector, _backward(codes, middle, high, [0 if t == end else _FAR for t in range(4)]))
    _solve(codes, low, middle, start, state, out)
    _solve(codes, middle, high, state, end, out)


def solve(codes: bytes, start: int, end: int) -> str:
    """The ASCII-least of the cheapest audits that consume the rows from ``start`` to ``end``."""
    out: list[str] = []
    if codes:
        _solve(codes, 0, len(codes), start, end, out)
    return "".join(out)


def summary(codes: bytes) -> list[list[tuple[int, int]]]:
    """From each state to each: least cost, and the place of its audit among those from the same state."""
    out = []
    for start in range(4):
        vector = _at(start)
        for c in codes:
            vector = _onward(vector, STEPS[c])
        out.append(list(zip(*vector)))
    return out


def borders(summaries: list) -> tuple[list[int], int]:
    """The states before the first piece, between pieces and after the last, and the cost of all with the tail."""
    vectors = [_at(START)]
    for s in summaries:
        vectors.append(_onward(vectors[-1], s))
    onward, states = TAIL, []
    for vector, s in zip(reversed(vectors), [*reversed(summaries), None]):
        states.append(_crossing(vector, onward))
        if s is not None:
            onward = [min(min(s[a][b][0] + onward[b], _FAR) for b in range(4)) for a in range(4)]
    return states[::-1], min(c + t for c, t in zip(vectors[-1][0], TAIL))


def audit_of(codes: bytes) -> tuple[str, int]:
    """Audit and cost of a whole conversation."""
    return _audit_of_few(codes) if len(codes) <= 32 else _audit_of(codes)


def _audit_of(codes: bytes) -> tuple[str, int]:
    (start, end), cost = borders([summary(codes)])
    return solve(codes, start, end) + "I" * (TAIL[end] // INSERT), cost


#: Short conversations look alike: there are few codes.
_audit_of_few = lru_cache(maxsize=1 << 14)(_audit_of)


def repaired(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[tuple[str, str]]:
    """The turns that the edits leave of the rows, from ``state`` on."""
    out, row = [], 0
    for letter in audit:
        if letter in "IR":
            state = _AFTER[state, _NEXT[state]]
            out.append((_NAMES[state], "" if letter == "I" else texts[row]))
        elif letter == "K":
            state = _AFTER[state, roles[row][:1]]
            out.append((roles[row], texts[row]))
        row += letter != "I"
    return out


class _Piece:
    """Rows in order, as far as they have come."""

    def __init__(self, key):
        self.key, self.codes, self.roles, self.texts = key, bytearray(), [], []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns: set[int] = set()
        self.illegal = self.size = 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        body = text.strip(_BLANK)
        fault = "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.codes.append(code_of(role, NORMAL if not fault else CUT if fault == "truncated" else GONE))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)
        if turn is not None:
            self.turns.add(turn)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    """Whole conversations of rows that come in order: conv, turn, role, text, absent."""
    piece, seen = None, set()
    for batch in batches:
        for conv, turn, role, text, absent in zip(*(c.to_pylist() for c in batch.columns)):
            if piece is None or piece.key != conv:
                if piece is not None:
                    yield piece
                piece, seen = _Piece(conv), set()
            if not absent:
                same = role, text
                piece.add(turn, role, text, same in seen)
                seen.add(same)
    if piece is not None:
        yield piece


_TURNS = "turns array<struct<role:string,text:string>>"
_FOUND = f"gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {_TURNS}"
_RESULT = f"piece long, pieces long, {_FOUND}"


def _sent(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size, as batches of bounded size."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += 100 + weight
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _turns(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _repair_short(rows: DataFrame, conv: T.DataType) -> DataFrame:
    """Conversations that are a piece each: shuffled once, in order within tasks, one in memory at a time."""
    whole = f"conv {conv.simpleString()}, {_FOUND}"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], whole).schema)

    def run(batches):
        def results():
            for p in _conversations(batches):
                audit, cost = audit_of(bytes(p.codes))
                gaps = max(p.turns) - min(p.turns) + 1 - len(p.turns) if p.turns else 0
                turns = _turns(repaired(audit, p.roles, p.texts))
                yield p.size, (p.key, gaps, *p.faults.values(), p.illegal, cost, audit, turns)

        return _sent(results(), arrow)

    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    found = dealt.select("conv", "turn", "role", "text", "absent").mapInArrow(run, whole)
    # Numbers that the optimizer knows, so that nobody looks for further pieces here.
    number = lambda n, name: F.lit(n).cast("long").alias(name)
    return found.select("conv", number(0, "piece"), number(1, "pieces"), *found.columns[1:])


def _repair_long(rows: DataFrame, conv: T.DataType, piece_rows: int, piece_bytes: int) -> DataFrame:
    """Conversations cut into pieces; see the module's text. ``rows`` are frozen and have a unique ``uid``."""
    spark, kind = rows.sparkSession, conv.simpleString()
    named = rows.withColumn("digest", F.sha2("text", 256))
    same = ["conv", "role", "digest"]
    firsts = named.groupBy(*same).agg(F.min(F.struct("turn", "uid")).alias("first"))
    marked = shuffle_join(named, firsts, same).withColumn("seen", F.col("uid") != F.col("first.uid"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("s")).first()
    parts = max(1, -(-total["n"] // piece_rows), -(-(total["s"] or 0) // piece_bytes))
    order = ["conv", "turn", "role", "text", "uid"]
    dealt = marked.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id().cast("long"))
    dealt = dealt.sortWithinPartitions(*order).select("part", "conv", "turn", "role", "text", "seen")
    cut = (
        f"conv {kind}, part long, seq long, codes binary, cost array<long>, place array<long>, blank long, duplicate long, "
        f"truncated long, illegal long, {_TURNS}"
    )
    cut_arrow = to_arrow_schema(spark.createDataFrame([], cut).schema)

    def to_pieces(batches):
        def pieces():
            piece = None
            for batch in batches:
                for part, key, turn, role, text, seen in zip(*(c.to_pylist() for c in batch.columns)):
                    if piece and (piece.key[0] != key or len(piece.codes) >= piece_rows or piece.size >= piece_bytes):
                        yield piece
                        piece = _Piece((key, part, piece.key[2] + 1))
                    piece = piece or _Piece((key, part, 0))
                    piece.add(turn, role, text, seen)
            if piece:
                yield piece

        def results():
            for p in pieces():
                table = [pair for line in summary(bytes(p.codes)) for pair in line]
                cost, place = zip(*table)
                yield p.size, (*p.key, bytes(p.codes), cost, place, *p.faults.values(), p.illegal, _turns(zip(p.roles, p.texts)))

        return _sent(results(), cut_arrow)

    pieces = freeze(dealt.mapInArrow(to_pieces, cut))
    joined = "part long, seq long, start long, end long, piece long, pieces long, more_illegal long"
    join_arrow = to_arrow_schema(spark.createDataFrame([], joined).schema)

    def join(table: pa.Table) -> pa.Table:
        rows_ = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        tables = [np.stack([r["cost"], r["place"]], axis=1).reshape(4, 4, 2).tolist() for r in rows_]
        states, _ = borders([[[tuple(x) for x in line] for line in t] for t in tables])
        out = []
        for i, r in enumerate(rows_):
            meets = i and rows_[i - 1]["last"] + r["first"] not in ("su", "ua", "au")
            out.append((r["part"], r["seq"], states[i], states[i + 1], i, len(rows_), int(bool(meets))))
        return pa.Table.from_batches([_batch(out, join_arrow)])

    initial = lambda i: F.substring(F.element_at("turns", i)["role"], 1, 1)
    ends = pieces.select("conv", "part", "seq", "cost", "place", initial(1).alias("first"), initial(-1).alias("last"))
    placed = freeze(ends.groupBy("conv").applyInArrow(join, joined))
    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    met = pieces.join(placed, ["part", "seq"]).join(gaps, pieces["conv"].eqNullSafe(gaps["conv"])).drop(gaps["conv"])
    met = met.withColumn("gaps", F.when(F.col("piece") == 0, F.coalesce("gaps", F.lit(0))).otherwise(0))
    met = met.withColumn("illegal", F.col("illegal") + F.col("more_illegal"))
    whole = f"conv {kind}, {_RESULT}"
    arrow = to_arrow_schema(spark.createDataFrame([], whole).schema)
    kept = ["conv", "piece", "pieces", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def solved(batches):
        def results():
            for batch in batches:
                for r in batch.to_pylist():
                    audit = solve(bytes(r["codes"]), r["start"], r["end"])
                    if r["piece"] == r["pieces"] - 1:
                        audit += "I" * (TAIL[r["end"]] // INSERT)
                    roles, texts = [t["role"] for t in r["turns"]], [t["text"] for t in r["turns"]]
                    turns = _turns(repaired(audit, roles, texts, r["start"]))
                    cost = cost_of(audit, bytes(r["codes"]))
                    yield sum(map(len, texts)), (*(r[k] for k in kept), cost, audit, turns)

        return _sent(results(), arrow)

    return met.select(*kept, "codes", "start", "end", "turns").mapInArrow(solved, whole)


def cost_of(audit: str, codes: bytes) -> int:
    """What the edits of the rows cost."""
    cost = row = 0
    for letter in audit:
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
        if letter != "I":
            cost += TRUNCATED * (letter != "D" and codes[row] % 3 == CUT)
            row += 1
    return cost


def repair_conversations(
    df: DataFrame, conv: str, turn: str, role: str, text: str, absent: str | None = None,
    piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """The repaired conversations, a row for each *piece*: ``conv`` (the conversation's id), ``piece`` and ``pieces`` (its
    number from 0, and how many), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    and ``turns``, an array of (role, text). Counts and costs of the pieces add up; audits and turns follow each other.
    A conversation of at most ``piece_rows`` rows and ``piece_bytes`` is one piece.

    Rows are taken by turn, nulls first, rows of one turn by role and text. The first fault of a row counts: blank
    (nothing but ASCII white space), duplicate (role and text came before), truncated (the last sign is none of
    ``.!?``). ``gaps``: turns missing between the least and the greatest; ``illegal``: neighbouring rows whose roles
    do not follow each other. A null role or text is one space; rows of a null id are one conversation. Rows for
    which the column ``absent`` is true are not there, but their conversation is: without any row left it has
    zeros, an empty audit and no turns. Repeated rows are duplicates. No rows in, no rows out."""
    value = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), value(role).alias("role"),
        value(text).alias("text"), (F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)).alias("absent"),
    )
    size = F.octet_length("text") + F.octet_length("role")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    long = freeze(sizes.filter((F.col("n") > piece_rows) | (F.col("s") > piece_bytes)).select("conv", F.lit(True).alias("long")))
    kind = rows.schema["conv"].dataType
    if long.isEmpty():
        return _repair_short(rows, kind)
    split = lookup_join(rows, long, ["conv"])
    short = _repair_short(split.filter("long is null").drop("long"), kind)
    present = freeze(split.filter("long and not absent").drop("long", "absent").withColumn("uid", F.monotonically_increasing_id()))
    # A long conversation whose rows are all absent is a short one of no rows.
    emptied = long.join(present.select(F.col("conv").alias("c")).distinct(), F.col("conv").eqNullSafe(F.col("c")), "left_anti")
    none = emptied.select("conv", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"))], F.lit(True).alias("absent"))
    out = short.unionByName(_repair_long(present, kind, piece_rows, piece_bytes))
    return out.unionByName(_repair_short(none, kind))


def digest_conversations(pieces: DataFrame) -> DataFrame:
    """One row per conversation: the sums of its pieces, the whole audit, and ``repaired_sha256``, the hash of its turns
    as ``role:text`` joined by line feeds. A hash is made front to back; that of a conversation of several pieces
    takes them in order, one in memory at a time."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = pieces.filter("pieces = 1").select("conv", *names, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"
    arrow = to_arrow_schema(pieces.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        def results():
            key, sums, audit, state, filled = None, None, [], None, False
            for batch in batches:
                for r in batch.to_pylist():
                    if r["piece"] == 0:
                        if sums:
                            yield 0, (key, *sums, "".join(audit), state.hexdigest())
                        key, sums, audit, state, filled = r["conv"], [0] * len(names), [], hashlib.sha256(), False
                    sums = [a + r[n] for a, n in zip(sums, names)]
                    audit.append(r["audit"])
                    if r["turns"]:
                        state.update(("\n" * filled + r["lines"]).encode("utf-8", "surrogatepass"))
                        filled = True
            if sums:
                yield 0, (key, *sums, "".join(audit), state.hexdigest())

        return _sent(results(), arrow)

    several = pieces.filter("pieces > 1").select("conv", "piece", *names, "audit", F.size("turns").alias("turns"), lines.alias("lines"))
    dealt = several.repartition("conv").sortWithinPartitions("conv", "piece")
    return one.unionByName(dealt.mapInArrow(run, schema))


def damage(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``absent``: conversations with faults put in by the crc32 of
    ``conv_id:turn`` modulo 20. 0: absent; 1: no text; 2: without ``.!?``; 3: twice; 4: by the user. Nulls are one space."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn"))) % 20
    text = F.when(number == 1, "").when(number == 2, F.translate(value("text"), ".!?", "")).otherwise(value("text"))
    role = F.when(number == 4, "user").otherwise(value("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(number == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (number == 0).alias("absent"), times.alias("time")).drop("time")


def oracle() -> str:
    """The thin query in DuckDB SQL: all paths row by row, the cheapest and ASCII-least kept for each state."""
    steps = ", ".join(
        f"({code}, {s}, {t}, {cost}, '{word}')"
        for code, table in enumerate(STEPS)
        for s, line in enumerate(table)
        for t, (cost, word) in enumerate(line)
        if cost < _FAR
    )
    white = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    after = " ".join(f"WHEN {s} THEN '{'user' if _NEXT[s] == 'u' else 'assistant'}:'" for s in range(4))
    twice = " ".join(f"WHEN {s} THEN '{_NAMES[_inserted(s, 2)]}:'" for s in range(4))
    thrice = " ".join(f"WHEN {s} THEN '{_NAMES[_inserted(s, 3)]}:'" for s in range(4))
    tails = ", ".join(f"({s}, {cost}, '{'I' * (cost // INSERT)}')" for s, cost in enumerate(TAIL))
    return f"""
WITH RECURSIVE
steps(code, s, t, price, word) AS (VALUES {steps}),
tails(s, price, word) AS (VALUES {tails}),
numbered AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM numbered, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    trim(text, {white}) AS body FROM placed),
coded AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN again THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial FROM seen),
turned AS (
  SELECT *, 3 * initial + CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS code FROM coded),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {START} AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines
  FROM (SELECT DISTINCT conv_id FROM turned)
  UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit, best.lines FROM (
    SELECT p.conv_id, r.i, x.t AS s, min({{'cost': p.cost + x.price, 'audit': p.audit || x.word, 'lines':
      list_concat(list_concat(p.lines, [CASE p.s {after} END, CASE p.s {twice} END][:length(x.word) - 1]),
      CASE right(x.word, 1) WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
      ELSE [CASE length(x.word) WHEN 1 THEN CASE p.s {after} END WHEN 2 THEN CASE p.s {twice} END ELSE CASE p.s {thrice} END END || r.text] END)}}) AS best
    FROM paths p JOIN turned r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN steps x ON x.s = p.s AND x.code = r.code
    GROUP BY p.conv_id, r.i, x.t)),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank,
    count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM turned GROUP BY conv_id),
ends AS (
  SELECT c.conv_id, min({{'cost': p.cost + t.price, 'audit': p.audit || t.word,
    'lines': list_concat(p.lines, [CASE p.s {after} END, CASE p.s {twice} END][:length(t.word)])}}) AS best
  FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN tails t ON t.s = p.s GROUP BY c.conv_id)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""
