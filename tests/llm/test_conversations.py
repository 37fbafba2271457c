"""Repair of conversations against all edits, against SQL, and in pieces."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import pytest

from riskloom.llm import conversations as C
from riskloom.llm.queries import conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
INITIALS = ["s", "u", "a", "t"]


def tried(codes, longest=None):
    """(cost, audit) by trying every audit of bounded length whose turns the grammar accepts."""
    best = (10**9, "")
    for inserts in range(len(codes) + 3):
        for audit in product("DIKR", repeat=len(codes) + inserts):
            if audit.count("I") != inserts:
                continue
            # Rerole may give either role; only one can be right at its place.
            for roles in product("ua", repeat=sum(x in "IR" for x in audit)):
                given, row, cost, turns, ok = iter(roles), 0, 0, "", True
                for x in audit:
                    if x in "IR":
                        turns += next(given)
                    cost += {"K": 0, "R": 3, "D": 4, "I": 3}[x]
                    if x != "I":
                        initial, fault = INITIALS[codes[row] // 3], codes[row] % 3
                        ok &= x == "D" or fault != C.GONE
                        cost += 3 * (fault == C.CUT and x != "D")
                        if x == "K":
                            turns += initial
                        row += 1
                if ok and GRAMMAR.fullmatch(turns):
                    best = min(best, (cost, "".join(audit)))
    return best


def forward(codes):
    """(cost, audit) by keeping the least audit of each state whole."""
    at = {C.START: (0, "")}
    for c in codes:
        found = defaultdict(list)
        for s, (cost, audit) in at.items():
            for t, (price, word) in enumerate(C.STEPS[c][s]):
                if price < C._FAR:
                    found[t].append((cost + price, audit + word))
        at = {t: min(f) for t, f in found.items()}
    return min((cost + C.TAIL[s], audit + "I" * (C.TAIL[s] // 3)) for s, (cost, audit) in at.items())


def test_every_edit_of_short_conversations():
    for n in range(3):
        for codes in product(range(12), repeat=n):
            assert C.audit_of(bytes(codes))[::-1] == tried(codes), codes


def test_audits_of_long_conversations():
    rng = random.Random(2)
    for _ in range(400):
        codes = bytes(rng.choice(rng.choice([range(12), (3, 6), (0, 3), (5, 8, 11)])) for _ in range(rng.randrange(40)))
        assert C._audit_of(codes)[::-1] == forward(codes)
    codes = bytes(rng.randrange(12) for _ in range(3000))
    assert C.audit_of(codes)[::-1] == forward(codes)


def test_pieces_make_the_same_audit():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 60)))
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(4))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        states, cost = C.borders([C.summary(p) for p in parts])
        audit = "".join(C.solve(p, a, b) for p, a, b in zip(parts, states, states[1:])) + "I" * (C.TAIL[states[-1]] // 3)
        assert (cost, audit) == forward(codes) and C.cost_of(audit, codes) == cost


def plain(rows):
    """The query over (conv_id, turn, role, text) in plain Python."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        groups[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, got in groups.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in got:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append(3 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + (0 if not fault else 1 if fault == "truncated" else 2))
        turns = {t for t, _, _ in got if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit = forward(codes)
        lines, row, want = [], 0, "u"
        for x in audit:
            if x in "IR":
                lines.append(("user:" if want == "u" else "assistant:") + (got[row][2] if x == "R" else ""))
            elif x == "K":
                lines.append(f"{got[row][1]}:{got[row][2]}")
            if x != "D":
                want = "a" if lines[-1][0] == "u" else "u"
            row += x != "I"
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def of(df, key="conv_id"):
    rows = df.collect()
    found = {r[key]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_plain_python_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    assert of(conversation_repair(spark, folder)) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = duck.execute(C.oracle()).df()
    assert sorted(got.columns) == sorted(["conv_id", *COLUMNS])
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for _, r in got.iterrows()} == want


def odd_rows():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "Well?", "cut", "", " \t", None, "Yes.", "é.", "a\nb."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "useless", "user", "assistant"]
    rows = [(c, rng.choice([None, *range(12), -3, 40]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randrange(1, 14))]
    rows += [(None, t, "user", "x.") for t in range(4)] + [(10**6, 0, "user", "a.")] * 5
    # One conversation holds most rows, many of them equal.
    rows += [(777, t // 3, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", "same.", "cut"])) for t in range(900)]
    return rows


@pytest.mark.parametrize("piece_rows", [4096, 60, 7])
def test_odd_rows_in_pieces(spark, piece_rows):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = C.damage(df).withColumnRenamed("conv_id", "conv").withColumn("piece", C.F.lit(1))
    pieces = C.repair_conversations(damaged, "conv", "turn", "role", "text", "absent", piece_rows=piece_rows)
    assert of(C.digest_conversations(pieces), "conv") == plain(rows)
    if piece_rows < 900:
        assert pieces.filter("conv = 777").count() > 900 // piece_rows // 2


def test_no_rows_and_absent_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", True)] * 30 + [(2, 0, "user", "a.", None)], "c long, t int, r string, x string, gone boolean")
    got = of(C.digest_conversations(C.repair_conversations(df, "c", "t", "r", "x", "gone", piece_rows=8)), "conv")
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[2][5:7] == (3, "KI")
    assert C.repair_conversations(df.filter("false"), "c", "t", "r", "x").count() == 0
