"""Spelling variants against all pairs, plain Python and SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskloom.llm import spelling as S
from riskloom.llm.queries import spelling_groups


def apart(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    total = Counter()
    for i, t in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and apart(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def of(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(plain_counts(docs))
    assert len(want) > 500 and any(f for f, *_ in want.values())
    assert of(spelling_groups(spark, folder)) == want


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rows = duck.execute(S.oracle()).fetchall()
    names = [d[0] for d in duck.description]
    want = {r[0]: tuple(r[1:]) for r in rows}
    assert names == ["word", "form", "root", "n", "n_near", "form_n"] and len(want) == len(rows)
    assert of(spelling_groups(spark, folder)) == want


def vocabulary(rng, letters, size):
    """Words that are often near each other, anagrams among them."""
    words = set()
    while len(words) < size:
        base = [rng.choice(letters) for _ in range(rng.choice([6, 7, 9]))]
        for _ in range(6):
            word, kind = list(base), rng.randrange(4)
            at = rng.randrange(len(word))
            if kind == 0:
                word.insert(at, rng.choice(letters))
            elif kind == 1:
                word[at] = rng.choice(letters)
            elif kind == 2 and len(word) > 6:
                del word[at]
            else:
                rng.shuffle(word)
            words.add("".join(word))
    return {w: rng.choice([5, 6, 25, 30, 125, 130, 4000]) for w in sorted(words)}


@pytest.mark.parametrize("letters, cell", [("ab", 40), ("abcdeé", 100), ("abcdefghijklmnopqrstuvwxyzàéÿ×", 8192), ("abcß中🜁", 64)])
def test_groups_equal_all_pairs(spark, letters, cell):
    counts = vocabulary(random.Random(len(letters)), letters, 100 if letters == "ab" else 900)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("near", S.F.lit(1))
    got = of(S.spelling_variants(df, cell_words=cell, sample=200))
    assert got == brute(counts)


def test_reach_prunes_and_misses_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (2000, 12)).astype(np.uint8)
    tree = S.grow(x, np.arange(len(x)), 16)
    visited = 0
    found = set()
    for points, rows in S.reach(tree, x, 1, 1):
        assert len(points) <= 16
        visited += len(points) * len(rows)
        up = np.maximum(x[points][None].astype(int) - x[rows][:, None], 0).sum(axis=2)
        down = np.maximum(x[rows][:, None].astype(int) - x[points][None], 0).sum(axis=2)
        found |= {(int(rows[a]), int(points[b])) for a, b in zip(*np.nonzero((up <= 1) & (down <= 1)))}
    diff = x[:, None].astype(np.int16) - x[None]
    up, down = np.maximum(diff, 0).sum(axis=2), np.maximum(-diff, 0).sum(axis=2)
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero((up <= 1) & (down <= 1)))}
    assert visited < 0.25 * len(x) ** 2


def test_long_chains_of_forms(spark):
    words = ["a" * (6 + k) for k in range(9)]
    counts = {w: 5 * 5**k for k, w in enumerate(words)}
    got = of(S.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and got[words[0]][1] == words[-1]


def test_counts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "Straßen straßen STRASSEN ÀÉÎÕÜÿ"), (3, "x" * 30_000 + " kurz 日本語 abćdefghij"), (3, "abcdef " * 9), (4, "Abcdef1abcdeF_àbcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", S.F.lit("w")).withColumn("n", S.F.lit(2))
    got = {r["word"]: r["n"] for r in S.word_counts(df, "doc_id", "text", least_count=1).collect()}
    total = Counter()
    for i, t in rows:
        for w, n in plain_counts([(i, t)] * 5).items():
            total[w] += n // 5
    assert got == dict(total)
    none = S.word_counts(df.filter("false"), "doc_id", "text")
    assert S.spelling_variants(none).count() == 0


def test_what_a_damaged_run_leaves_is_not_damaged_again(spark):
    # Of document 118 both runs lose a letter, and the first one becomes the second.
    longer, shorter = "o" * 13, "o" * 12
    assert all(zlib.crc32(f"118:{run}".encode()) % 199 == 0 for run in (longer, shorter))
    rows = [(118, f"{longer} {shorter} " * 5), (118, f"{shorter} {longer} " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in S.word_counts(df, "doc_id", "text").collect()}
    assert got == plain_counts(rows) == {"o" * 12: 10, "o" * 11: 10}
