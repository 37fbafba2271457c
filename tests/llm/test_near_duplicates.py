"""Near-duplicates and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from riskloom.llm.connected import components
from riskloom.llm.near_duplicates import (
    BANDS,
    ROWS,
    drop_near_duplicates,
    near_duplicates,
    shingle_set,
    signature,
)
from riskloom.llm.queries import near_dedup


def shingles(text, size):
    w = tuple((text or "").encode().lower().split())
    return {w[i : i + size] for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(nodes, edges):
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            least[n] = n = least[least[n]]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, size))
    ids, edges = sorted(sets), []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            for p in sets[a]:
                for q in sets[b]:
                    if p and q and 100 * len(p & q) >= percent * len(p | q):
                        edges.append((a, b))
    return classes(ids, edges)


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng, rows, i = random.Random(3), [], 0
    for size in (4, 12, 60, 200):
        for _ in range(5):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for changes in (0, 0, 1, 2, size // 30, size // 15, size // 8):
                rows.append((i, edited(base, rng, changes)))
                i += 7
    # A chain: each next to the one before, the ends far apart.
    chain = [f"c{k}" for k in range(120)]
    for step in range(12):
        rows.append((i, " ".join(chain[: 4 * step] and [f"x{k}" for k in range(4 * step)] + chain[4 * step :] or chain)))
        i += 1
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \t\n"), (i + 4, "One"), (i + 5, "one"), (i + 6, "one two")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_classes_equal_brute_force(spark, size):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, rep int, key int")
    got = near_duplicates(df, "doc_id", "text", words=size).collect()
    want = brute(rows, size)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    texts = dict(rows)
    for r in got:
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]], size))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark, folder).collect()}
    assert got == brute([tuple(d) for d in docs], 2)


def test_large_groups_of_exact_and_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(base)) for i in range(500)]
    rows += [(500 + i, edited(base, rng, 3)) for i in range(500)]
    rows += [(2000 + i, edited([f"o{i}w{k}" for k in range(80)], rng, 1)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, "doc_id", "text").collect()}
    assert got == brute_star(rows)


def brute_star(rows):
    """All copies are near the base text, the others near nothing."""
    return {i: 0 if i < 2000 else i for i, _ in rows}


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (5, text), (None, text), (None, None), (9, text + " more"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, False), (0, 0, False), (5, 5, True), (5, 5, True), (7, 7, True), (7, 7, True), (9, 5, False),
    ]
    left = drop_near_duplicates(df, "doc_id", "text").collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 0, 5, 7]
    assert near_duplicates(df.filter("false"), "doc_id", "text").count() == 0
    assert drop_near_duplicates(df.filter("false"), "doc_id", "text").count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, mine, yours = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = (np.unique(np.concatenate([common, own])) for own in (mine, yours))
    x, y = signature(a), signature(b)
    assert x.shape == (BANDS * ROWS,)
    assert abs((x == y).mean() - 0.8) < 0.1
    assert (signature(a) == signature(np.concatenate([common, mine]))).all()
    assert len(shingle_set("a b", 5)) == 1 and len(shingle_set("", 5)) == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7)] + [(3, 900)] * 3
    got = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in got.collect()}
    assert got == {n: c for n, c in classes({x for e in edges for x in e}, edges).items() if n != 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_family_short_of_its_pivot_collapses_in_few_comparisons(spark, monkeypatch):
    """Mutually near texts, all short of the least id: comparisons stay in proportion to their number."""
    from riskloom.llm import near_duplicates as module

    draw = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    family = base[:262] + [f"v{i}" for i in range(38)]  # 261 of 337 shingles shared with the first
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        text = list(family)
        text[draw.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(text)))
    tried = []
    plain = module._compared

    def counted(pairs, *a, **k):
        tried.append(pairs.count())
        return plain(pairs, *a, **k)

    monkeypatch.setattr(module, "_compared", counted)
    found = near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", words=2).collect()
    got = {r["id"]: r["component_id"] for r in found}
    assert set(got.values()) <= {0, 1}
    assert len({got[i] for i in range(1, 400)}) == 1
    assert sum(tried) <= 4 * len(rows)


def test_the_least_text_of_a_repeated_id_stays(spark):
    rows = [(1, "b c d e f g"), (1, "a c d e f g"), (2, "z y x w v u"), (None, "q"), (None, "q")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    kept = sorted(map(tuple, drop_near_duplicates(df, "id", "text").collect()), key=str)
    assert kept == [(1, "a c d e f g"), (2, "z y x w v u"), (None, "q"), (None, "q")]


def test_stars_take_two_rounds(spark, monkeypatch):
    from riskloom.llm import connected

    frozen = []
    monkeypatch.setattr(connected, "freeze", lambda df, kept=connected.freeze: (frozen.append(1), kept(df))[1])
    # Stars around least nodes, a leaf of each with the first star's node as well: what pivots of buckets give.
    edges = [(100 * k, 100 * k + i) for k in range(8) for i in range(1, 100)] + [(0, 100 * k + 1) for k in range(1, 8)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(n, 0) for n in range(800)}
    # The edges, two tables a round, and three at the end.
    assert len(frozen) <= 1 + 2 * 2 + 3
    frozen.clear()
    star = components(spark.createDataFrame([(0, i) for i in range(1, 500)], "a long, b long"))
    assert star.filter("component = 0").count() == 500 and len(frozen) == 1 + 2 + 3
