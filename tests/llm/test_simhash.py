"""SimHash: fingerprints against plain Python, classes against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from riskloom.llm.connected import components
from riskloom.llm.queries import simhash
from riskloom.llm.simhash import DISTANCE, fingerprint_of, links_between, shingle_hashes, simhash_duplicates, submasks
from tests.llm.test_near_duplicates import classes, edited


def plain_print(text, size=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def all_pairs(prints, distance=DISTANCE):
    """Links between distinct fingerprints by comparing each with each, in blocks."""
    values = np.array(sorted(set(prints)), np.uint64)
    out = []
    for i, v in enumerate(values):
        near = np.bitwise_count(values[i + 1 :] ^ v) <= distance
        out += [(int(v), int(w)) for w in values[i + 1 :][near]]
    return out


def brute(rows):
    """Component of each id; ids are unique and not null."""
    prints = {i: plain_print(t) for i, t in rows}
    of = classes(set(prints.values()), all_pairs(prints.values()))
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(i, least.get(of[p], i))
    return {i: least[of[p]] for i, p in prints.items()}


def signed(values):
    return [v - (1 << 64) if v >> 63 else v for v in values]


@pytest.mark.parametrize("text", [None, "", " \t\r\n", "One", "one two", "Über DEN é\x1c\x1f Berg", "a b c d", "x " * 40_000])
def test_fingerprint(text):
    assert fingerprint_of(shingle_hashes(text)) == plain_print(text)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash(spark, folder).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(docs)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{plain_print(t):016x}" for i, t in docs}
    assert len(got) == len(docs)


def test_near_texts(spark):
    rng, rows = random.Random(8), []
    for base in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 400, 2000]))]
        rows += [(len(rows) + k, edited(words, rng, rng.randrange(6))) for k in range(8)]
    rows += [(9000 + k, t) for k, t in enumerate([None, "", " ", "one", "One", "one two"])]
    got = simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def ball(rng, base, flips, n):
    """``n`` fingerprints, each some of ``flips`` bits from ``base``."""
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.choice(flips))) for _ in range(n)]


@pytest.mark.parametrize("flips", [(1, 2), (4, 6)])
def test_dense_families(spark, flips):
    rng = random.Random(sum(flips))
    bases = [rng.getrandbits(64)]
    # Bases next to each other, so that families nearly touch.
    bases += [bases[0] ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (4, 5, 7, 9)] + [0, (1 << 64) - 1]
    prints = sorted({p for b in bases for p in ball(rng, b, flips, 300)} | set(bases))
    df = spark.createDataFrame([(p,) for p in signed(prints)], "print long")
    links = links_between(df, small=16)
    got = {r["node"] % (1 << 64): r["component"] for r in components(links).collect()}
    want = classes(prints, all_pairs(prints))
    groups = lambda of: sorted(sorted(p for p in prints if of(p) == c) for c in {of(p) for p in prints})
    assert groups(lambda p: got.get(p, p if p < 1 << 63 else p - (1 << 64))) == groups(lambda p: want[p])
    for r in links.limit(2000).collect():
        assert bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= DISTANCE


def test_open_bits_shrink_to_a_bounded_bucket():
    mask = 0
    for _ in range(5):
        mask = max(submasks(mask), key=lambda m: 64 - m.bit_count())
    assert 64 - mask.bit_count() == 4


def test_large_family_makes_no_pairs(spark):
    """Rows met inside buckets stay in proportion to the family."""
    rng = random.Random(4)
    prints = sorted(set(ball(rng, rng.getrandbits(64), (1, 2, 3, 4, 5, 6), 2500)))
    df = spark.createDataFrame([(p,) for p in signed(prints)], "print long")
    links = links_between(df)
    assert links.count() <= 64 * 33 * len(prints)
    got = components(links)
    assert got.count() <= len(prints)
    want = classes(prints, all_pairs(prints))
    assert got.select("component").distinct().count() == len({c for c in want.values() if sum(v == c for v in want.values()) > 1})


def test_null_ids_repeats_no_rows_and_a_clashing_column(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (None, "a b c d", 2), (None, "q r s", 3), (2, "a b c d", 4), (7, None, 5), (None, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print int")
    got = simhash_duplicates(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 2), (0, 7), (2, 2), (5, 2), (5, 2), (7, 7)]
    assert simhash_duplicates(df.filter("false"), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        links_between(df.select("print"), distance=4)
