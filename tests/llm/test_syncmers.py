"""Fingerprints against a plain reading of the definition."""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import functions as F

from riskloom.llm.syncmers import K, S, fingerprint_edits, likeness, with_anchors

WORDS = "of the on in a to thea errant onshore öfter über 𝒳𝒴 naïve thing ounce heed latter".split()


def texts():
    out = [None, "", "a", "short one", "x" * 40, "𝒳y" * 30]
    for n in (8, 25, 60, 200):
        for seed in range(3):
            out.append(" ".join(WORDS[(i * i * (seed + 3) + i // 5) % len(WORDS)] for i in range(n)))
    return [*out, out[-1], out[-4]]


def tokens(text):
    return regex.findall(r"[\p{L}\p{N}]+|\S", text)


def hashes(spark, texts):
    """Hashes of tokens, of s-mers and k-mers of token hashes, and of whole texts."""
    one = lambda values: {v: h for v, h in spark.createDataFrame([(v,) for v in values], "v string").select("v", F.xxhash64("v")).collect()}
    words = one(sorted({w for t in texts for w in tokens(t)}))
    table = {}
    for size in (S, K):
        mers = sorted({tuple(words[w] for w in x[i : i + size]) for t in texts for x in [tokens(t)] for i in range(len(x) - size + 1)})
        columns = [f"c{i}" for i in range(size)]
        df = spark.createDataFrame(mers, ", ".join(f"{c} long" for c in columns))
        table |= {tuple(r)[:size]: r["h"] for r in df.withColumn("h", F.xxhash64(*columns)).collect()}
    return words, table, one(sorted(set(texts)))


def expected(text, known):
    words, table, whole = known
    h = [words[w] for w in tokens(text)]
    out = []
    for i in range(len(h) - K + 1):
        inner = [table[tuple(h[j : j + S])] for j in range(i, i + K - S + 1)]
        if min(inner[0], inner[-1]) <= min(inner):
            out.append((i, table[tuple(h[i : i + K])]))
    return out or ([(-1, whole[text])] if text else [])


def test_anchors_of_texts_and_edited_texts(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = {r["doc_id"]: r for r in got.collect()}
    assert sorted(got) == [i for i, _ in rows]
    edited = {}
    for at, (i, t) in enumerate(rows):
        t, after = t or "", rows[(at + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited[i] = t[: len(t) - q] + after[:q]
    table = hashes(spark, [*(t or "" for _, t in rows), *edited.values()])
    pairs = lambda a: [(m["position"], m["anchor"]) for m in a]
    for at, (i, t) in enumerate(rows):
        r = got[i]
        assert r["n_chars"] == len(t or "") and r["edited"] == edited[i]
        assert pairs(r["anchors"]) == expected(t or "", table)
        assert pairs(r["edited_anchors"]) == expected(edited[i], table)
        after = rows[(at + 1) % len(rows)][1] or ""
        assert pairs(r["next_anchors"]) == expected(after, table)


def test_repeated_and_null_ids_and_clashing_columns(spark):
    rows = [(1, "b" * 30, 1), (1, "b" * 30, 2), (None, "c" * 30, 3), (2, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, anchors int")
    got = fingerprint_edits(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 30), (1, 30), (1, 30), (2, 0)]
    assert fingerprint_edits(df.filter("false"), "doc_id", "text").count() == 0
    one = fingerprint_edits(df.limit(1), "doc_id", "text").first()
    assert one["anchors"] == one["next_anchors"]


def test_likeness_and_query(spark):
    from riskloom.llm.queries import fingerprints

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in fingerprints(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    by_text = {}
    for at, d in enumerate(docs):
        after = docs[(at + 1) % len(docs)]["text"]
        q = len(d["text"]) // 4
        want = (d["text"][: len(d["text"]) - q] + after[:q]).encode()
        assert got[d["doc_id"]]["edited_sha256"] == hashlib.sha256(want).hexdigest()
        by_text.setdefault(d["text"], set()).add(got[d["doc_id"]]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    better = [r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] >= 200]
    assert sum(better) >= 0.95 * len(better)
    e = spark.range(1).select(F.array().cast("array<struct<position:int,anchor:bigint>>").alias("a"))
    assert e.select(likeness(F.col("a"), F.col("a")).alias("x")).first()["x"] == 1.0
    assert with_anchors(spark.createDataFrame([(None,)], "t string"), "t", "a").first()["a"] == []
