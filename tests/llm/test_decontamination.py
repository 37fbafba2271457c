"""The BM25 index and its search against plain scoring of every segment and passage."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from riskloom.llm import decontamination as d
from riskloom.llm.queries import decontamination


def made(seed=2, items=60):
    rng = random.Random(seed)
    words = [f"w{i}".encode() for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(items):
        w = rng.choices(words, weights, k=rng.randrange(8, 130))
        cut = rng.randrange(1, len(w))
        rows.append((i, b" ".join(w[:cut]).decode(), b" ".join(w[cut:]).decode()))
    return rows, words, weights


def index_of(rows):
    frequency, n, words = Counter(), 0, 0
    for _, q, a in rows:
        whole = d.terms_of(q) + d.terms_of(a)
        frequency.update(set(whole))
        n += -(-len(whole) // d.SEGMENT)
        words += len(whole)
    return d.build_index(rows, frequency, n, words / n)


def all_scores(index, query):
    """Score of every segment, without pruning."""
    out = np.zeros(len(index.item_of))
    for t in query:
        part = slice(index.starts[t], index.starts[t + 1])
        np.add.at(out, index.segments[part], index.weights[part])
    return out


def test_wand_retrieves_all_at_or_above_the_threshold():
    rows, words, weights = made()
    index, rng = index_of(rows), random.Random(9)
    assert (index.slack <= d.SLACK + 1e-9).all() and not index.essential.all()
    for threshold in (0.1, 0.3, 0.5, 0.8):
        for _ in range(60):
            text = rng.choices(words, weights, k=rng.randrange(1, 90))
            query = np.array(sorted({index.terms[w] for w in text if w in index.terms}), int)
            scores = all_scores(index, query)
            want = {s: x for s, x in enumerate(scores) if x >= threshold - 1e-9}
            got = dict(d.wand(index, query, threshold))
            assert got.keys() == want.keys()
            assert all(abs(got[s] - want[s]) < 1e-9 for s in got)


def test_search_equals_scoring_every_passage():
    rows, words, weights = made()
    index, rng = index_of(rows), random.Random(4)
    for case in range(25):
        text = rng.choices(words, weights, k=rng.randrange(0, 500))
        if case % 2:
            _, q, a = rows[case]
            at = rng.randrange(len(text) + 1)
            text[at:at] = d.terms_of(q) + d.terms_of(a)
        want = {}
        for w in range(max(1, -(-len(text) // d.SEGMENT))):
            part = text[w * d.SEGMENT : w * d.SEGMENT + d.PASSAGE]
            query = sorted({index.terms[x] for x in part if x in index.terms})
            for s, x in enumerate(all_scores(index, query)):
                if x >= d.THRESHOLD - 1e-9:
                    i = int(index.item_of[s])
                    want[i] = max(want.get(i, 0), x)
        got = d.search(index, text)
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_copies_are_found_and_others_left(spark):
    rows, words, weights = made(7, 40)
    rng = random.Random(1)
    filler = lambda n: b" ".join(rng.choices(words, weights, k=n)).decode()
    docs = [(i, filler(rng.randrange(0, 400))) for i in range(100)]
    docs += [(1000 + i, f"{filler(150)} {q.upper()}, {a}! {filler(90)}") for i, q, a in rows]
    docs += [(2000, None), (2001, ""), (2002, "word"), (1000, f"{rows[0][1]} {rows[0][2]}")]
    items = spark.createDataFrame([*rows, (99, None, ""), (98, "  ", None)], "item long, question string, answer string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as matches")
    found = d.contaminated(df, "doc_id", "text", items, "item", question="question", answer="answer").collect()
    pairs = Counter((r["doc_id"], r["item"]) for r in found)
    assert all(pairs[1000 + i, i] == (2 if i == 0 else 1) for i, _, _ in rows)
    assert all(i >= 1000 for i, _ in pairs)
    marked = d.with_matches(df, "text", items, "item", question="question", answer="answer")
    assert marked.count() == len(docs) and set(marked.columns) == set(df.columns)
    none = d.with_matches(df, "text", items.filter("false"), "item", question="question", answer="answer")
    assert none.filter("size(matches) > 0").count() == 0
    assert d.contaminated(df.filter("false"), "doc_id", "text", items, "item", question="question", answer="answer").count() == 0


def test_several_indexes_find_what_one_does(spark, monkeypatch):
    rows, _, _ = made(5, 30)
    docs = spark.createDataFrame([(i, f"{q} {a}") for i, q, a in rows], "doc_id long, text string")
    items = spark.createDataFrame(rows, "item long, question string, answer string")
    find = lambda: {(r["doc_id"], r["item"]) for r in d.contaminated(docs, "doc_id", "text", items, "item", question="question", answer="answer").collect()}
    one = find()
    monkeypatch.setattr(d, "INDEX_BYTES", 2000)
    assert find() == one and len(one) >= 30


def test_query_finds_each_copied_item(spark):
    folder = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in decontamination(spark, folder).collect()}
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    flat = {i["item_id"]: " ".join(i["text"].split()) for i in items}
    want = {(x["doc_id"], i) for x in docs for t in [" ".join(x["text"].split())] for i, w in flat.items() if w in t}
    assert want <= got
    # Whatever else is reported shares most of an item's word n-grams.
    assert len(got - want) <= 0.1 * len(want)


def test_items_given_as_one_text():
    assert d.split_item("Who? Nobody.") == ("Who?", "Nobody.")
    assert d.split_item("One sentence") == ("One sentence", "")
    assert d.split_item(None) == ("", "")
