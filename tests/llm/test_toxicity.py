"""Folding, matching and learning of the weighted lexicon."""

from __future__ import annotations

import random
import re
import time
import zlib

from riskloom.llm import toxicity as tox
from riskloom.llm.queries import TOXIC_FROM, toxicity


def brute(lexicon, text):
    """Weight found, by looking at every place of every entry."""
    flat, total, count = tox.fold(text), 0.0, 0
    places = lambda p: [m.start() for m in re.finditer(f"(?= {re.escape(p)} )", flat)]
    safe = [(at, at + len(p) + 2) for p in map(str.strip, map(tox.fold, lexicon.exceptions)) for at in places(p)]
    for phrase, weight in lexicon.weights.items():
        for at in places(phrase):
            if not any(s <= at and at + len(phrase) + 2 <= e for s, e in safe):
                total, count = total + weight, count + 1
    return total, count


def test_folding():
    assert tox.fold("You 1d10t!! An IDIOT.") == " you idiot an idiot "
    assert tox.fold("іdіоt and mоrоn") == " idiot and moron "
    assert tox.fold("ｔｒａｓｈ") == " trash "
    assert tox.fold("call 555 0134 in 2024") == " call 555 0134 in 2024 "
    assert tox.fold("") == tox.fold(None) == tox.fold("!?") == "  "
    assert tox.fold("réêou ÉTÉ") == " réêou été "


def test_matching_equals_brute_force():
    rng = random.Random(1)
    lexicon = tox.Lexicon({"idiot": 2.0, "trash": 3.0, "you idiot": 1.5, "clown": 1.0})
    words = "you idiot trash can trash bag clown fish clown idiot the a of 1d10t tr4sh".split()
    a = tox._automaton(lexicon.weights, lexicon.exceptions)
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 25)))
        density, weight, count = tox.measure(a, text)
        assert (weight, count) == brute(lexicon, text)
        assert abs(density - 100 * weight / (len(tox.fold(text).split()) + 20)) < 1e-9
    assert tox.measure(a, "take out the trash")[2] == 0 and tox.measure(a, "a trash")[2] == 1


def rows(n=300, seed=2):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    out = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 200))
        bad = i % 4 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["blarg", "Fl0rp", "ZNORT"]))
        out.append((i, " ".join(text), int(bad)))
    return out


def test_learns_unknown_words_and_catches_disguises(spark):
    df = spark.createDataFrame(rows(), "id long, text string, toxic int")
    lexicon = tox.fit_lexicon(df, df, "id", "text", "toxic")
    assert {"blarg", "florp", "znort"} <= lexicon.weights.keys()
    fresh = [(i, t, y) for i, t, y in rows(120, 9)] + [(1000, "bl4rg wa wb and flоrp, ZN0RT wc", 1)]
    got = tox.score_toxicity(spark.createDataFrame(fresh, "id long, text string, y int"), "text", lexicon, ("id", "y"))
    got = got.collect()
    assert all((r["toxicity"] >= TOXIC_FROM) == bool(r["y"]) for r in got)
    assert all(0 <= r["toxicity"] <= 1 for r in got)


def test_fitting_is_repeatable_and_bounded(spark):
    df = spark.createDataFrame(rows(), "id long, text string, toxic int")
    a, b = (tox.fit_lexicon(df.repartition(n), df, "id", "text", "toxic") for n in (1, 7))
    assert a.weights == b.weights and max(abs(x - y) for x, y in zip(a.curve, b.curve)) < 1e-9
    few = tox.fit_lexicon(df, df, "id", "text", "toxic", rows=1)
    assert few.weights.keys() == tox.PRIOR.keys()


def test_nulls_no_rows_and_clashing_columns(spark):
    some = [(None, None, None), (1, None, 1), (2, "", 0), (3, "an idiot", 7), (3, "an idiot", 7)]
    df = spark.createDataFrame(some, "id long, text string, toxicity int")
    lexicon = tox.fit_lexicon(df, df, "id", "text", "toxicity")
    got = tox.score_toxicity(df, "text", lexicon, ("id",)).collect()
    assert len(got) == 5 and len({r["toxicity"] for r in got if not r["toxic_matches"]}) == 1
    none = df.filter("false")
    assert tox.score_toxicity(none, "text", tox.fit_lexicon(none, none, "id", "text", "toxicity"), ("id",)).count() == 0


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in toxicity(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    caught = [got[r["doc_id"]]["predicted"] for r in held if r["toxic"] == 1]
    wrong = [got[r["doc_id"]]["predicted"] for r in held if r["toxic"] == 0]
    assert sum(caught) >= 0.85 * len(caught)
    assert sum(wrong) <= 0.01 * len(wrong)


def test_long_runs_and_many_exceptions_take_linear_time():
    lexicon = tox.Lexicon({"trash": 1.0})
    automaton = tox._automaton(lexicon.weights, lexicon.exceptions)
    for text in ("1" * 10**6, "1" * 500_000 + "!9a", "9!" * 500_000 + "1a", "trash can " * 100_000, "$" * 10**6):
        start = time.perf_counter()
        tox.measure(automaton, text)
        assert time.perf_counter() - start < 5, text[:20]
    assert tox.measure(automaton, "trash can trash " * 50)[2] == 50


def test_disguises_are_undone_once():
    assert tox.fold("1d10t, $tup1d! 2024 a1 B0B 4ever") == " idiot stupid 2024 a1 bob aever "
