"""The n-gram model against a plain one over dictionaries."""

from __future__ import annotations

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import ngrams
from riskloom.llm.ngrams import fit_ngrams, mounted, score_texts, token_hashes, token_scores
from riskloom.llm.queries import lm_scoring
from riskloom.sources.shared import scratch


def tokens(text):
    return [*(text or "").encode().lower().split(), "END"]


def grams(texts, order):
    out = Counter()
    for t in texts:
        w = ["START"] * (order - 1) + tokens(t)
        out.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    return out


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    out = []
    for k, (a, b) in enumerate(zip(n, n[1:]), 1):
        out.append(min(max(k - (k + 1) * y * b / a if a else k * 0.5, 0.05), k - 0.05))
    return [0.0, *out]


class Plain:
    def __init__(self, texts, order):
        self.levels = {order: grams(texts, order)}
        for m in range(order - 1, 0, -1):
            self.levels[m] = Counter(g[1:] for g in self.levels[m + 1])
        self.order, self.words = order, len(self.levels[1])
        self.raw = Counter(w for t in texts for w in tokens(t))
        self.discount = {m: discounts(c.values()) for m, c in self.levels.items()}
        self.of = {m: defaultdict(list) for m in self.levels}
        for m, c in self.levels.items():
            for g, n in c.items():
                self.of[m][g[:-1]].append(n)

    def p(self, gram):
        m = len(gram)
        below = self.p(gram[1:]) if m > 1 else 1 / (self.words + 1)
        counts = self.of[m].get(gram[:-1])
        if not counts:
            return below
        d = self.discount[m]
        n = self.levels[m][gram]
        gamma = sum(d[min(c, 3)] for c in counts) / sum(counts)
        return (n - d[min(n, 3)]) / sum(counts) + gamma * below

    def score(self, text):
        w = ["START"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(w)))


def corpus():
    base = "The cat sat on the mat and the dog sat on the cat while a bird sang to the dog".split()
    return [" ".join(base[(i * k) % len(base)] for k in range(1, 3 + i % 23)) for i in range(60)] + [None, "", "the THE"]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])
def test_model_equals_the_plain_one(spark, monkeypatch, order, shard_bytes):
    monkeypatch.setattr(ngrams, "SHARD_BYTES", shard_bytes)
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model, plain = fit_ngrams(df, "text", order), Plain(texts, order)
    assert model.tokens == sum(plain.raw.values()) and model.words == len(plain.raw)
    fresh = [*texts, "the unseen word", "unseen", "a dog sat"]
    seen = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(fresh)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in score_texts(seen, "text", model, ("doc_id",)).collect()}
    for i, t in enumerate(fresh):
        r, w = got[i], tokens(t)
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in plain.raw for x in w)
        n, v = model.tokens, model.words
        base = sum(math.log10((plain.raw[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(plain.score(t), abs=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(w)))


def test_probabilities_of_a_context_sum_to_one():
    plain = Plain(corpus(), 2)
    for context in ("START", b"the", b"never"):
        total = sum(plain.p((context, w[0])) for w in plain.levels[1]) + plain.p((context, "unknown"))
        assert total == pytest.approx(1.0)


def test_no_rows_and_other_folders(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = fit_ngrams(none, "text")
    assert model.tokens == 0
    one = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = score_texts(one, "text", model, ("doc_id",)).collect()
    assert all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in got)
    assert score_texts(none, "text", model, ("doc_id",)).count() == 0
    with pytest.raises(ValueError):
        mounted("s3a://bucket/folder")
    with pytest.raises(ValueError):
        fit_ngrams(one, "text", 1)


def test_query_holds_out_and_beats_its_base(spark):
    import zlib

    got = lm_scoring(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    train = sum(len(tokens(t)) for i, t in docs.items() if not held[i])
    assert all(r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == train for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_a_lost_file_is_an_error_and_scratch_deletes(spark):
    df = spark.createDataFrame([(1, "one two three one two"), (2, "two three")], "id long, text string")
    with scratch(spark):
        model = fit_ngrams(df, "text")
        assert score_texts(df, "text", model, ("id",)).count() == 2
        words = [token_hashes("one two")]
        assert np.isfinite(token_scores(model, words)[0]).all()
        ngrams._mapped.cache_clear()
        os.rename(f"{model.folder}/word-1-0", f"{model.folder}/word-1-0.gone")
        with pytest.raises(FileNotFoundError):
            token_scores(model, words)
        os.rename(f"{model.folder}/word-1-0.gone", f"{model.folder}/word-1-0")
    assert not os.path.exists(model.folder)
