"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

Test items are cut into segments, which are indexed; a document is cut into overlapping
passages, so wide that a copied segment lies whole in one of them. Every passage is a query.
Scores are BM25 divided by the segment's score for its own text, so 1 is a whole copy and one
threshold serves all. All segments at or above it are retrieved, and each retrieved item is verified
against the document: shares of the question's and of the answer's word n-grams found in it.

The terms that most segments hold weigh little. As long as they stay under ``SLACK`` in each
segment they are not essential: a segment whose essential terms and whole slack fall short
cannot reach the threshold. This bound is taken for all passages of a text at once; passages
that pass it go through block-max WAND with exact scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches
from riskloom.sources import freeze

K1, B = 1.2, 0.75
SEGMENT, PASSAGE = 48, 96
THRESHOLD, SLACK = 0.5, 0.25
BLOCK = 32
GRAM, MIN_QUESTION, MIN_ANSWER = 5, 0.5, 0.5
#: Bytes of test items in one index; more items give several indexes, used in turn.
INDEX_BYTES = 32 << 20

# A-Z to lower case, other ASCII than letters and digits to a space; the rest stays.
_FLAT = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FLAT).split()


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item given as one text: the last sentence is the answer. An
    item of one sentence has no answer."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", (text or "").strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (" ".join(parts), "")


def grams(terms: list[bytes]) -> set[tuple[bytes, ...]]:
    size = min(GRAM, len(terms))
    return {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)} if size else set()


@dataclass
class Index:
    """Postings by term: segment numbers and normalised weights, in order of the segments."""

    items: list[tuple]  # (item id, question terms, answer terms)
    item_of: np.ndarray
    terms: dict[bytes, int]
    starts: np.ndarray
    segments: np.ndarray
    weights: np.ndarray
    block_max: list[np.ndarray]
    term_max: np.ndarray
    essential: np.ndarray
    slack: np.ndarray


def build_index(rows: list[tuple], frequency: dict[bytes, int], n: int, mean: float) -> Index:
    """``rows`` are (item id, question, answer); ``frequency``, ``n`` and ``mean`` are the
    segment frequencies of terms, number and mean length of segments over all items."""
    items, item_of, bags = [], [], []
    for item, question, answer in rows:
        q, a = terms_of(question), terms_of(answer)
        whole = q + a
        for i in range(0, len(whole), SEGMENT):
            # A last piece of a few words joins the one before.
            if i and len(whole) - i < SEGMENT // 4:
                break
            end = len(whole) if len(whole) - i - SEGMENT < SEGMENT // 4 else i + SEGMENT
            bags.append(whole[i:end])
            item_of.append(len(items))
        items.append((item, q, a))
    terms: dict[bytes, int] = {}
    found: list[tuple[int, int, float]] = []
    for s, bag in enumerate(bags):
        tf: dict[bytes, int] = {}
        for t in bag:
            tf[t] = tf.get(t, 0) + 1
        raw = {
            t: np.log1p((n - frequency.get(t, 1) + 0.5) / (frequency.get(t, 1) + 0.5))
            * c * (K1 + 1) / (c + K1 * (1 - B + B * len(bag) / mean))
            for t, c in tf.items()
        }
        own = sum(raw.values())
        found += [(terms.setdefault(t, len(terms)), s, w / own) for t, w in raw.items()]
    found.sort()
    table = np.array(found, float).reshape(-1, 3)
    term, segments, weights = table[:, 0].astype(int), table[:, 1].astype(int), table[:, 2]
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    lists = [weights[starts[t] : starts[t + 1]] for t in range(len(terms))]
    essential, slack = np.ones(len(terms), bool), np.zeros(len(bags))
    for t in np.argsort(-np.diff(starts), kind="stable"):
        at = segments[starts[t] : starts[t + 1]]
        if (slack[at] + lists[t]).max(initial=0) <= SLACK:
            essential[t] = False
            slack[at] += lists[t]
    return Index(
        items, np.array(item_of, int), terms, starts, segments, weights,
        [np.array([w[i : i + BLOCK].max() for i in range(0, len(w), BLOCK)]) for w in lists],
        np.array([w.max() for w in lists]), essential, slack,
    )


def wand(index: Index, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All segments whose weights over the distinct terms ``query`` reach ``threshold``, by
    document-at-a-time block-max WAND."""
    at = {int(t): int(index.starts[t]) for t in query}
    end = {int(t): int(index.starts[t + 1]) for t in query}
    out, seg, low = [], index.segments, threshold - 1e-9
    while True:
        live = sorted((int(seg[p]), t) for t, p in at.items() if p < end[t])
        bound, pivot = 0.0, None
        for i, (s, t) in enumerate(live):
            bound += index.term_max[t]
            if bound >= low:
                pivot = i
                break
        if pivot is None:
            return out
        target = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == target:
            pivot += 1
        # The blocks in which the target may lie.
        tight, until = 0.0, len(index.item_of)
        for s, t in live[: pivot + 1]:
            p = int(np.searchsorted(seg[at[t] : end[t]], target)) + at[t]
            if p < end[t]:
                b = (p - int(index.starts[t])) // BLOCK
                tight += index.block_max[t][b]
                last = min(int(index.starts[t]) + (b + 1) * BLOCK, end[t]) - 1
                until = min(until, int(seg[last]) + 1)
        if pivot + 1 < len(live):
            until = min(until, live[pivot + 1][0])
        if tight < low:
            goal = max(until, target + 1)
        elif live[0][0] == target:
            score = sum(index.weights[at[t]] for s, t in live[: pivot + 1] if s == target)
            if score >= low:
                out.append((target, float(score)))
            goal = target + 1
        else:
            goal = target
        for s, t in live[: pivot + 1]:
            if s < goal:
                at[t] += int(np.searchsorted(seg[at[t] : end[t]], goal))


def search(index: Index, terms: list[bytes], threshold: float = THRESHOLD) -> dict[int, float]:
    """Best score of each item retrieved by any passage of a text."""
    get = index.terms.get
    ids = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
    pos = np.flatnonzero(ids >= 0)
    pos = pos[index.essential[ids[pos]]] if len(pos) else pos
    best: dict[int, float] = {}
    if not len(pos):
        return best
    step, n = SEGMENT, len(index.terms)
    window = pos // step
    # Passage w holds the words from w*step to w*step+PASSAGE: each word lies in two.
    pair = np.unique(np.concatenate([window, window[window > 0] - 1]) * n + np.concatenate([ids[pos], ids[pos[window > 0]]]))
    of, term = pair // n, pair % n
    count = index.starts[term + 1] - index.starts[term]
    first = np.repeat(index.starts[term] - np.cumsum(count) + count, count)
    entry = first + np.arange(count.sum())
    cell, inverse = np.unique(np.repeat(of, count) * len(index.slack) + index.segments[entry], return_inverse=True)
    total = np.bincount(inverse, index.weights[entry])
    passing = cell[total + index.slack[cell % len(index.slack)] >= threshold - 1e-9]
    for w in np.unique(passing // len(index.slack)):
        query = np.unique(ids[w * step : w * step + PASSAGE])
        for segment, score in wand(index, query[query >= 0], threshold):
            item = int(index.item_of[segment])
            best[item] = max(score, best.get(item, 0.0))
    return best


def overlaps(terms: list[bytes], found: set, part: list[bytes]) -> float:
    """Share of the n-grams of ``part`` that the text holds; 1 for an empty part."""
    want = grams(part)
    if not want:
        return 1.0
    if len(part) < GRAM:
        size = len(part)
        found = {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)}
    return len(want & found) / len(want)


def _shards(items: DataFrame) -> tuple[DataFrame, int, dict]:
    """Items with the number of the index they go to, how many, and corpus statistics."""

    def cut(batch):
        whole = [terms_of(q) + terms_of(a) for q, a in zip(batch["question"], batch["answer"])]
        return {
            "terms": [list(set(t)) for t in whole],
            "words": [len(t) for t in whole],
            "pieces": [-(-len(t) // SEGMENT) for t in whole],
        }

    cut_items = map_batches(items.select("question", "answer"), "terms array<binary>, words long, pieces long", cut)
    total = cut_items.agg(F.sum("pieces").alias("n"), F.sum("words").alias("w")).first()
    size = items.agg(F.sum(F.octet_length("question") + F.octet_length("answer")).alias("s")).first()["s"] or 0
    count = max(1, -(-size // INDEX_BYTES))
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(count)))
    frequency = cut_items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return sharded, count, {"n": total["n"] or 1, "words": total["w"] or 1, "frequency": frequency}


def with_matches(
    docs: DataFrame, text: str, items: DataFrame, item: str,
    question: str | None = None, answer: str | None = None, item_text: str | None = None,
    threshold: float = THRESHOLD, min_question: float = MIN_QUESTION, min_answer: float = MIN_ANSWER,
) -> DataFrame:
    """``docs`` with ``matches``: an array of (item, score, question_overlap, answer_overlap), one for
    each test item the document holds, by item. A column of that name is replaced.

    Items give ``question`` and ``answer``, or ``item_text`` to be cut by ``split_item``. Items
    without a word are left out; repeated items match once each. Null and empty documents hold
    nothing. An index of at most ``INDEX_BYTES`` of items goes to every task; more items mean
    more indexes, used in turn on the same rows. Documents are not shuffled."""
    kind = dict(items.dtypes)[item]
    if item_text is not None:

        def parts(batch):
            both = [split_item(t) for t in batch["t"]]
            return {"question": [q for q, _ in both], "answer": [a for _, a in both]}

        source = items.select(F.col(item).alias("item"), F.col(item_text).alias("t"))
        named = map_batches(source, "question string, answer string", parts, ["item"])
    else:
        named = items.select(
            F.col(item).alias("item"),
            F.coalesce(F.col(question), F.lit("")).alias("question"),
            F.coalesce(F.col(answer), F.lit("")).alias("answer"),
        )
    sharded, count, stats = _shards(freeze(named))
    spark, mean = docs.sparkSession, stats["words"] / stats["n"]
    match = f"array<struct<item:{kind},score:double,question_overlap:double,answer_overlap:double>>"
    keep = [c for c in docs.columns if c != "matches"]
    out = docs.select(*keep).withColumn("matches", F.array().cast(match))
    for shard in range(count):
        rows = sharded.filter(F.col("shard") == shard).orderBy("item", "question", "answer")
        rows = [tuple(r)[:3] for r in rows.collect() if terms_of(r["question"]) or terms_of(r["answer"])]
        if not rows:
            continue
        words = sorted({t for _, q, a in rows for t in terms_of(q) + terms_of(a)})
        here = spark.createDataFrame([(t,) for t in words], "term binary")
        frequency = {bytes(r["term"]): r["n"] for r in stats["frequency"].join(here, "term").collect()}
        packed = spark.sparkContext.broadcast((rows, frequency, stats["n"], mean))

        def find(batch, packed=packed):
            index = _index(packed)
            found = []
            for body in batch["__text"]:
                terms, of = terms_of(body), []
                hits = search(index, terms, threshold)
                have = {tuple(terms[i : i + GRAM]) for i in range(len(terms) - GRAM + 1)} if hits else set()
                for i, score in sorted(hits.items()):
                    name, q, a = index.items[i]
                    shares = overlaps(terms, have, q), overlaps(terms, have, a)
                    if shares[0] >= min_question and shares[1] >= min_answer:
                        of.append({"item": name, "score": score, "question_overlap": shares[0], "answer_overlap": shares[1]})
                found.append(of)
            return {"__found": found}

        searched = map_batches(out.withColumn("__text", F.col(text)), f"__found {match}", find, out.columns)
        out = searched.withColumn("matches", F.concat("matches", "__found")).drop("__found")
    return out


def contaminated(docs: DataFrame, id: str, text: str, items: DataFrame, item: str, **how) -> DataFrame:
    """One row per document and test item it holds: ``id``, ``item``, ``score``, ``question_overlap``,
    ``answer_overlap``; ``how`` as for ``with_matches``. Repeated documents give repeated rows."""
    narrow = docs.select(F.col(id).alias("__id"), F.col(text).alias("__body"))
    found = with_matches(narrow, "__body", items, item, **how).select("__id", F.explode("matches").alias("m"))
    shares = [F.col(f"m.{c}").alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return found.select(F.col("__id").alias(id), F.col("m.item").alias(item), *shares)


@lru_cache(maxsize=2)
def _index(packed) -> Index:
    return build_index(*packed.value)
