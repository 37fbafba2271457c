"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case, maps look-alike letters of other scripts to Latin ones, undoes digits and
signs written for letters inside words, and turns everything but letters and digits into one
space. Lexicon entries are whole words or phrases with weights; matches inside an exception
phrase do not count. The weights found are normalised by length and turned into a
probability by a logistic curve.

Weights and curve are fitted on labelled rows, at most ``FIT_ROWS`` of them. A word enters the
lexicon where the lower bound of its log odds ratio passes ``MIN_WEIGHT``; the curve is fitted
on rows scored with the lexicon of the other half, so that no row is scored by its own words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_ids, fresh, map_batches

#: Most labelled rows that weights and curve are fitted on.
FIT_ROWS = 30_000
MIN_WEIGHT, MIN_DOCUMENTS = 1.5, 3

# General words of abuse with a prior weight, and phrases in which such a word
# is harmless.
PRIOR = dict.fromkeys(
    "idiot moron stupid scum loser worthless pathetic disgusting trash clown imbecile".split(), 3.0
)
EXCEPTIONS = (
    "trash can", "trash bag", "trash bin", "take out the trash", "clown fish", "circus clown",
    "scum line", "pond scum", "pathetic fallacy", "sore loser rule", "stupid simple",
)

# Letters of other scripts that look like Latin ones, pairwise.
_LOOKS = "аaеeоoрpсcхxуyіiјjѕsԁdһhкkмmтtвbнhαaβbεeιiκkνvοoρpτtυuχxγyℓlıi"
_LOOK_ALIKE = {ord(_LOOKS[i]): _LOOKS[i + 1] for i in range(0, len(_LOOKS), 2)}
_LOOK_ALIKE |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0x200B: "", 0x00AD: "", 0x2060: ""}
_SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
_MARKS = "@$!|"
# A digit or sign before a letter: where a word may be disguised.
_HIT = re.compile(r"[0134578@$!|][^\W\d_]")
_TOKEN = re.compile(r"(?:[^\W_]|[@$!|])++")
_GAP = re.compile(r"[\W_]+")


def _undisguised(flat: str) -> str:
    """``flat`` with digits and signs written for letters undone in tokens of letters, digits and signs
    that have one before a letter, and letters for a third at least. One pass; each token is looked at once."""
    out, done, at = [], 0, 0
    while m := _HIT.search(flat, at):
        start = m.start()
        while start > at and (flat[start - 1].isalnum() or flat[start - 1] in _MARKS):
            start -= 1
        at = _TOKEN.match(flat, m.start()).end()
        token = flat[start:at].rstrip(_MARKS)
        if sum(map(str.isalpha, token)) * 3 >= len(token):
            out += [flat[done:start], token.translate(_SIGNS)]
            done = start + len(token)
    return "".join([*out, flat[done:]])


def fold(text: str | None) -> str:
    """Words of the folded text, one space before and after each."""
    flat = (text or "").lower()
    flat = flat if flat.isascii() else flat.translate(_LOOK_ALIKE)
    return f" {_GAP.sub(' ', _undisguised(flat)).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """``weights`` of folded words or phrases; ``exceptions`` are folded phrases."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    # Intercept, and slopes on log(1 + weight per 100 words) and log(1 + weight).
    curve: tuple[float, float, float] = (-3.0, 2.0, 0.8)
    automaton: object = field(default=None, compare=False)


def _automaton(weights: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, weight in weights.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, weight))
    for phrase in exceptions:
        if (key := fold(phrase)) != "  ":
            a.add_word(key, (len(key), None))
    a.make_automaton()
    return a


def measure(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, float, int]:
    """Weight found per 100 words, weight found, and number of matches."""
    flat = fold(text)
    if not len(automaton):
        return 0.0, 0.0, 0
    hits, safe = [], []
    for end, (length, weight) in automaton.iter(flat):
        (safe if weight is None else hits).append((end - length + 1, end, weight))
    # One sweep: of the exceptions that start no later than a match, the one that ends last decides.
    hits.sort()
    safe.sort(key=lambda s: s[0], reverse=True)
    total = count = covered = 0
    for start, end, weight in hits:
        while safe and safe[-1][0] <= start:
            covered = max(covered, safe.pop()[1])
        if end > covered:
            total, count = total + weight, count + 1
    words = flat.count(" ") - 1
    return 100.0 * total / (words + 20), float(total), count


def _features(found: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(found)), np.log1p(found[:, 0]), np.log1p(found[:, 1])])


def _fit_curve(found: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """Ridge logistic regression by Newton steps; None where only one class was seen."""
    if not 0 < y.sum() < len(y):
        return None
    x, b = _features(found), np.zeros(3)
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b
        )
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b) if b[1] + b[2] > 0 else None


def _weights(counts: list, pos: str, neg: str, n_pos: int, n_neg: int) -> dict[str, float]:
    out = dict(PRIOR)
    for r in counts:
        p, n = r[pos], r[neg]
        if p < MIN_DOCUMENTS:
            continue
        odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((n + 0.5) / (n_neg + 1))
        low = odds - 1.64 * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if low >= MIN_WEIGHT:
            out[r["word"]] = float(low)
    return out


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str,
    rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Lexicon and curve from the texts of ``docs`` that ``labels`` labels 0 or 1; other labels
    and null texts are left out.

    At most ``rows`` labels are taken and sent to the texts, which are not shuffled.

    Word counts are made by Spark; only words that may pass reach the driver, and of each row
    three numbers. Both are bounded by ``rows``. Without labelled rows, or with one class, the
    prior lexicon and curve stand.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"))
    # Labels of one id count once, and as toxic where they differ.
    chosen = known.join(F.broadcast(bounded_ids(known, "id", rows)), "id").groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(chosen), "id").withColumn(
        "half", (F.crc32(F.col("id").cast("string")).bitwiseAND(8) > 0).cast("int")
    )

    def words(batch):
        sets = [sorted(set(fold(t).split())) for t in batch["text"]]
        return {"y": batch["y"], "half": batch["half"], "words": sets}

    seen = map_batches(sample.select("text", "y", "half"), "y int, half int, words array<string>", words)
    seen = seen.select("y", "half", F.explode("words").alias("word"))
    side = lambda y, h: F.count_if((F.col("y") == y) & (F.col("half") == h))
    counts = (
        seen.groupBy("word")
        .agg(side(1, 0).alias("p0"), side(1, 1).alias("p1"), side(0, 0).alias("n0"), side(0, 1).alias("n1"))
        .withColumns({"p": F.col("p0") + F.col("p1"), "n": F.col("n0") + F.col("n1")})
        .filter((F.col("p") >= MIN_DOCUMENTS) & (F.col("p") > F.col("n")))
        .collect()
    )
    counts.sort(key=lambda r: r["word"])
    sizes = sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()
    total = {(r["y"], r["half"]): r["n"] for r in sizes}
    n = lambda y, *h: sum(total.get((y, x), 0) for x in h)
    halves = [_weights(counts, f"p{h}", f"n{h}", n(1, h), n(0, h)) for h in (0, 1)]

    def found(batch):
        both = [_automaton(w, exceptions) for w in halves]
        got = [measure(both[1 - h], t) for t, h in zip(batch["text"], batch["half"])]
        return {"y": batch["y"], "density": [g[0] for g in got], "weight": [g[1] for g in got]}

    rated = map_batches(sample.select("text", "y", "half"), "y int, density double, weight double", found).collect()
    weights = _weights(counts, "p", "n", n(1, 0, 1), n(0, 0, 1))
    x = np.array(sorted((r["density"], r["weight"], r["y"]) for r in rated)).reshape(-1, 3)
    curve = _fit_curve(x[:, :2], x[:, 2])
    return Lexicon(weights, exceptions, *([curve] if curve else []))


@lru_cache(maxsize=4)
def _built(items: tuple, exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    return _automaton(dict(items), exceptions)


def score_toxicity(df: DataFrame, text: str, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, with ``toxicity`` (0 to 1) and ``toxic_matches`` (long). Null and
    empty texts are scored as texts without matches; repeated rows are scored each, no rows give none. No
    shuffle; one text at a time. ``keep`` must not hold the two names added."""
    items, curve = tuple(sorted(lexicon.weights.items())), np.array(lexicon.curve)
    exceptions = lexicon.exceptions

    def rows(batch):
        a = _built(items, exceptions)
        found = np.array([measure(a, t) for t in batch[source_text]], float).reshape(-1, 3)
        p = 1 / (1 + np.exp(-np.clip(_features(found) @ curve, -30, 30)))
        return {"toxicity": p, "toxic_matches": found[:, 2].astype(int)}

    source_text = fresh(df, "__text")
    source = df.select(*keep, F.col(text).alias(source_text))
    return map_batches(source, "toxicity double, toxic_matches long", rows, keep)
