"""A linear text classifier over averaged hashed subword embeddings, trained in numpy.

The subwords of a text are its character n-grams, word ends marked, hashed into a table
of embeddings. A text is the mean of the embeddings of its subwords; a linear softmax follows.
Both are trained together by stochastic gradient descent. For scoring, embeddings and softmax
are multiplied into one table of a few numbers per subword.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded_ids_by_label, map_batches
from riskloom.sources import freeze

BUCKETS, WIDTH, EPOCHS, RATE, SEED = 1 << 13, 16, 6, 0.8, 11
#: Most labelled rows that a classifier is fitted on.
FIT_ROWS = 4_000
_BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the letters in lower case, one space for each run of anything else, and
    one at either end; nothing without letters."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return codes[:0]
    # Of a run of other characters the first one stays.
    stays = letter.copy()
    stays[0] = True
    stays[1:] |= letter[:-1]
    return np.where(letter, codes, np.uint32(32))[stays]


def subword_counts(text: str | None) -> np.ndarray:
    """How often each bucket of subwords of 2 to 4 characters occurs; zeros without letters."""
    codes = letter_codes(text)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes) - 1, _BLOCK):
        # Blocks overlap by the longest subword less one; hashes take bounded room.
        c = codes[at : at + _BLOCK + 3]
        h, found = c * np.uint32(0x9E3779B1), []
        for size in range(2, 5):
            if len(c) < size:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[size - 1 :] * np.uint32(0xC2B2AE35)
            found.append(h[:_BLOCK] >> np.uint32(32 - 13))
        counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class Classifier:
    """``table`` has a row of logits per bucket; ``temperature`` calibrates probabilities, and below
    ``reject_under`` held-back rows were too often wrong."""

    classes: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_under: float = 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        total = counts.sum()
        logits = (counts.astype(float) @ self.table) / total + self.bias if total else self.bias
        z = (logits - logits.max()) / self.temperature
        e = np.exp(z)
        return e / e.sum()


def _train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """``bags`` has the buckets of each text and how often they occur."""
    draw = np.random.default_rng(SEED)
    embed = draw.normal(0, 0.1, (BUCKETS, WIDTH))
    soft, bias = np.zeros((WIDTH, classes)), np.zeros(classes)
    # The step grows for small sets, so that they get about as many updates in all.
    epochs = int(np.clip(6 * EPOCHS * 500 / max(1, len(bags)), EPOCHS, 60))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in draw.permutation(len(bags)):
            ids, share = bags[i][0], bags[i][1] / bags[i][1].sum()
            mean = share @ embed[ids]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = soft @ p
            soft -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # Rows of a mean get small gradients; a larger step makes up for it.
            embed[ids] -= 20 * rate * share[:, None] * back
    return embed @ soft, bias


def fit_classifier(labelled: DataFrame, id: str, text: str, label: str, rows: int = FIT_ROWS, accuracy: float = 0.99) -> Classifier:
    """Fitted on at most ``rows`` labelled rows, of each label those of the lowest hash of ``id``, with the same
    room for every label (``bounded_ids_by_label``); null labels and texts without letters are left out.
    A fifth of each label, none of fewer than five rows, is held back to fit the temperature and to
    find the score above which ``accuracy`` of them are right. Spark makes the subword counts;
    the driver gets one bounded bag for each row of the sample."""
    ids = bounded_ids_by_label(labelled, id, label, rows)
    usable = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    usable = usable.join(F.broadcast(ids), id, "left_semi").select(
        F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")
    )

    def bag(batch):
        ids, counts = [], []
        for t in batch["text"]:
            c = subword_counts(t)
            at = np.flatnonzero(c)
            ids.append(at.astype(np.int16))
            counts.append(c[at].astype(np.int32))
        return {"id": batch["id"], "label": batch["label"], "ids": ids, "counts": counts}

    kind = dict(usable.dtypes)["id"]
    schema = f"id {kind}, label string, ids array<smallint>, counts array<int>"
    # Repeated ids could make more rows than ids; only then these narrow rows are cut to the bound. A limit gathers them in
    # one task, whose result the driver would hold several times; without one they arrive by partitions.
    bags_ = freeze(map_batches(usable, schema, bag))
    got: pa.Table = (bags_.limit(rows) if bags_.count() > rows else bags_).toArrow()
    rows_ = [
        (str(i), la, b.values.to_numpy(), c.values.to_numpy())
        for i, la, b, c in zip(got["id"].to_pylist(), got["label"].to_pylist(), got["ids"], got["counts"])
        if len(b.values)
    ]
    rows_.sort(key=lambda r: (r[0], r[1], len(r[2])))
    classes = tuple(sorted({r[1] for r in rows_}))
    if not classes:
        return Classifier((), np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([classes.index(r[1]) for r in rows_])
    bags = [(b, c) for _, _, b, c in rows_]
    draw = np.random.default_rng(SEED)
    of_class = [draw.permutation(np.flatnonzero(y == c)) for c in range(len(classes))]
    held = np.concatenate([rows_of[: len(rows_of) // 5] for rows_of in of_class])
    inside = np.setdiff1d(np.arange(len(bags)), held)
    table, bias = _train([bags[i] for i in inside], y[inside], len(classes))
    if not len(held):
        return Classifier(classes, table, bias)
    logits = np.array([bags[i][1] @ table[bags[i][0]] / bags[i][1].sum() + bias for i in held])

    def softmax(t):
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    right = y[held]
    loss = lambda t: -np.log(softmax(t)[np.arange(len(held)), right] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = softmax(temperature)
    top, ok = p.max(axis=1), p.argmax(axis=1) == right
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(ok[order]) >= accuracy * np.arange(1, len(order) + 1))
    wrong = bool((~ok).any())
    under = float(top[order][good[-1]]) if wrong and len(good) else 0.0
    return Classifier(classes, table, bias, temperature, under)
