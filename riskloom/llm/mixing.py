"""Mixing to target weights with soft membership.

A classifier, fitted on a labelled table, gives each document its domain posteriors. A document
of t tokens and posteriors p adds rate * t * p_d expected tokens to domain d. Rates not under
a floor are fitted by projected gradient least squares, so that the totals match the targets.
``mix_to_weights`` has the floor 1, so that every document stays.

All rates start at 1. A step subtracts p . g from each rate and cuts at the floor, where g, one number per
domain, is the gradient over the totals. So a rate is a function of the posteriors and the list of
g's, which every document replays for itself; a step is one aggregate of one number per domain
and per pair of domains. Nothing of a document reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, map_batches
from riskloom.llm.subwords import Classifier, subword_counts
from riskloom.sources import freeze

STEPS, TOLERANCE = 60, 1e-3
#: With a floor above 0, the weight of documents at the floor in the metric of a step: without them steps overshoot.
AT_FLOOR = 0.1


@dataclass(frozen=True)
class Mixture:
    """The steps taken, the targets in tokens, and the expected totals reached."""

    steps: tuple[tuple[float, ...], ...]
    target: tuple[float, ...]
    reached: tuple[float, ...]


def posteriors(df: DataFrame, text: str, model: Classifier) -> DataFrame:
    """``df`` with ``tokens`` (runs without ASCII white space) and ``posteriors`` (array, in the order of the classes). A text
    without letters, or null, has those of the model's bias. Columns of these names are replaced."""
    packed = df.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    whole = fresh(df, "__text")

    def rows(batch):
        m: Classifier = packed.value
        return {
            "tokens": [len((t or "").encode("utf-8", "surrogatepass").split()) for t in batch[whole]],
            "posteriors": [m.probabilities(subword_counts(t)) for t in batch[whole]],
        }

    keep = [c for c in df.columns if c not in ("tokens", "posteriors")]
    source = df.select(*keep, F.col(text).alias(whole))
    return map_batches(source, "tokens long, posteriors array<double>", rows, keep)


def rate_of(p: Column, steps: tuple[tuple[float, ...], ...], floor: float = 0.0) -> Column:
    """The rate after ``steps``: each is subtracted by its product with ``p``, cut at ``floor``."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in steps])
    return F.aggregate(
        table,
        F.lit(1.0),
        lambda r, g: F.greatest(
            F.lit(float(floor)), r - sum((p[i] * g[i] for i in range(len(steps[0]))), F.lit(0.0))
        ),
    )


def fit_rates(members: DataFrame, weights: tuple[float, ...], floor: float = 0.0) -> Mixture:
    """``members`` has ``tokens`` and ``posteriors``; it is read once a step, so freeze it.

    Targets are ``weights``, which sum to 1, times a total: the least for which no domain has to shrink. That
    alone does not keep every rate at 1, as documents belong to several domains: with a ``floor`` (at most 1)
    the total grows until rates that are not under it fit, or no larger one fits better.
    Domains nobody belongs to cannot be reached and are left out of the total. Ends after ``STEPS`` or within ``TOLERANCE`` of every target."""
    w = np.array(weights, float)
    n = len(w)
    p, t = F.col("posteriors"), F.col("tokens")

    def sums(steps):
        rate = rate_of(p, steps, floor)
        rated = members.select("tokens", "posteriors", rate.alias("rate"))
        totals = [F.sum(F.col("rate") * t * p[i]).alias(f"t{i}") for i in range(n)]
        # Tokens shared by domains i and j, of documents whose rate can still move.
        free = F.when(F.col("rate") > floor, t).otherwise(0) if steps else t
        shared = [F.sum(free * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        row = rated.agg(*totals, *shared).first()
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        return np.array([row[f"t{i}"] or 0.0 for i in range(n)]), h

    have, shared = sums(())
    if not have.sum():
        return Mixture((), tuple(have), tuple(have))
    real = (have > 1e-9 * have.sum()) & (w > 0)
    if not real.any():
        return Mixture((), tuple(have), tuple(have))
    target = w * max((have[real] / w[real]).max(), 0.0)
    # Nothing is added to a domain without a weight; documents at the floor stay in it.
    target[~real] = np.where(w > 0, 1.0, floor)[~real] * have[~real]
    steps: list[tuple[float, ...]] = []
    every = shared
    while len(steps) < STEPS and (np.abs(have - target) > TOLERANCE * target.sum() / n).any():
        # The gradient in the metric of the shared tokens: rates change by p . g, totals by
        # shared @ g, so one step would do if no rate were cut.
        g = np.linalg.lstsq(shared + 1e-9 * np.trace(shared) * np.eye(n), have - target, rcond=None)[0]
        steps.append(tuple(float(v) for v in g))
        have, shared = sums(tuple(steps))
        if floor:
            shared = AT_FLOOR * every + (1 - AT_FLOOR) * shared
            # The total that fits best what is reached, in the same metric.
            aim = np.where(real, w, 0.0)
            toward = np.linalg.lstsq(shared + 1e-9 * np.trace(shared) * np.eye(n), aim, rcond=None)[0]
            total = (toward @ np.where(real, have, 0.0)) / (toward @ aim)
            target[real] = np.maximum(target[real], (w * total)[real])
    return Mixture(tuple(steps), tuple(target), tuple(have))


def mix_to_weights(df: DataFrame, id: str, text: str, model: Classifier, weights: dict[str, float]) -> DataFrame:
    """``df`` with ``tokens``, ``posteriors``, ``rate`` and ``copies``: the rate rounded up or
    down, up as often as its fraction says, by a hash of the id. Columns of these names are replaced.
    No rate is under 1, so no row has 0 copies.

    ``weights`` gives each class its share, scaled to sum to 1; to classes without one nothing is added, and as no
    row is dropped they keep what they have. Without a class that has a weight all rates are 1. Rows without words have no say but get the rate of their posteriors; rows of a
    null or repeated id are rounded alike. No rows in, no rows out. ``df`` is written once, with its
    posteriors, and read once a step; no row is shuffled."""
    share = np.array([weights.get(c, 0.0) for c in model.classes])
    members = freeze(posteriors(df, text, model))
    steps = fit_rates(members, tuple(share / share.sum()), floor=1.0).steps if share.sum() > 0 else ()
    number = F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("copies"))
    chance = F.pmod(number, F.lit(1 << 30)) / float(1 << 30)
    rated = members.withColumn("rate", rate_of(F.col("posteriors"), steps, floor=1.0))
    up = (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", F.floor("rate") + up)
