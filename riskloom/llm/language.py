"""Language identification by averaged hashed subword embeddings (see ``subwords``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches
from riskloom.llm.subwords import Classifier, subword_counts

UNDETERMINED = "und"


def identify_language(df: DataFrame, text: str, model: Classifier, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, with ``lang_pred``, ``score`` (calibrated probability of it) and
    ``rejected`` (the score is under what held-back rows ask for).

    ``und`` with score 0 and rejected: null text, no letter, or a model that saw no language.
    One text at a time, whole; nothing is shuffled."""
    source = df.select(*keep, F.col(text).alias("__text"))
    packed = df.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def rows(batch):
        m: Classifier = packed.value
        names, scores = [], []
        for t in batch["__text"]:
            counts = subword_counts(t)
            known = counts.any() and len(m.classes)
            p = m.probabilities(counts) if known else np.zeros(1)
            names.append(m.classes[int(p.argmax())] if known else UNDETERMINED)
            scores.append(float(p.max()))
        low = [s < m.reject_under or n == UNDETERMINED for s, n in zip(scores, names)]
        return {"lang_pred": names, "score": scores, "rejected": low}

    return map_batches(source, "lang_pred string, score double, rejected boolean", rows, keep)
