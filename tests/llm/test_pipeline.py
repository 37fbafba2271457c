"""The pipeline's stages against plain Python, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from riskloom.llm.decontamination import terms_of
from riskloom.llm.personal_data import redact_text
from riskloom.llm.queries import TOXIC_FROM, toxicity_lexicon
from riskloom.llm.toxicity import Lexicon, _automaton, _features, measure
from tests.llm.test_near_duplicates import brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Each stage's output, written and reread as the next one's input."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[0])


def test_names_and_columns(outputs):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "mixing"]
    for name, _ in pipeline.STAGES[:-1]:
        assert outputs[name].columns == COLUMNS


def test_toxic_documents_go(spark, outputs):
    lexicon: Lexicon = toxicity_lexicon(spark, FOLDER, outputs["documents"])
    a = _automaton(lexicon.weights, lexicon.exceptions)
    import numpy as np

    def score(text):
        x = _features(np.array([measure(a, text)], float))[0] @ np.array(lexicon.curve)
        return 1 / (1 + np.exp(-x))

    assert rows(outputs["toxicity"]) == [r for r in rows(outputs["documents"]) if score(r[1]) < TOXIC_FROM]
    assert len(rows(outputs["toxicity"])) < len(rows(outputs["documents"]))


def test_one_of_each_class_stays(outputs):
    before = rows(outputs["toxicity"])
    classes = brute([(r[0], r[1]) for r in before], 5)
    assert rows(outputs["near_dedup"]) == [r for r in before if classes[r[0]] == r[0]]


def test_copied_items_go(spark, outputs):
    items = [b" ".join(terms_of(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = rows(outputs["near_dedup"])
    holds = lambda text: any(i in b" ".join(terms_of(text)) for i in items)
    left = rows(outputs["decontamination"])
    assert set(left) <= set(before) and not any(holds(r[1]) for r in left)
    gone = set(before) - set(left)
    assert sum(holds(r[1]) for r in gone) >= 0.9 * len(gone)


def test_personal_data_is_replaced(outputs):
    want = [(r[0], t := redact_text(r[1]), *r[2:4], len(t)) for r in rows(outputs["decontamination"])]
    assert rows(outputs["personal_data"]) == want


def test_documents_are_repeated_as_rates_say(outputs):
    before = {r[0]: r for r in rows(outputs["personal_data"])}
    after = outputs["mixing"].collect()
    copies = Counter(r["doc_id"] for r in after)
    for r in after:
        assert tuple(r[c] for c in COLUMNS) == before[r["doc_id"]]
        assert copies[r["doc_id"]] in (int(r["rate"]), int(r["rate"]) + 1)
    # The targets ask no domain to shrink.
    assert len(copies) >= 0.9 * len(before)


def test_run_equals_the_stages(spark, outputs):
    key = lambda df: sorted((r["doc_id"], r["copy"]) for r in df.select("doc_id", "copy").collect())
    assert key(pipeline.run(spark, FOLDER)) == key(outputs["mixing"])


def test_stages_take_odd_rows_and_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    odd = [(None, None, None, None, None), (10**6, None, "en", None, 0), (10**6 + 1, "", None, "src0", 0), (10**6 + 2, "w " * 50_000, "en", "src0", 100_000)]
    twice = docs.union(docs.limit(3)).union(spark.createDataFrame(odd, docs.schema))
    for name, stage in pipeline.STAGES:
        out = stage(spark, twice, FOLDER)
        assert out.count() >= 30 - 10, name
        assert out.filter("doc_id is null").count() >= 1, name
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.filter("false"), FOLDER).count() == 0, name


def test_every_document_stays_in_the_mix(outputs):
    before = {r[0] for r in rows(outputs["personal_data"])}
    after = outputs["mixing"].collect()
    assert {r["doc_id"] for r in after} == before
    assert min(r["rate"] for r in after) >= 1


def test_columns_that_clash_stay(spark):
    added = {"toxicity": 1, "copy": 2, "matches": 3, "tokens": 4, "__text": 5, "row": 6, "__kept": 7, "__row": 8}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    docs = docs.withColumns({c: F.lit(v) for c, v in added.items()})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert {tuple(r) for r in out.select(*added).distinct().collect()} == {tuple(added.values())}, name
    mixed = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert len(set(mixed.columns)) == len(mixed.columns)
    assert {r["matches"] for r in mixed.collect()} == {3}
