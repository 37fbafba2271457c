"""The corpus pipeline: documents from the raw table to a training mix, stage by stage.

Each stage takes what the one before has kept, written as Parquet and read again. All but the last return
the columns of ``documents``; the last adds ``tokens``, ``rate`` and ``copy``, and holds a document as often as
its rate says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.decontamination import with_matches
from riskloom.llm.mixing import mix_to_weights
from riskloom.llm.near_duplicates import drop_near_duplicates
from riskloom.llm.personal_data import redact
from riskloom.llm.queries import MIX, TOXIC_FROM, domain_model, toxicity_lexicon
from riskloom.llm.toxicity import score_toxicity
from riskloom.sources import freeze, read_table


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row, so that no further column can clash with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity_lexicon(spark, sf_dir, docs)
    scored = score_toxicity(_packed(docs), "text", lexicon, ("row",))
    return scored.filter(F.col("toxicity") < TOXIC_FROM).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, "doc_id", "text", words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    found = with_matches(_packed(docs), "text", items, "item_id", item_text="text")
    return found.filter(F.size("matches") == 0).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs, "text")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of ``docs`` named as one that this stage adds are replaced."""
    mixed = mix_to_weights(_packed(docs), "doc_id", "text", domain_model(spark, sf_dir, docs), MIX)
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("tokens", "rate", "copy")]
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.filter("copies > 0").select(*others, "tokens", "rate", copies)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Classifier and rates cannot be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir))
    return docs
