"""The operators of this package applied to the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import conversations, licences, spelling
from riskloom.llm.common import bounded_ids_by_label, split_of
from riskloom.llm.decontamination import contaminated
from riskloom.llm.language import identify_language
from riskloom.llm.mixing import mix_to_weights
from riskloom.llm.near_duplicates import near_duplicates
from riskloom.llm.ngrams import fit_ngrams, score_texts
from riskloom.llm.page_text import extract_pages
from riskloom.llm.personal_data import digest, find_personal_data
from riskloom.llm.simhash import simhash_duplicates
from riskloom.llm.subwords import FIT_ROWS, Classifier, fit_classifier
from riskloom.llm.syncmers import fingerprint, fingerprint_edits, likeness
from riskloom.llm.toxicity import Lexicon, fit_lexicon, score_toxicity
from riskloom.sources import freeze, read_table

#: Share of expected tokens each language is to have.
MIX = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}
TOXIC_FROM = 0.7


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", split_of("doc_id", 5) == 1)
    model = fit_ngrams(docs.filter(~F.col("held_out")), "text")
    scored = score_texts(docs, "text", model, ("doc_id", "held_out"))
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"), "text", ("doc_id",))
    return found.select("doc_id", *(c.alias(name) for name, c in digest(F.col("spans")).items()))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contaminated(docs, "doc_id", "text", items, "item_id", item_text="text")


def domain_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Classifier:
    """Domains are the languages of the documents that ``labels`` covers."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    covered = docs.select("doc_id", "lang").join(labels, "doc_id", "left_semi")
    ids = freeze(bounded_ids_by_label(covered, "doc_id", "lang", FIT_ROWS))
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return fit_classifier(labelled, "doc_id", "text", "lang")


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = domain_model(spark, sf_dir, docs)
    mixed = mix_to_weights(docs.select("doc_id", "text"), "doc_id", "text", model, MIX)
    shares = [F.col("posteriors")[i].alias(f"p_{c}") for i, c in enumerate(model.classes)]
    return mixed.select("doc_id", "tokens", *shares, "rate", "copies")


def toxicity_lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Lexicon:
    """Learned from labelled documents outside the held-out third."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = labels.filter(split_of("doc_id", 3) != 1)
    return fit_lexicon(docs, learned, "doc_id", "text", "toxic")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lexicon = toxicity_lexicon(spark, sf_dir, docs)
    scored = score_toxicity(docs, "text", lexicon, ("doc_id",))
    return scored.select(
        "doc_id",
        (split_of("doc_id", 3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted"),
        "toxic_matches",
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(read_table(spark, sf_dir, "pages"), "html", ("page_id", "url"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs, "doc_id", "text", words=2, percent=80)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprint_edits(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", split_of("doc_id", 3) == 1)
    model = fit_classifier(docs.filter(~F.col("held_out")), "doc_id", "text", "lang")
    return identify_language(docs, "text", model, ("doc_id", "held_out"))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(read_table(spark, sf_dir, "conversations"))
    pieces = conversations.repair_conversations(damaged, "conv_id", "turn", "role", "text", "absent")
    return conversations.digest_conversations(pieces).withColumnRenamed("conv", "conv_id")


def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.word_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return spelling.spelling_variants(found).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_lm_scoring": lm_scoring,
    "op2_personal_data": personal_data,
    "op3_decontamination": decontamination,
    "op4_mixing": mixing,
    "op5_toxicity": toxicity,
    "op6_page_text": page_text,
    "op7_near_dedup": near_dedup,
    "op8_fingerprints": fingerprints,
    "op9_language": language,
    "op10_licences": licence_scan,
    "op11_simhash": simhash,
    "op12_conversation_repair": conversation_repair,
    "op13_spelling": spelling_groups,
}

ORACLES = {
    "op10_licences": licences.oracle(),
    "op12_conversation_repair": conversations.oracle(),
    "op13_spelling": spelling.oracle(),
}
