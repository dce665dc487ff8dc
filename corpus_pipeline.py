"""A training corpus from documents: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, language, mixing, pieces, suffix
from lodestone.llm.common import Scratch, shrink, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A passage of more words that repeats goes, however few bytes it has.
PASSAGE_WORDS = 50


def begin(spark: SparkSession) -> None:
    """Before each stage: executors give back what the stage before needed."""
    shrink(spark)
    small_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing label is filled in.

    Model and threshold come from all labelled texts. Texts without a letter go, and those unlike all
    languages learned: below half of the least score of labelled texts that are predicted rightly, unless
    the prediction is the document's own label. If no document has a label there is nothing to learn, and
    all with a letter stay.
    """
    begin(spark)
    model = language.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    least = language.least_score(docs, model)
    rows = language.predict(docs, model, "text", (*COLUMNS,))
    known = (F.col("score") >= least) | F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(False))
    return rows.where((F.col("lang_pred") != "und") & known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    begin(spark)
    return jaccard.representatives(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings of 400 bytes, or of over 50 words in fewer bytes; a character cut in two goes as well."""
    begin(spark)
    rows = suffix.dedup(docs, keep=("doc_id", "lang", "source"), words=PASSAGE_WORDS)
    return rows.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per copy drawn."""
    begin(spark)
    return mixing.mixed(docs).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each drawn document's piece ids."""
    begin(spark)
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", source_mix),
    ("sentencepiece", sentencepiece),
]

#: None of the stages' models, samples and hashes can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's rows are deleted when the next one's are written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    scratch.leave()
    return docs
