"""From raw documents to packed sequences: five stages over one corpus."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsmelt.llm.common import discard, documents, materialise, scratch_dir, scratch_scope
from docsmelt.llm.packing import pack_documents
from docsmelt.llm.pii import replace_entities
from docsmelt.llm.quality import fit_quality, quality_scores
from docsmelt.llm.shingle_sets import one_of_each
from docsmelt.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")

#: Near-duplicates: sets of five-word shingles with this Jaccard similarity or more.
SHINGLE, SIMILARITY = 5, 0.8
VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the corpus.

    Every row is judged by its own text, so null ids, ties and repeated rows need no rule;
    null and empty texts score as the model's bias alone. No rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality_scores(docs, fit_quality(docs, labels), keep=("text", *REST))
    return scores.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id.

    Decided row by row: of exact repeated rows one stays, and rows that share an id are
    judged by their own texts. Of rows with equal ids in a group any one stays, null ids
    come last. Null texts and texts without words are in no group and all stay. No rows
    give none.
    """
    return one_of_each(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that occur elsewhere; other texts stay as they are written.

    Every row stays, with what is left of its text: null texts stay null, repeated rows of
    35 words and more (whatever their ids) are left empty. No rows give none.
    """
    found = remove_repeats(docs, keep=("text", *REST))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by surrogates.

    Every row stays; null texts stay null, the same entity has the same surrogate in all
    rows. No rows give none.
    """
    found = replace_entities(docs, keep=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; rows with null or repeated ids are documents
    of their own. No rows give none.
    """
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again.

    What a stage writes for itself goes with it, its result when the next one is written.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        folder = scratch_dir(spark)
        with scratch_scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
