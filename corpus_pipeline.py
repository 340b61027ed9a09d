"""Corpus pipeline: language ID, near-dedup, substring dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() applies them to the documents table, each
stage's result written to the shared folder and read again.

All stages take texts of any length whole, keep rows whose other columns are null, and
give no rows for an empty table.  The first drops null and blank texts, so that the others
never see one in a run; taken alone, they do with a null text what their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, secret, small_batches
from tessera.llm.langid import identify
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack_sequences
from tessera.llm.pii import replace_pii
from tessera.llm.substring import remove_repeats
from tessera.llm.tokens import default_path

#: Least posterior of the predicted language; text without letters is rejected too.
LANGUAGE_SCORE = 0.5
#: Shortest repeated passage, in words, that is cut.
PASSAGE = 50


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from all rows with text and lang.

    Texts that are null or without a letter, and those of too small a posterior, go; null doc_ids and lang stay, repeated rows stay repeated."""
    small_batches(spark)
    out = identify(docs, default_path("piece_bpe_32k.model"))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Of rows that share a doc_id and text one stays; rows with a null doc_id all stay; null and blank texts are linked with nothing and stay."""
    kept = near_duplicates(docs, k=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words or more that start earlier; documents left without a word go.

    A null text has no passages and comes back empty; rows of a null doc_id come before all others; repeated rows are repeats of the first."""
    out = remove_repeats(docs, width=PASSAGE)
    return out.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; a null text stays null, repeated rows stay alike."""
    return replace_pii(docs, secret(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in sequences; a null text is empty (its end token), repeated rows are packed each."""
    return pack_sequences(docs, default_path("word_bpe_49k.json"), end=1, length=2048, with_ids=False).drop("ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]

#: No SQL: segmentation sums, tokenizer ids and packing are beyond it; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
