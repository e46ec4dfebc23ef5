"""A corpus pipeline of the operators in starcheck.llm; each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcheck.llm import langid, mixing, packing, substring_dedup
from starcheck.llm.catalog import vocabulary
from starcheck.llm.minhash import near_duplicates
from starcheck.llm.scratch import Scratch

#: Below this corrected share of known n-grams a text is in none of the languages.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or whose n-grams no known language has.

    The languages are learned from all documents with a text and a lang. If there are none, all
    documents stay.
    """
    model = langid.learn(docs)
    if not model.langs:
        return docs
    found = langid.predictor(model, spark)(F.col("text").cast("string"))
    return docs.filter((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= MIN_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Of repeated rows with one doc_id one stays. Rows without a doc_id or without words stay.
    """
    found = near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    return kept.filter("doc_id is null").unionByName(
        kept.filter("doc_id is not null").dropDuplicates(["doc_id"])
    )


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has are cut out.

    n_chars follows the text. A document of which nothing is left goes.
    """
    cut = substring_dedup.cut(docs, substring_dedup.repeated_passages(docs))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars) if "n_chars" in docs.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target weights."""
    return mixing.mix(docs, **mixing.PRODUCTION).filter("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, sequences and offsets."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Language models, raking and tokenizers have no counterpart in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table `documents`; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
