"""The document pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of `documents`, and no others, so extra columns cannot clash. Rows with null or empty text pass the filters as
clean documents (they have no toxic word, and all documents without words are copies of each other, so one of them
stays). A very long text goes through every stage as a whole. Rows that repeat an id are documents of their own until
near-duplicates go; of equal rows one stays, of equally small ids the row with the smaller hash. An empty table goes
through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm import pii_crf, toxicity_ftrl
from fieldloom.llm.decontaminate import without_contaminated
from fieldloom.llm.packing import pack_documents
from fieldloom.llm.simhash_gph import one_of_similar
from fieldloom.llm.token_store import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    model = toxicity_ftrl.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_ftrl.without_toxic(docs, model).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: a Jaccard of 0.8 or more of
    five-word shingles, met through wide SimHash fingerprints and verified where these leave a doubt."""
    return one_of_similar(docs, size=5, share=0.8).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    masked = pii_crf.redact(docs.select(*COLUMNS), pii_crf.train(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they are in."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: The stages' models and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
