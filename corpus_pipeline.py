"""From documents to token ids in four stages.

Each stage takes a table with the columns of documents and gives the rows it keeps, unchanged and with all
columns; the last one gives token ids. A table without rows gives one without rows. Rows with a null doc_id,
a null or an empty text are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontamination, minhash_dedup, sentencepiece_codec, toxicity
from loomstone.llm.common import scratch, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold of their language.

    A score at the threshold is rejected. Null and empty texts have the score of no words; a null or unknown
    language has the threshold of all. Rows that repeat are kept or rejected together; without labels nothing is learnt, and all are kept
    or rejected by the share of labels. Texts are scored whole.
    """
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    scored = toxicity.score(docs, model)
    return scored.where(F.col("score") < toxicity.threshold_of(F.col("lang"), model)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Exact copies are near duplicates; of rows that repeat doc_id and text one stays. Null, empty and blank texts
    are no duplicates of each other and all stay. A group without any doc_id stays whole.
    """
    small_batches(spark)
    return minhash_dedup.keep_one(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark.

    Rows that repeat are kept or dropped together. Null and empty texts hold none, and null and empty items are in none;
    without items all documents stay.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]), threshold=0.8)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document, decoded again as a test.

    restored is false where decoding does not give the text back: where it holds U+2581, the model's own mark of a space,
    and no others; such documents stay. Null and empty texts have no ids.
    """
    small_batches(spark)
    return sentencepiece_codec.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("sentencepiece", tokenize)]

#: The stages are no SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each one keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
