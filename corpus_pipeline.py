"""Corpus clean-up as stages over ``documents``; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import common, line_dedup, near_copies, packing, substring_dedup, toxicity

#: A document is rejected from this probability of label 1 on.
REJECTED = 0.5


def edited(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the text that ``out`` kept and its length."""
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under REJECTED, by a model of the labels that are not held out."""
    labels = common.table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where(F.col("toxicity.score") < REJECTED).select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line of 10 code points or more only in the first document that holds it."""
    return edited(docs, line_dedup.dedup_lines(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of a Jaccard similarity of 0.8 over five-word shingles make."""
    return near_copies.keep_one(docs, words_each=5, least=0.8)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each passage of 40 words or more only in the first document that holds it."""
    return edited(docs, substring_dedup.dedup_substrings(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("best-fit packing", packed),
]
#: The classifier and the token ids can't be expressed in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``; what a stage has read is removed from the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            removed(spark, f"{folder}/{number - 1}")
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing has checkpointed its pieces by now
    removed(spark, folder)
    return out
