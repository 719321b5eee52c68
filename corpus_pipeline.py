"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, line_dedup, packing, quality, simhash
from graphloom.llm.common import new_path, table
from graphloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), carry=["source", F.col("n_chars").alias("_n"), F.col("lang").alias("_lang")])
    return judged.where("keep").select("doc_id", "text", F.col("_lang").alias("lang"), "source", F.col("_n").alias("n_chars"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; those left without any text go."""
    ship(spark)
    kept = line_dedup.dedup_lines(docs, carry=["lang", "source"])
    text = F.col("kept")
    return kept.where((F.col("n_dropped") == 0) | (F.trim(text) != "")).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the smallest id (null ids last), then the smallest text."""
    ship(spark)
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2,048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
#: The stages before the last can't be expressed in SQL (trained model, hashes over bits); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written to the shared folder."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
