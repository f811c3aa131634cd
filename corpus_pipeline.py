"""The corpus pipeline: documents in, encoded training text out. Each stage applies one operator.

Every stage but the last returns the columns of documents. Toxic documents go; boilerplate lines that
stand on many sites are taken out of the texts, but for their first copy; of documents that share four
fifths of their five-word shingles the one with the smallest id stays; the mix repeats or leaves out
documents so that the sources meet their target weights; the rest is encoded. Empty tables pass through;
nulls are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import line_dedup, mixing, neardup, sp_codec, toxicity
from firnline.llm.common import fresh, stored
from firnline.llm.queries import TOXIC, model_path, toxicity_model

#: Models and hashes have no SQL twin; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = fresh(docs, "score")
    judged = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), name=score)
    return judged.where(F.col(score) < TOXIC).drop(score)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove(docs, length_col="n_chars")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_codec.encode_documents(docs, model_path(), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("simhash", without_near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's table is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
