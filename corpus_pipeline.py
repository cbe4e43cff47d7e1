"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, as written and reread Parquet, and returns the columns of documents; the
last returns the packed pieces. Driver and executors share only the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, near_dedup, packing, pii
from tidemark.llm.scratch import Scratch

#: A document whose words are less certain than this, on average, of any known language is rejected.
LEAST_SCORE = 0.5
#: Documents of one sequence: short ones are spread, so that this capacity binds beside that of tokens.
MOST_DOCUMENTS = 16


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text or letters, and those in no language the model knows; known ones may alternate.

    The model learns from the labelled rows of its own input; without any, every document goes. Each row is judged by
    itself, with or without an id; other columns stay as they are, and an empty table stays empty.
    """
    return language_id.keep_certain(docs, language_id.train(docs.filter(~language_id.held_out())), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of every group of near duplicates; repeated rows of an id and text stay once.

    Rows without an id stay, and so do texts without words; an empty table stays empty.
    """
    spare = near_dedup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id")
    return docs.join(spare, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark; rows without a text or an id are judged like all others."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind, and count the characters anew; a null text stays null."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of 1024 tokens and at most ``MOST_DOCUMENTS`` documents; a null text is its end token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=packing.Capacity(documents=MOST_DOCUMENTS))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Neither the model's verdicts nor token ids can be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if previous:
            scratch.drop(previous)
        previous = name
    return docs
