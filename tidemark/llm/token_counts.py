"""Token counts through a digest cache.

A text's digest and the tokenizer version's digest are joined to a stored table of counts; only distinct texts that
the table lacks are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, exists, shared_root
from tidemark.llm.tokenization import Encoder, tokenizer_digest

_CACHE = "tokenizer string, digest binary, n_tokens long"
#: Digests that fill at least this share of a table are joined apart; there are never more than its inverse.
HOT_SHARE = 1000


def open_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """The cached counts of one tokenizer version, one row a digest; makes the table where there is none.

    Every append is a folder of its own, so that calls at the same time do not disturb each other.
    """
    if not exists(spark, cache_dir):
        spark.createDataFrame([], _CACHE).write.mode("append").parquet(f"{cache_dir}/batch=none")
    kept = spark.read.schema(_CACHE).parquet(cache_dir).select("tokenizer", "digest", "n_tokens").filter(F.col("tokenizer") == version)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            counts = np.fromiter((len(ids) for ids in encoder.ids(batch.column("text"))), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts)], ["digest", "n_tokens"])

    return run


def fill_cache(texts: DataFrame, tokenizer_path: str, cache_dir: str) -> int:
    """Encode the distinct values of ``text`` that the cache lacks, append their counts, and say how many there were.

    A lost executor only repeats its tasks: Spark commits an append once.
    """
    version = tokenizer_digest(tokenizer_path)
    spark = texts.sparkSession
    content = F.coalesce(F.col("text"), F.lit(""))
    # Copies of a text fall together before the shuffle, so a text that fills a third of the table costs no more.
    distinct = texts.select(content.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256))).dropDuplicates(["digest"])
    missing = distinct.join(open_cache(spark, cache_dir, version), "digest", "left_anti")
    counted = missing.select("digest", "text").mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    watch = Observation()
    counted.observe(watch, F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.parquet(f"{cache_dir}/batch={uuid.uuid4().hex}")
    return int(watch.get.get("n") or 0)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens`` of the whole text, and ``cached``: whether
    the cache knew the text before this call.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and ids each give a row; a null id stays null; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "token-counts")
    content = F.coalesce(F.col("text"), F.lit(""))
    keyed = scratch.keep(docs.select(id_col, F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest")), "keyed")
    before = scratch.keep(open_cache(spark, cache_dir, version).select("digest"), "before")
    fill_cache(docs, tokenizer_path, cache_dir)
    known = open_cache(spark, cache_dir, version).join(before.withColumn("cached", F.lit(True)), "digest", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    # A text that fills a large share of the table would meet the cache in one task; such texts are few, so they are broadcast.
    counts = scratch.keep(keyed.groupBy("digest").count(), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(scratch.keep(counts.filter(F.col("count") * HOT_SHARE >= F.greatest(F.lit(total), F.lit(HOT_SHARE * 100))).select("digest").join(known, "digest"), "hot"))
    rest = keyed.join(hot.select("digest"), "digest", "left_anti").join(known, "digest", "left")
    columns = [id_col, "n_bytes", "n_tokens", "cached"]
    scratch.drop("counts")
    return rest.select(*columns).union(keyed.join(hot, "digest").select(*columns))


def default_cache(spark: SparkSession, name: str = "shared") -> str:
    """A cache folder that calls of a cluster share."""
    return f"{shared_root(spark)}/tidemark-token-cache-{name}"
