"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes the documents that the stage before kept and returns documents with the same columns; the
last one returns packed pieces.  ``run`` writes every stage's result as Parquet in the shared folder
and rereads it, so a lost executor never costs more than the stage that is running.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import decontam, langid, packing, secret_scan, simhash
from seqlake.llm.common import reserve, written

#: Documents whose predicted language is less likely than this, or that have no letter, are rejected.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from the training ids among ``docs``."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id (one of rows that repeat it)."""
    keep = simhash.survivors(simhash.near_duplicates(docs, shingle=4, radius=4))
    fp, key = reserve(docs, "fp"), reserve(docs, "id_key")
    no_id = F.lit(-(1 << 63))
    printed = simhash.with_fingerprint(docs, 4, "text", fp).withColumn(key, F.coalesce("doc_id", no_id))
    keep = keep.select(F.coalesce("keep_id", no_id).alias("keep_id"), "keep_fp")
    kept = printed.join(keep, (F.col(key) == F.col("keep_id")) & (F.col(fp) == F.col("keep_fp")), "left_semi")
    return kept.dropDuplicates([key, fp]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` adjusted."""
    return secret_scan.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, spaced=True)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens", "padded_length", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
    ("secret scans", secrets), ("packing", pack)]

#: Learned languages, 64-bit shingle hashes, components and token ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
