"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage without depending on any executor: a lost executor makes
    Spark reread files, never recompute or lose cached blocks.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch at most; a batch is held by the JVM and by the Python worker, on both ways.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` after the package has been shipped to the Python workers and the session's Arrow batches
    have been bounded for rows that are whole texts.  A session that sets smaller batches keeps them."""
    spark = df.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; a null id counts as remainder null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def reserve(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name
