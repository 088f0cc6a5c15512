"""Small helpers shared by operators: ordering, top-n, partition counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """ORDER BY ... [LIMIT n]; None keeps every row (O2).

    A limit after a sort plans as TakeOrderedAndProject: each task keeps its
    own n best rows, so no full sort and no single-task collection happens.
    """
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


#: Bytes that one written partition should hold.
PARTITION_BYTES = 256 << 20


def partitions_for(n_bytes: int | None) -> int:
    """Number of partitions of about PARTITION_BYTES each."""
    return max(1, -(-int(n_bytes or 0) // PARTITION_BYTES))


def input_bytes(spark, paths: list[str]) -> int:
    """Total size of files, from a listing only (no contents are read)."""
    sizes = spark.read.format("binaryFile").load(paths).select("length")
    return int(sizes.agg(F.sum("length")).first()[0] or 0)


def map_in_pandas(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInPandas`` after making sure executors can import ``seqlake``."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    return df.mapInPandas(fn, schema)


def map_in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` after making sure executors can import ``seqlake``."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written now below the shared checkpoint folder and read again, so that every use of it reads these
    rows instead of computing them anew.  For small tables that a plan uses more than once."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
