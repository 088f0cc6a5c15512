"""The Parquet lake as a catalogue (S7) and read-through marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..schemas import LAKE_SCHEMA


def open_catalog(spark: SparkSession, root: str, view: str | None = "sequences",
                 options: dict[str, str] | None = None) -> DataFrame:
    """The lake (local, HDFS, s3a://, gs:// -- whatever the cluster's Hadoop
    configuration can reach) as a DataFrame and, optionally, a temp view.

    ``options`` are passed to the reader; file sources merge them into the
    Hadoop configuration of this read, so object-store settings (for example
    ``fs.s3a.endpoint`` or credentials providers) can be given per catalogue.
    The fixed lake schema is applied (no inference): every column exists, columns
    absent from older files are null, and ``seq_type`` comes back from the
    directory names as a string.
    """
    df = spark.read.schema(LAKE_SCHEMA).options(**(options or {})).option("basePath", root).parquet(root)
    if view:
        df.createOrReplaceTempView(view)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that the path belongs to."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_mart(spark: SparkSession, root: str, name: str, order: list[Column] | None = None,
              n: int | None = None) -> DataFrame | None:
    """A precomputed mart when present (None otherwise), re-sorted, optional top n.

    File order is not a contract in Spark, so the mart is re-ordered by
    ``order`` before the limit.
    """
    path = f"{root.rstrip('/')}/{name}"
    if not path_exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if order:
        df = df.orderBy(*order)
    return df if n is None else df.limit(n)
