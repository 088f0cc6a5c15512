"""Versioned lake: per-genome replacement by atomic commits.

A commit writes the records of its genomes into a folder of its own and never touches another's.  A
version is one small file that names a manifest: which commit holds each genome's records.  Publishing
replaces the genomes of a commit in the newest manifest and creates the next version's file if no other writer
did; the loser of a race starts again from the winner's manifest.  Readers of a version see it as long as its
commits are kept; a write that fails before its version file exists changes nothing.

    <root>/commits/commit=<id>/seq_type=.../part-*   records
    <root>/manifests/<id>/part-*                     (dataset_id, commit)
    <root>/versions/<number>                         name of the version's manifest
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LAKE_SCHEMA
from ..sources.lake import path_exists

MANIFEST = "dataset_id string, commit string"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with ``text``; False, and nothing changed, if there is one.

    The file is written under another name and moved into place whole: by a hard link on a local file
    system, else by a rename, which HDFS refuses when the target exists.
    """
    target, fs = _place(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    temporary, _ = _place(spark, aside)
    out = fs.create(temporary, False)
    out.write(text.encode())
    out.close()
    if fs.getScheme() == "file":
        try:
            os.link(temporary.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(temporary, False)
    if not fs.exists(target) and fs.rename(temporary, target):
        return True
    fs.delete(temporary, False)
    return False


def _read(spark: SparkSession, path: str) -> str:
    place, fs = _place(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    pattern, fs = _place(spark, f"{root}/versions/*")
    names = [f.getPath().getName() for f in fs.globStatus(pattern) or []]
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, root: str, folder: str, schema, version: int | None = None) -> DataFrame:
    """The table of a version (default: the newest), of those below ``folder``; empty before the first."""
    known = versions(spark, root)
    if version is None and not known:
        return spark.createDataFrame([], schema)
    if version is not None and version not in known:
        raise ValueError(f"no version {version}")
    name = _read(spark, f"{root}/versions/{known[-1] if version is None else version:08d}")
    return spark.read.schema(schema).parquet(f"{root}/{folder}/{name}")


def publish(spark: SparkSession, root: str, folder: str, schema, change: Callable[[DataFrame], DataFrame]) -> int:
    """Make ``change`` of the newest table the next version; returns its number.

    A writer that another one overtakes applies its change to the other's table.
    """
    while True:
        known = versions(spark, root)
        number, name = (known[-1] if known else 0) + 1, uuid.uuid4().hex
        table = current(spark, root, folder, schema, known[-1]) if known else current(spark, root, folder, schema)
        change(table).write.option("compression", "zstd").parquet(f"{root}/{folder}/{name}")
        place, fs = _place(spark, f"{root}/versions")
        fs.mkdirs(place)
        if create_if_absent(spark, f"{root}/versions/{number:08d}", name):
            return number


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(dataset_id, commit) of a version (default: the newest); empty before the first."""
    return current(spark, root, "manifests", MANIFEST, version)


def commit_genomes(spark: SparkSession, root: str, genomes: DataFrame, write: Callable[[str], None]) -> int:
    """Replace the records of ``genomes`` (column dataset_id) by what ``write`` puts into the folder that it is given.

    Genomes of the commit without records end up with none.  Returns the version.
    """
    name = uuid.uuid4().hex
    write(f"{root}/commits/commit={name}")
    own = f"{root}/commits/genomes-{name}"
    genomes.select("dataset_id").where("dataset_id is not null").distinct().write.parquet(own)
    batch = spark.read.schema("dataset_id string").parquet(own)
    return publish(spark, root, "manifests", MANIFEST, lambda table: table.join(batch, "dataset_id", "left_anti").unionByName(
        batch.withColumn("commit", F.lit(name))))


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The lake as of a version (default: the newest), with the lake's columns.

    Only commits that still hold a genome are listed and read; the genome-level manifest keeps the rest of
    their records out.
    """
    live = manifest(spark, root, version)
    names = sorted(r["commit"] for r in live.select("commit").distinct().collect())
    base = f"{root}/commits"
    paths = [f"{base}/commit={n}" for n in names if path_exists(spark, f"{base}/commit={n}/_SUCCESS")]
    if not paths:
        return spark.createDataFrame([], LAKE_SCHEMA)
    rows = spark.read.schema(f"{LAKE_SCHEMA}, commit string").option("basePath", base).parquet(*paths)
    return rows.join(live, ["dataset_id", "commit"], "left_semi").select(
        *[f"`{f.name}`" for f in spark.createDataFrame([], LAKE_SCHEMA).schema.fields])


def compact(spark: SparkSession, root: str, write: Callable[[DataFrame, str], None]) -> int:
    """Rewrite all live records into one commit; genomes that others replace meanwhile stay replaced."""
    seen = manifest(spark, root).withColumnRenamed("commit", "old")
    name = uuid.uuid4().hex
    write(read_snapshot(spark, root), f"{root}/commits/commit={name}")
    return publish(spark, root, "manifests", MANIFEST, lambda table: table.join(seen, "dataset_id", "left").select(
        "dataset_id", F.when(F.col("commit") == F.col("old"), F.lit(name)).otherwise(F.col("commit")).alias("commit")))
