"""Marts as mergeable state of a versioned lake.

Every mart is a function of a few aggregates per genome.  These are computed once per lake commit, from the
commit's records alone, and never change; the state of a version is the rows of its live (genome, commit) pairs.
So the states of two commits add up to the state of both, a refresh reads only commits that it has not seen, and
the marts of any version come from genome rows, without a record of the lake.

    <state>/genomes/commit=<id>/       one row per genome and sequence type
    <state>/annotations/commit=<id>/   proteins per genome, lineage, field and value
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators.catalog import overview_of
from ..operators.snapshots import manifest
from ..operators.tables import GENOME_COLUMNS
from ..schemas import LAKE_SCHEMA
from ..sources.lake import path_exists
from .marts import MART_FIELDS


def genome_state(seqs: DataFrame) -> DataFrame:
    """One row per genome and sequence type: records, GC sum and count, genome columns."""
    gc = F.when(F.col("seq_type") == "NT", F.col("gc_content"))
    cols = [c for c in GENOME_COLUMNS if c.lower() in {x.lower() for x in seqs.columns}]
    return seqs.groupBy("dataset_id", "seq_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum(gc.cast("double")).alias("gc_sum"), F.count(gc).alias("gc_n"),
        *[F.first(c, ignorenulls=True).alias(c) for c in cols])


def refresh_state(spark: SparkSession, lake_root: str, state_root: str, fields: tuple[str, ...] = MART_FIELDS) -> list[str]:
    """Add the state of the commits that the newest version needs and the state lacks; returns their names."""
    names = sorted(r["commit"] for r in manifest(spark, lake_root).select("commit").distinct().collect())
    added = []
    for name in names:
        folder = f"{lake_root}/commits/commit={name}"
        if path_exists(spark, f"{state_root}/annotations/commit={name}/_SUCCESS") or not path_exists(spark, f"{folder}/_SUCCESS"):
            continue
        seqs = spark.read.schema(LAKE_SCHEMA).parquet(folder)
        # the annotations are written last: their _SUCCESS says that both are there
        genome_state(seqs).write.mode("overwrite").parquet(f"{state_root}/genomes/commit={name}")
        an.annotation_counts(seqs, list(fields), by=("dataset_id",)).write.mode("overwrite").parquet(
            f"{state_root}/annotations/commit={name}")
        added.append(name)
    return added


def live_state(spark: SparkSession, lake_root: str, state_root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(genomes, annotations) of a version of the lake (default: the newest)."""
    live = manifest(spark, lake_root, version)
    names = sorted(r["commit"] for r in live.select("commit").distinct().collect())

    def table(kind: str) -> DataFrame:
        base = f"{state_root}/{kind}"
        paths = [p for p in (f"{base}/commit={n}" for n in names) if path_exists(spark, f"{p}/_SUCCESS")]
        if not paths:
            raise ValueError("no state for this version: refresh it first")
        return spark.read.option("basePath", base).option("mergeSchema", True).parquet(*paths) \
                    .join(live, ["dataset_id", "commit"], "left_semi").drop("commit")

    return table("genomes"), table("annotations")


def marts_of_state(genomes: DataFrame, annotations: DataFrame, metadata: DataFrame | None = None,
                   cluster_limit: int = 1000) -> dict[str, DataFrame]:
    """The marts of :func:`.marts.build_marts` by name."""
    labels = ("taxonomy_majority", "gvclass_species", "s_cluster")
    per_genome = genomes.groupBy("dataset_id").agg(
        F.sum("records").alias("_rows"), F.sum("gc_sum").alias("_gc_sum"), F.sum("gc_n").alias("_gc_n"),
        *[F.first(c, ignorenulls=True).alias(c) for c in labels])
    return {
        "overview": overview_of(per_genome),
        "taxonomy": an.taxonomy_all_levels(genomes),
        "environment": an.environment_all_dimensions(genomes, weight="records"),
        "genome_statistics": an.genome_statistics(genomes, metadata),
        "annotations": an.matrix_of_counts(annotations),
        "cluster_summary": an.cluster_summary(genomes, cluster_limit, weight="records"),
    }


#: The column that a mart's folders are named by.
_SELECTORS = {"taxonomy": "source", "environment": "dimension", "annotations": "field"}


def refresh_marts(spark: SparkSession, lake_root: str, state_root: str, marts_root: str, cluster_limit: int = 1000,
                  metadata: DataFrame | None = None) -> list[str]:
    """Bring state and marts up to the lake's newest version; returns the commits that were read."""
    added = refresh_state(spark, lake_root, state_root)
    for name, df in marts_of_state(*live_state(spark, lake_root, state_root), metadata, cluster_limit).items():
        out = df.write.mode("overwrite")
        if name in _SELECTORS:
            out = out.partitionBy(_SELECTORS[name])
        out.parquet(f"{marts_root}/{name}")
    return added
