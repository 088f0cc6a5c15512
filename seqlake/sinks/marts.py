"""Analytics marts (M1): the dashboard's pre-aggregated tables as parquet.

Instead of one query per (source, level), (dimension) and (field, level) --
51 separate scans -- each family is computed in one scan in long format and
written once, partitioned by its selector column so a reader prunes to one
slice.  For several marts the wide table is filtered/projected once and persisted for the
duration of the build (recomputed from lineage if an executor is lost).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators.catalog import overview_metrics
from ..operators.tables import GENOME_COLUMNS

# Annotation fields of the dashboard (column names compare without case).
MART_FIELDS = ("emapper_COG_category", "emapper_KEGG_Pathway", "emapper_PFAMs", "emapper_Description")
MART_NAMES = ("overview", "taxonomy", "environment", "genome_statistics", "annotations", "cluster_summary")


def build_marts(seqs: DataFrame, root: str, annotation_fields: list[str] | None = None,
                metadata: DataFrame | None = None, cluster_limit: int = 1000,
                names: tuple[str, ...] = MART_NAMES) -> dict[str, str]:
    """M1: the marts in ``names`` below ``root``; returns their paths.  An unknown annotation field raises."""
    known = {c.lower(): c for c in seqs.columns}
    fields = annotation_fields or list(MART_FIELDS)
    missing = [f for f in fields if f.lower() not in known]
    if missing:
        raise ValueError(f"no such annotation fields: {', '.join(missing)}")
    # only what the marts read is persisted: no sequences, no vectors
    used = {c.lower() for c in (*GENOME_COLUMNS, *fields, "gid", "dataset_id", "seq_type", "length", "gc_content")}
    cols = [c for c in seqs.columns if c.lower() in used]
    slim = seqs.select(*cols)
    shared = len(set(names) & set(MART_NAMES)) > 1
    if shared:  # a single mart reads its own columns, once
        slim = slim.persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    try:
        def write(name: str, make, partition: str | None = None):
            if name not in names:
                return
            w = make().write.mode("overwrite")
            if partition:
                w = w.partitionBy(partition)
            path = f"{root.rstrip('/')}/{name}"
            w.parquet(path)
            out[name] = path

        write("overview", lambda: overview_metrics(slim))
        write("taxonomy", lambda: an.taxonomy_all_levels(slim), "source")
        write("environment", lambda: an.environment_all_dimensions(slim), "dimension")
        write("genome_statistics", lambda: an.genome_statistics(slim, metadata))
        write("annotations", lambda: an.annotation_matrix_all(slim, fields), "field")
        # always recomputed (the reference reads this one through its own cache)
        write("cluster_summary", lambda: an.cluster_summary(slim, cluster_limit))
    finally:
        if shared:
            slim.unpersist()
    return out


def taxonomy_from_mart(mart: DataFrame, source: str, level: str, n: int | None = 25) -> DataFrame:
    """Read-through slice of the taxonomy mart in the distribution's schema."""
    d = mart.filter((F.col("source") == source) & (F.col("level") == level)).select("label", "genomes")
    d = d.orderBy(F.col("genomes").desc(), F.col("label"))
    return d if n is None else d.limit(n)
