"""Catalogue lookups and summary statistics over the wide ``sequences`` table.

P1-P3, P6-P8 (lookups), A1-A7 (stats), A19-A23 (coverage/breakdowns).
All are narrow projections + filters (pushed to the parquet scan) or
two-phase aggregates (partial aggregation map-side, then one small shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import top

# columns of the per-record sequence table (the non-genome part of the view)
RECORD_COLUMNS = ["gid", "dataset_id", "header", "seq_type", "length", "gc_content", "sequence"]


def dataset_of_gid(gid: str) -> str | None:
    return gid.split("|", 1)[0] if "|" in gid else None


def lookup_gid(seqs: DataFrame, gid: str, columns: list[str] | None = None) -> DataFrame:
    """The record with this gid (0 or 1 row).

    The dataset id is the gid prefix; filtering on it too lets a lake sorted by
    (dataset_id, gid) skip row groups by min/max statistics.
    """
    cond = F.col("gid") == F.lit(gid)
    ds = dataset_of_gid(gid)
    if ds is not None:
        cond = cond & (F.col("dataset_id") == F.lit(ds))
    return seqs.filter(cond).select(*(columns or RECORD_COLUMNS)).limit(1)


def by_dataset(seqs: DataFrame, dataset_id: str, seq_type: str | None = None,
               limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Records of one genome, optionally one type, optionally the first n by gid."""
    cond = F.col("dataset_id") == F.lit(dataset_id)
    if seq_type:
        cond = cond & (F.col("seq_type") == F.lit(seq_type))
    out = seqs.filter(cond).select(*(columns or RECORD_COLUMNS))
    return out if limit is None else top(out, limit, F.col("gid"))


def sequences_of_type(seqs: DataFrame, seq_type: str, dataset_id: str | None = None,
                      columns: list[str] | None = None) -> DataFrame:
    """Every record of one type (optionally one genome)."""
    cond = F.col("seq_type") == F.lit(seq_type)
    if dataset_id:
        cond = cond & (F.col("dataset_id") == F.lit(dataset_id))
    return seqs.filter(cond).select(*(columns or RECORD_COLUMNS))


def annotated_sample(seqs: DataFrame, n: int = 5, field: str = "emapper_description") -> DataFrame:
    """First n representative proteins with an annotation (sampling operator)."""
    return top(seqs.filter((F.col("seq_type") == "AA") & F.col("is_skani_representative")
                           & F.col(field).isNotNull())
               .select("gid", "dataset_id", "orthogroup_id", F.col(field)),
               n, F.col("gid"))


def genomes_in_order(seqs: DataFrame, order: str) -> DataFrame:
    """Distinct genomes whose phylogeny order equals ``order``."""
    return seqs.filter(F.col("order") == F.lit(order)).select("dataset_id", "common_name").distinct()


def high_quality_genomes(seqs: DataFrame, min_completeness: float = 90.0, n: int = 50) -> DataFrame:
    """Genomes above a completeness, best first, top n (a top-k report)."""
    g = (seqs.filter(F.col("order_completeness") > F.lit(min_completeness))
         .groupBy("dataset_id")
         .agg(F.max("order_completeness").alias("order_completeness"),
              F.max("lenbp").alias("lenbp")))
    return top(g, n, F.col("order_completeness").desc(), F.col("dataset_id"))


# ---------------------------------------------------------------- statistics


def count_by_seq_type(seqs: DataFrame) -> DataFrame:
    """A2."""
    return seqs.groupBy("seq_type").agg(F.count(F.lit(1)).alias("n_sequences"))


def top_datasets(seqs: DataFrame, n: int = 10) -> DataFrame:
    """A3: genomes with most records (ties broken by id)."""
    g = seqs.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_sequences"))
    return top(g, n, F.col("n_sequences").desc(), F.col("dataset_id"))


def stats(seqs: DataFrame) -> DataFrame:
    """A1, A4, A5, A6 in one pass: one row."""
    return seqs.agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.countDistinct("dataset_id").alias("unique_genomes"),
        F.sum(F.col("length").cast("long")).alias("total_bases"),
        F.coalesce(F.avg(F.when(F.col("seq_type") == "NT", F.col("gc_content"))), F.lit(0.0)).alias("avg_gc"),
    )


def total_bases(seqs: DataFrame) -> DataFrame:
    """A5: total residues over NT and AA together."""
    return seqs.agg(F.sum(F.col("length").cast("long")).alias("total_bases"))


def avg_gc(seqs: DataFrame) -> DataFrame:
    """Mean GC over nucleotide records, 0.0 when none."""
    return seqs.agg(F.coalesce(F.avg(F.when((F.col("seq_type") == "NT") & F.col("gc_content").isNotNull(),
                                              F.col("gc_content"))), F.lit(0.0)).alias("avg_gc"))


def overview_metrics(seqs: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of overview counts.

    The distinct counts are over genome-level columns (constant per genome in
    the catalogue contract), so the records are first reduced to one row per
    genome -- a partial aggregate keyed by dataset_id that also carries the
    record count and the GC sum -- and the distinct counts run on that tiny
    table.  Several COUNT DISTINCTs over the records would instead plan an
    Expand that copies every record once per distinct aggregate.
    ``approximate=True`` uses HyperLogLog sketches on the genome rows.
    """
    return overview_of(overview_state(seqs), approximate)


def overview_state(seqs: DataFrame) -> DataFrame:
    """What the overview needs of every genome: records, GC sum and count of nucleotide records, three labels."""
    nt_gc = F.when((F.col("seq_type") == "NT") & F.col("gc_content").isNotNull(), F.col("gc_content"))
    return seqs.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(nt_gc.cast("double")).alias("_gc_sum"),
        F.count(nt_gc).alias("_gc_n"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("taxonomy_majority", "gvclass_species", "s_cluster")])


def overview_of(per_genome: DataFrame, approximate: bool = False) -> DataFrame:
    """The overview's row from one row per genome."""
    cd = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    return per_genome.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_sequences"),
        F.count("dataset_id").alias("unique_genomes"),
        cd("taxonomy_majority").alias("taxonomy_labels"),
        cd("gvclass_species").alias("gvclass_species"),
        cd("s_cluster").alias("ani_clusters"),
        F.coalesce(F.sum("_gc_sum") / F.sum("_gc_n"), F.lit(0.0)).alias("avg_gc_nt"),
    )


def orthogroup_coverage(seqs: DataFrame) -> DataFrame:
    """Proteins with an orthogroup, singletons, and neither."""
    aa = seqs.filter(F.col("seq_type") == "AA")
    return aa.agg(
        F.count(F.lit(1)).alias("total_proteins"),
        F.count("orthogroup_id").alias("with_orthogroup"),
        F.count_if(F.coalesce(F.col("is_singleton"), F.lit(False))).alias("singletons"),
        F.count_if(F.col("orthogroup_id").isNull() & F.col("is_singleton").isNull()).alias("no_assignment"),
    )


ANNOTATION_FIELDS = ["emapper_cog_category", "emapper_description", "emapper_pfams", "emapper_kegg_pathway"]


def annotation_coverage(seqs: DataFrame, fields: list[str] = ANNOTATION_FIELDS) -> DataFrame:
    """Proteins and non-null count per annotation field."""
    aa = seqs.filter(F.col("seq_type") == "AA")
    return aa.agg(F.count(F.lit(1)).alias("total_proteins"),
                  *[F.count(f).alias(f"with_{f.removeprefix('emapper_')}") for f in fields])


def top_cog(seqs: DataFrame, n: int = 10, field: str = "emapper_cog_category") -> DataFrame:
    """Most frequent COG categories among proteins."""
    g = (seqs.filter((F.col("seq_type") == "AA") & F.col(field).isNotNull())
         .groupBy(F.col(field).alias("cog_category")).agg(F.count(F.lit(1)).alias("n_proteins")))
    return top(g, n, F.col("n_proteins").desc(), F.col("cog_category"))


def representative_breakdown(seqs: DataFrame) -> DataFrame:
    """Records by (representative flag, type)."""
    return (seqs.groupBy("is_skani_representative", "seq_type")
            .agg(F.count(F.lit(1)).alias("n_sequences"))
            .orderBy(F.col("is_skani_representative").asc_nulls_last(), "seq_type"))


def genome_size_by_order(seqs: DataFrame) -> DataFrame:
    """Genome size per (genome, order), nucleotide records only."""
    return (seqs.filter(F.col("seq_type") == "NT")
            .groupBy("dataset_id", "order").agg(F.max("lenbp").alias("genome_size")))
