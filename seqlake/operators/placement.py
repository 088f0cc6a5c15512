"""Genome placement (V9, F12): where does a query genome sit in the catalogue?

Per query genome: the closest genome by TNF (longest contig per catalogue
genome vs the query's genome-level TNF) and the closest by estimated ANI,
then a band: >=95 species, >=90 genus, else distant; no ANI hit -> novel.
Both parts can be skipped.  Everything is per-query aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .kmers import genome_tnf, tnf_136
from .metric_index import nearest_indexed
from .search import StoredSketch, ani_estimate, sketch
from .similarity import longest_contig, nearest, without_self

TNF_CANDIDATE_COLS = ["dataset_id", "gid", "contig_length", "lenbp", "gcperc", "common_name", "phylum",
                      "order", "taxonomy_majority", "s_cluster", "skani_rep"]


META_COLS = ["lenbp", "gcperc", "common_name", "phylum", "order", "taxonomy_majority", "s_cluster", "skani_rep"]


def genome_meta(seqs: DataFrame) -> DataFrame:
    """One row per genome with the columns placement reports (partial aggregate).
    Built identically wherever it is needed so Spark can reuse the exchange."""
    return seqs.select("dataset_id", *META_COLS).groupBy("dataset_id") \
               .agg(*[F.first(c, ignorenulls=True).alias(c) for c in META_COLS])


def tnf_candidates(seqs: DataFrame, dataset_filter: str | None = None, genomes: DataFrame | None = None,
                   contigs: DataFrame | None = None) -> DataFrame:
    """Longest contig per genome with its TNF and genome metadata.

    With the stored tables ``genomes`` and ``contigs`` (the ``tnf`` table) no
    record of the catalogue is read; else stored vectors are used when the
    catalogue has them, or they are computed for the selected contigs only."""
    if contigs is not None:
        best = longest_contig(contigs, dataset_filter)
        vec = contigs.select("gid", "tnf_136").join(best.select("gid"), "gid", "left_semi")
        meta = genome_meta(seqs) if genomes is None else genomes.select("dataset_id", *META_COLS)
        return best.join(vec, "gid").join(meta, "dataset_id")
    best = stored(longest_contig(seqs, dataset_filter), "longest-contigs")  # one row per genome, used twice
    if "tnf_136" in seqs.columns:  # vectors stored in the lake at ingest
        vec = seqs.select("gid", "tnf_136").join(best.select("gid"), "gid", "left_semi")
    else:
        contigs = seqs.select("gid", "sequence").join(best.select("gid"), "gid", "left_semi")
        vec = tnf_136(contigs).select("gid", F.col("tnf_136"))
    return best.join(vec, "gid").join(genome_meta(seqs), "dataset_id")


def nearest_by_tnf(query_vectors: DataFrame, seqs: DataFrame, metric: str = "cosine", k: int = 10,
                   dataset_filter: str | None = None, exclude_self: bool = False,
                   genomes: DataFrame | None = None, contigs: DataFrame | None = None,
                   index: str | None = None) -> DataFrame:
    """V7: (query_id, tnf_136) vectors -> top-k catalogue genomes by TNF distance.

    ``index`` is a stored metric index (:mod:`.metric_index`) of :func:`tnf_candidates` with the same metric; with
    it nothing else is read, and ``seqs`` may be None.
    """
    wanted = k if not exclude_self else k + 1
    vectors = query_vectors.select("query_id", F.col("tnf_136").alias("vector"))
    if index is not None:
        res = nearest_indexed(vectors, index, wanted, order_cols=("dataset_id",), distance_col="tnf_distance")
    else:
        cand = tnf_candidates(seqs, dataset_filter, genomes, contigs)
        res = nearest(vectors, cand.withColumnRenamed("tnf_136", "vector"), k=wanted, metric=metric,
                      order_cols=("dataset_id",), distance_col="tnf_distance")
    if exclude_self:
        res = without_self(res, k, "query_id", "dataset_id", "tnf_distance", ("dataset_id",))
    return res.withColumn("tnf_distance", F.greatest(F.col("tnf_distance"), F.lit(0.0)))


def place_genome(query_seqs: DataFrame, seqs: DataFrame, metric: str = "cosine", k: int = 20,
                 min_ani: float = 80.0, skip_tnf: bool = False, skip_ani: bool = False,
                 exclude_self: bool = False, ani_k: int = 16, ani_c: int = 1000,
                 genomes: DataFrame | None = None, contigs: DataFrame | None = None,
                 ref_sketch: DataFrame | StoredSketch | None = None) -> DataFrame:
    """V9: one placement row per query genome.

    ``query_seqs``: (query_id, gid, sequence) NT contigs of the query genomes.
    ``genomes``, ``contigs`` and ``ref_sketch`` are the stored tables of
    ``tables.write_tables``; with all three, ``seqs`` may be None and no reference
    sequence is read.  A query too short to have a sampled k-mer has no
    evidence about its lineage and is reported as such.
    """
    if not skip_tnf:
        qv = stored(genome_tnf(query_seqs.select(F.col("query_id"), "gid", "sequence"), genome_col="query_id"), "query-tnf")
        out = qv.select("query_id")  # every query genome has a (possibly all-zero) vector
        tn = nearest_by_tnf(qv, seqs, metric, k, exclude_self=exclude_self, genomes=genomes,
                            contigs=contigs).filter(F.col("rank") == 1)
        out = out.join(tn.select("query_id", F.col("dataset_id").alias("tnf_top_match"),
                                 F.col("tnf_distance"), F.col("taxonomy_majority").alias("tnf_taxonomy"),
                                 (F.lit(1.0) - F.col("tnf_distance")).alias("tnf_similarity")),
                       "query_id", "left")
    else:
        out = query_seqs.select("query_id").distinct()
    if not skip_ani:
        refs = None
        if ref_sketch is None:
            refs = seqs.filter(F.col("seq_type") == "NT").select("dataset_id", "sequence")
        query_sketch = stored(sketch(query_seqs.select("query_id", "sequence"), "query_id", ani_k, ani_c), "query-sketch")
        ani = ani_estimate(query_seqs.select("query_id", "sequence"), refs, ani_k, ani_c, min_ani, ref_sketch=ref_sketch,
                           query_sketch=query_sketch)
        if exclude_self:
            ani = ani.filter(F.col("query_id") != F.col("dataset_id"))
        clusters = (genome_meta(seqs) if genomes is None else genomes).select("dataset_id", "s_cluster")
        best = (ani.groupBy("query_id")
                .agg(F.min_by(F.struct("dataset_id", "ani"),
                              F.struct((-F.col("ani")).alias("a"), F.col("dataset_id").alias("d"))).alias("b"))
                .select("query_id", F.col("b.dataset_id").alias("ani_top_match"), F.col("b.ani").alias("ani"))
                .join(clusters.withColumnRenamed("dataset_id", "ani_top_match"), "ani_top_match", "left")
                .withColumnRenamed("s_cluster", "ani_cluster"))
        sketched = query_sketch.select("query_id").distinct().withColumn("_sketched", F.lit(True))
        out = out.join(best, "query_id", "left").join(sketched, "query_id", "left")
        band = (F.when(F.col("_sketched").isNull(), F.lit("no sampled k-mers - lineage not assessed"))
                .when(F.col("ani").isNull(), F.lit("no close ANI match - likely novel lineage"))
                .when(F.col("ani") >= 95, F.lit("species-level match"))
                .when(F.col("ani") >= 90, F.lit("genus-level similarity"))
                .otherwise(F.lit("distant relationship")))
        out = out.withColumn("placement", band).drop("_sketched")
    return out
