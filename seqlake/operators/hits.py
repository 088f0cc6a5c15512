"""Search hits: filters, join-back to the catalogue, extraction, summaries
(P4, P5, J1-J5, W2, A24-A27).

Join-backs first reduce the catalogue to the distinct ids present in the
hits (a LEFT SEMI join, which the planner broadcasts when the id set is
small and otherwise shuffles; runtime bloom filters prune the catalogue scan
either way) and only then attach metadata to the hits.  No IN-list is built
on the driver, so the hit set has no size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, top

# Metadata attached to protein hits (target length renamed).
PROTEIN_META = ["gid", "dataset_id", "length", "common_name", "phylum", "class", "order", "family",
                "genus", "ecosystem", "habitat"]
# Genome columns attached to ANI hits.
GENOME_META = ["dataset_id", "common_name", "domain", "phylum", "class", "order", "family", "genus",
               "gvclass_phylum", "gvclass_class", "gvclass_order", "gvclass_family", "gvclass_genus",
               "taxonomy_majority", "gvclass_species", "s_cluster", "skani_rep", "is_skani_representative",
               "pdm_cluster", "mcl_rep", "ecosystem", "ecosystem_category", "ecosystem_type", "ecosystem_subtype",
               "habitat", "source", "lenbp", "genecount", "gcperc", "codingperc", "order_completeness",
               "order_confidence_score"]


def evalue_filter(hits: DataFrame, max_evalue: float = 1e-5) -> DataFrame:
    """P4."""
    return hits.filter(F.col("evalue") <= F.lit(max_evalue))


def ani_filter(hits: DataFrame, min_ani: float = 80.0) -> DataFrame:
    """P5."""
    return hits.filter(F.col("ANI") >= F.lit(min_ani))


def top_hits_per_query(hits: DataFrame, n: int = 100, query_col: str = "qseqid",
                       score_col: str = "bitscore", target_col: str = "sseqid") -> DataFrame:
    """Best n targets per query (score desc, target id asc).

    ``row_number <= n`` plans a partial WindowGroupLimit before the shuffle, so
    even a query with a third of all hits sends only n rows per task.
    """
    w = Window.partitionBy(query_col).orderBy(F.col(score_col).desc(), F.col(target_col))
    return hits.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= n)


def enrich_protein_hits(hits: DataFrame, seqs: DataFrame, id_col: str = "sseqid",
                        seq_type: str | None = None, meta_cols: list[str] = PROTEIN_META) -> DataFrame:
    """Hits LEFT JOIN record metadata on the target id; the record
    ``length`` becomes ``target_length`` so it cannot collide with the hit's
    alignment length."""
    ids = hits.select(F.col(id_col).alias("gid")).distinct()
    cat = seqs if seq_type is None else seqs.filter(F.col("seq_type") == F.lit(seq_type))
    meta = (cat.select(*meta_cols).join(ids, "gid", "left_semi")
            .withColumnRenamed("length", "target_length").withColumnRenamed("gid", "_meta_gid"))
    # join on a uniquely named key and drop it by name (hits and ids share
    # lineage, so a column-reference drop could miss a re-aliased attribute)
    return hits.join(meta, hits[id_col] == F.col("_meta_gid"), "left").drop("_meta_gid")


def genome_of_ref(ref_col: str = "Ref_name"):
    """Genome id of an ANI reference name: the part before the first bar."""
    return F.substring_index(F.col(ref_col), "|", 1)


def genomes_of(seqs: DataFrame, ids: DataFrame, cols: list[str] = GENOME_META) -> DataFrame:
    """Distinct genome rows of the catalogue for the given dataset ids."""
    return (seqs.select(*cols).join(ids, "dataset_id", "left_semi")
            .groupBy("dataset_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols if c != "dataset_id"]))


def enrich_ani_hits(hits: DataFrame, seqs: DataFrame, min_ani: float | None = 80.0,
                    metadata_cols: list[str] | None = None, max_results: int | None = None) -> DataFrame:
    """ANI hits (>= min_ani) with their reference genome's metadata,
    best ANI first; ``max_results`` keeps the top rows only."""
    h = hits if min_ani is None else ani_filter(hits, min_ani)
    h = h.withColumn("dataset_id", genome_of_ref())
    cols = ["dataset_id", *(metadata_cols or [c for c in GENOME_META if c != "dataset_id"])]
    meta = genomes_of(seqs, h.select("dataset_id").distinct(), cols)
    out = h.join(meta, "dataset_id", "left")
    if max_results is None:
        return out  # aggregates need no sort; ``max_results`` orders best ANI first
    return top(out, max_results, F.col("ANI").desc(), F.col("Query_name"), F.col("Ref_name"))


def cluster_hit_counts(enriched: DataFrame, n: int = 5, col: str = "s_cluster") -> DataFrame:
    """Most frequent clusters among the hits."""
    g = enriched.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("hits"))
    return top(g, n, F.col("hits").desc(), F.col(col))


def cluster_membership(enriched: DataFrame, species_threshold: float = 95.0,
                       query_col: str = "Query_name") -> DataFrame:
    """Per query: hit counts, top hit, likely species cluster (mode among
    species-level hits), its representative and phylogenetic cluster, or a
    'no species-level match' message.

    Two partial aggregates over the hits: one per query (counts, best hit,
    representative of the best species-level hit -- ``min_by`` ignores rows
    whose ordering key is null), one per (query, kind, label) for the two
    modes; the per-query results are joined (one row per query each).
    """
    species = F.col("ANI") >= species_threshold
    best_key = F.struct((-F.col("ANI")).alias("a"), F.col("Ref_name").alias("r"))
    per_query = enriched.groupBy(query_col).agg(
        F.count(F.lit(1)).alias("total_hits"),
        F.count_if(species).alias("species_level_matches"),
        F.min_by(F.struct("ANI", "dataset_id", "Ref_name"), best_key).alias("b"),
        F.min_by(F.col("skani_rep"), F.when(species, best_key)).alias("cluster_representative"))
    labels = (enriched.filter(species)
              .select(query_col, F.explode(F.array(
                  F.struct(F.lit("s").alias("kind"), F.col("s_cluster").alias("label")),
                  F.struct(F.lit("p").alias("kind"), F.col("pdm_cluster").alias("label")))).alias("x"))
              .select(query_col, "x.kind", "x.label").filter(F.col("label").isNotNull())
              .groupBy(query_col, "kind", "label").agg(F.count(F.lit(1)).alias("n")))
    modes = (labels.groupBy(query_col)
             .agg(F.min_by(F.struct("label", "n"), F.when(F.col("kind") == "s", F.struct(
                      (-F.col("n")).alias("a"), F.col("label").alias("b")))).alias("ms"),
                  F.min_by(F.col("label"), F.when(F.col("kind") == "p", F.struct(
                      (-F.col("n")).alias("a"), F.col("label").alias("b")))).alias("phylogenetic_cluster")))
    out = per_query.join(modes, query_col, "left")
    msg = F.when(F.col("species_level_matches") == 0,
                 F.concat(F.lit(f"No species-level matches (>={species_threshold:g}% ANI). Top hit: "),
                          F.format_number(F.col("b.ANI"), 2), F.lit("%")))
    return out.select(
        query_col, "total_hits", "species_level_matches",
        F.col("b.ANI").alias("top_match_ani"), F.col("b.dataset_id").alias("top_match_genome"),
        F.col("b.Ref_name").alias("top_match_ref"),
        F.col("ms.label").alias("likely_species_cluster"), F.col("ms.n").alias("species_cluster_genomes"),
        "cluster_representative", "phylogenetic_cluster", msg.alias("message"))


def hit_summary(hits: DataFrame, query_col: str = "qseqid") -> DataFrame:
    """Total hits and distinct queries."""
    return hits.agg(F.count(F.lit(1)).alias("total_hits"), F.countDistinct(query_col).alias("queries"))


# Columns of extracted records.
EXTRACT_COLUMNS = ["gid", "dataset_id", "header", "seq_type", "length", "gc_content", "sequence", "genome",
                   "common_name", "phylum", "class", "order", "family", "genus", "s_cluster", "ecosystem",
                   "ecosystem_category", "ecosystem_type", "habitat", "lenbp", "gcperc", "genecount"]


def extract_hits(hits: DataFrame, seqs: DataFrame, id_col: str = "sseqid", seq_type: str | None = None,
                 columns: list[str] = EXTRACT_COLUMNS) -> DataFrame:
    """Catalogue records whose gid appears in the hits (LEFT SEMI, no size limit)."""
    cat = seqs if seq_type is None else seqs.filter(F.col("seq_type") == F.lit(seq_type))
    ids = hits.select(F.col(id_col).alias("gid"))
    return cat.select(*columns).join(ids, "gid", "left_semi")


def extract_gids(seqs: DataFrame, gids: list[str], seq_type: str | None = None,
                 columns: list[str] = ("gid", "dataset_id", "header", "seq_type", "length", "gc_content",
                                       "sequence")) -> DataFrame:
    """Records for an explicit id list (a literal relation, semi-joined; the planner sees its
    size and picks the join)."""
    spark = seqs.sparkSession
    ids = spark.createDataFrame([(g,) for g in gids], "gid string")
    cat = seqs if seq_type is None else seqs.filter(F.col("seq_type") == F.lit(seq_type))
    return cat.select(*columns).join(ids, "gid", "left_semi")


def export_counts(seqs: DataFrame, seq_type: str | None = None, genome_ids: list[str] | None = None) -> DataFrame:
    """Records per genome that an export writes."""
    df = seqs if seq_type is None else seqs.filter(F.col("seq_type") == F.lit(seq_type))
    if genome_ids:
        df = df.filter(F.col("dataset_id").isin(genome_ids))
    return df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("sequences"))


def seed_search_with_metadata(seed_hits: DataFrame, seqs: DataFrame) -> DataFrame:
    """E3 as one lineage: protein candidate hits joined back to target metadata.  The hits are stored when this is
    called: the join-back reads them twice, and either read would search anew."""
    return enrich_protein_hits(stored(seed_hits, "seed-hits"), seqs, id_col="target_id", seq_type="AA")


def ani_with_metadata(ani: DataFrame, seqs: DataFrame, metadata_cols: list[str] | None = None,
                      max_results: int | None = None) -> DataFrame:
    """E3 for genomes: ANI estimates joined to the reference genome's metadata,
    optionally only the best ``max_results`` (ANI desc)."""
    cols = ["dataset_id", *(metadata_cols or [c for c in GENOME_META if c != "dataset_id"])]
    meta = genomes_of(seqs, ani.select("dataset_id").distinct(), cols)
    out = ani.join(meta, "dataset_id", "left")
    if max_results is None:
        return out
    return top(out, max_results, F.col("ani").desc(), F.col("query_id"), F.col("dataset_id"))
