"""Catalogue lookups, statistics and dashboard analytics (P*, A1-A23, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import catalog as cat
from ..sources import surrogate as sg
from .registry import query

CAT = ("catalogue",)


@query("overview_metrics", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_sequences,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS unique_genomes,
       CAST(COUNT(DISTINCT taxonomy_majority) AS BIGINT) AS taxonomy_labels,
       CAST(COUNT(DISTINCT gvclass_species) AS BIGINT) AS gvclass_species,
       CAST(COUNT(DISTINCT s_cluster) AS BIGINT) AS ani_clusters,
       round(COALESCE(AVG(gc_content) FILTER (WHERE seq_type = 'NT' AND gc_content IS NOT NULL), 0.0), 6) AS avg_gc_nt
FROM catalogue""", CAT)
def q_overview(spark, d):
    return cat.overview_metrics(sg.catalogue(spark, d)).withColumn("avg_gc_nt", F.round("avg_gc_nt", 6))


@query("catalog_stats", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_sequences,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS unique_genomes,
       CAST(SUM(length) AS BIGINT) AS total_bases,
       round(COALESCE(AVG(CASE WHEN seq_type = 'NT' THEN gc_content END), 0.0), 6) AS avg_gc
FROM catalogue""", CAT)
def q_stats(spark, d):
    return cat.stats(sg.catalogue(spark, d)).withColumn("avg_gc", F.round("avg_gc", 6))


@query("count_by_seq_type", """
SELECT seq_type, CAST(COUNT(*) AS BIGINT) AS n_sequences FROM catalogue GROUP BY seq_type""", CAT)
def q_count_by_type(spark, d):
    return cat.count_by_seq_type(sg.catalogue(spark, d))


@query("top_datasets", """
SELECT dataset_id, CAST(COUNT(*) AS BIGINT) AS n_sequences FROM catalogue
GROUP BY dataset_id ORDER BY n_sequences DESC, dataset_id LIMIT 10""", CAT)
def q_top_datasets(spark, d):
    return cat.top_datasets(sg.catalogue(spark, d), 10)


@query("total_bases", "SELECT CAST(SUM(length) AS BIGINT) AS total_bases FROM catalogue", CAT)
def q_total_bases(spark, d):
    return cat.total_bases(sg.catalogue(spark, d))


@query("avg_gc", """
SELECT round(COALESCE(AVG(gc_content) FILTER (WHERE seq_type = 'NT' AND gc_content IS NOT NULL), 0.0), 6) AS avg_gc
FROM catalogue""", CAT)
def q_avg_gc(spark, d):
    return cat.avg_gc(sg.catalogue(spark, d)).withColumn("avg_gc", F.round("avg_gc", 6))


REC = "gid, dataset_id, header, seq_type, length, round(CAST(gc_content AS DOUBLE), 6) AS gc_content, sequence"


def _rec(df):
    return df.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


@query("lookup_gid", f"SELECT {REC} FROM catalogue WHERE gid = 'src3|src3_23'", CAT)
def q_lookup(spark, d):
    return _rec(cat.lookup_gid(sg.catalogue(spark, d), "src3|src3_23"))


@query("by_dataset", f"SELECT {REC} FROM catalogue WHERE dataset_id = 'src7' AND seq_type = 'NT'", CAT)
def q_by_dataset(spark, d):
    return _rec(cat.by_dataset(sg.catalogue(spark, d), "src7", "NT"))


@query("sequences_of_type", f"SELECT {REC} FROM catalogue WHERE seq_type = 'AA'", CAT)
def q_of_type(spark, d):
    return _rec(cat.sequences_of_type(sg.catalogue(spark, d), "AA"))


@query("annotated_sample", """
SELECT gid, dataset_id, orthogroup_id, emapper_description FROM catalogue
WHERE seq_type = 'AA' AND is_skani_representative AND emapper_description IS NOT NULL
ORDER BY gid LIMIT 5""", CAT)
def q_annotated_sample(spark, d):
    return cat.annotated_sample(sg.catalogue(spark, d), 5)


@query("genomes_in_order", """
SELECT DISTINCT dataset_id, common_name FROM catalogue WHERE "order" = 'NATION_2'""", CAT)
def q_genomes_in_order(spark, d):
    return cat.genomes_in_order(sg.catalogue(spark, d), "NATION_2")


@query("high_quality_genomes", """
SELECT dataset_id, MAX(order_completeness) AS order_completeness, MAX(lenbp) AS lenbp FROM catalogue
WHERE order_completeness > 90 GROUP BY dataset_id ORDER BY order_completeness DESC, dataset_id LIMIT 50""", CAT)
def q_hq(spark, d):
    return cat.high_quality_genomes(sg.catalogue(spark, d), 90.0, 50)


def _rank_sql(level: str, anchored: bool = True) -> str:
    from ..functions.taxonomy import RANK_PREFIX
    p = RANK_PREFIX[level]
    pat = f"(?:^|;){p}_([^;]+)" if anchored else f"{p}_([^;]+)"
    return f"regexp_extract(taxonomy_majority, '{pat}', 1)"


@query("taxonomy_classifier_order", f"""
SELECT COALESCE(NULLIF(NULLIF({_rank_sql('order')}, ''), 'NA'), 'Unassigned') AS label,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes
FROM catalogue WHERE seq_type = 'NT' GROUP BY 1 ORDER BY genomes DESC, label LIMIT 25""", CAT)
def q_tax_order(spark, d):
    return an.taxonomy_distribution(sg.catalogue(spark, d), "order", "classifier", 25)


@query("taxonomy_classifier_species", f"""
SELECT COALESCE(NULLIF(NULLIF({_rank_sql('species')}, ''), 'NA'), 'Unassigned') AS label,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes
FROM catalogue WHERE seq_type = 'NT' GROUP BY 1 ORDER BY genomes DESC, label LIMIT 25""", CAT)
def q_tax_species(spark, d):
    return an.taxonomy_distribution(sg.catalogue(spark, d), "species", "classifier", 25)


def _all_levels_sql() -> str:
    from ..functions.taxonomy import PHYLO_COLUMNS, RANK_PREFIX
    parts = [f"SELECT dataset_id, 'classifier' AS source, '{lv}' AS level, "
             f"COALESCE(NULLIF(NULLIF({_rank_sql(lv)}, ''), 'NA'), 'Unassigned') AS label "
             f"FROM catalogue WHERE seq_type = 'NT'" for lv in RANK_PREFIX]
    parts += [f"SELECT dataset_id, 'phylo' AS source, '{lv}' AS level, "
              f"COALESCE(NULLIF(\"{col}\", ''), 'Unassigned') AS label FROM catalogue WHERE seq_type = 'NT'"
              for lv, col in PHYLO_COLUMNS.items()]
    return ("SELECT source, level, label, CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY source, level, label")


@query("taxonomy_classifier_all_levels", _all_levels_sql(), CAT)
def q_tax_all(spark, d):
    return an.taxonomy_all_levels(sg.catalogue(spark, d))


@query("taxonomy_phylo_order", """
SELECT COALESCE(NULLIF("order", ''), 'Unassigned') AS label,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes
FROM catalogue WHERE seq_type = 'NT' GROUP BY 1 ORDER BY genomes DESC, label LIMIT 25""", CAT)
def q_tax_phylo(spark, d):
    return an.taxonomy_distribution(sg.catalogue(spark, d), "order", "phylo", 25)


@query("environment_ecosystem", """
SELECT COALESCE(NULLIF(ecosystem, ''), 'Unassigned') AS label,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes, CAST(COUNT(*) AS BIGINT) AS sequences
FROM catalogue GROUP BY 1 ORDER BY genomes DESC, label LIMIT 30""", CAT)
def q_env(spark, d):
    return an.environment_distribution(sg.catalogue(spark, d), "ecosystem", 30)


def _env_all_sql() -> str:
    from ..functions.taxonomy import ENVIRONMENT_COLUMNS
    parts = [f"SELECT dataset_id, '{c}' AS dimension, COALESCE(NULLIF({c}, ''), 'Unassigned') AS label "
             f"FROM catalogue" for c in ENVIRONMENT_COLUMNS]
    return ("SELECT dimension, label, CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes, "
            "CAST(COUNT(*) AS BIGINT) AS sequences FROM (" + " UNION ALL ".join(parts)
            + ") GROUP BY dimension, label")


@query("environment_all_dimensions", _env_all_sql(), CAT)
def q_env_all(spark, d):
    return an.environment_all_dimensions(sg.catalogue(spark, d))


def _genome_stats_sql(with_meta: bool = False) -> str:
    from ..functions.taxonomy import RANK_PREFIX
    ranks = ",\n".join(
        f"COALESCE(NULLIF({_rank_sql(lv, anchored=False)}, ''), 'Unassigned') AS taxonomy_{lv}"
        for lv in RANK_PREFIX)
    meta_join = ""
    completeness = "completeness"
    if with_meta:
        meta_join = """LEFT JOIN (SELECT genome, arg_max(order_completeness, row_pos) AS meta_c
                                  FROM metadata_records GROUP BY genome) m ON m.genome = g.dataset_id"""
        completeness = "COALESCE(m.meta_c, g.completeness)"
    return f"""
WITH g AS (
  SELECT dataset_id, MAX(lenbp) AS genome_length, MAX(genecount) AS gene_count,
         AVG(gcperc) AS gc_percent, AVG(codingperc) AS coding_percent, MAX(contigs) AS contig_count,
         MAX(order_completeness) AS completeness, MAX(order_dup) AS contamination,
         MAX(taxonomy_majority) AS taxonomy_majority, MAX(ecosystem) AS ecosystem
  FROM catalogue WHERE seq_type = 'NT' GROUP BY dataset_id
)
SELECT dataset_id, genome_length, gene_count, round(gc_percent, 6) AS gc_percent,
       round(coding_percent, 6) AS coding_percent, CAST(COALESCE(contig_count, 0) AS BIGINT) AS contig_count,
       COALESCE(CAST({completeness} AS DOUBLE), 0.0) AS completeness,
       COALESCE(CAST(contamination AS DOUBLE), 0.0) AS contamination,
       taxonomy_majority, ecosystem, {ranks},
       round(genome_length / 1e6, 6) AS genome_length_mb
FROM g {meta_join}"""


def _round_stats(df):
    return (df.withColumn("gc_percent", F.round("gc_percent", 6))
            .withColumn("coding_percent", F.round("coding_percent", 6))
            .withColumn("genome_length_mb", F.round("genome_length_mb", 6)))


@query("genome_statistics", _genome_stats_sql(), CAT)
def q_genome_stats(spark, d):
    return _round_stats(an.genome_statistics(sg.catalogue(spark, d)))


@query("override_completeness", _genome_stats_sql(with_meta=True), CAT + ("metadata_records",))
def q_override(spark, d):
    return _round_stats(an.genome_statistics(sg.catalogue(spark, d), metadata=sg.metadata_records(spark, d)))


@query("annotation_matrix_order", f"""
SELECT COALESCE(NULLIF(NULLIF({_rank_sql('order')}, ''), 'NA'), 'Unassigned') AS gvclass_order,
       COALESCE(NULLIF(emapper_cog_category, ''), 'Unannotated') AS annotation_value,
       CAST(COUNT(*) AS BIGINT) AS sequences
FROM catalogue WHERE seq_type = 'AA' GROUP BY 1, 2
ORDER BY sequences DESC, gvclass_order, annotation_value LIMIT 25""", CAT)
def q_annot_matrix(spark, d):
    return an.annotation_matrix(sg.catalogue(spark, d), "emapper_cog_category", "order", 25)


# The columns that SQL has to name; the Spark query takes them from the data.
PIVOT_VALUES = ["DE", "EN", "ES", "FR", "Unannotated"]


@query("annotation_pivot", f"""
WITH m AS (
  SELECT COALESCE(NULLIF(NULLIF({_rank_sql('order')}, ''), 'NA'), 'Unassigned') AS gvclass_order,
         COALESCE(NULLIF(emapper_cog_category, ''), 'Unannotated') AS annotation_value,
         CAST(COUNT(*) AS BIGINT) AS sequences
  FROM catalogue WHERE seq_type = 'AA' GROUP BY 1, 2
)
SELECT gvclass_order, {", ".join(f"CAST(COALESCE(SUM(sequences) FILTER (WHERE annotation_value = '{v}'), 0) AS BIGINT) AS \"{v}\"" for v in PIVOT_VALUES)}
FROM m GROUP BY gvclass_order""", CAT)
def q_annot_pivot(spark, d):
    m = an.annotation_matrix(sg.catalogue(spark, d), "emapper_cog_category", "order", None)
    return an.annotation_pivot(m)


@query("cluster_summary", f"""
SELECT COALESCE(s_cluster, 'Unclustered') AS cluster_id,
       CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes,
       CAST(SUM(CASE WHEN is_skani_representative THEN 1 ELSE 0 END) AS BIGINT) AS representatives,
       CAST(COUNT(DISTINCT CASE WHEN is_skani_representative THEN dataset_id END) AS BIGINT) AS representative_genomes,
       COALESCE(MIN(NULLIF(NULLIF({_rank_sql('order')}, ''), 'NA')), 'Unassigned') AS gvclass_order
FROM catalogue WHERE seq_type = 'NT' GROUP BY 1 ORDER BY genomes DESC, cluster_id LIMIT 50""", CAT)
def q_clusters(spark, d):
    return an.cluster_summary(sg.catalogue(spark, d), 50)


GSTATS = "WITH gs AS (" + _genome_stats_sql().strip() + ")\n"


@query("group_summary", GSTATS + """
SELECT taxonomy_order AS "group", CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes,
       round_even(median(genome_length_mb), 3) AS median_length_mb,
       round_even(median(gc_percent), 2) AS median_gc,
       round_even(median(completeness), 2) AS median_completeness,
       round_even(median(contamination), 2) AS median_contamination
FROM gs GROUP BY 1 ORDER BY genomes DESC, "group" LIMIT 10""", CAT)
def q_group_summary(spark, d):
    return an.group_summary(an.genome_statistics(sg.catalogue(spark, d)), "taxonomy_order", 10)


@query("length_histogram", GSTATS + """
, b AS (SELECT MIN(genome_length / 1e6) AS lo, MAX(genome_length / 1e6) AS hi FROM gs)
SELECT taxonomy_phylum AS color_group,
       CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((genome_length / 1e6 - lo) / ((hi - lo) / 40)), 39) END AS INTEGER) AS bin,
       CAST(COUNT(*) AS BIGINT) AS genomes,
       round(lo + CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((genome_length / 1e6 - lo) / ((hi - lo) / 40)), 39) END AS INTEGER) * ((hi - lo) / 40), 6) AS bin_start,
       round(lo + (CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((genome_length / 1e6 - lo) / ((hi - lo) / 40)), 39) END AS INTEGER) + 1) * ((hi - lo) / 40), 6) AS bin_end
FROM gs, b GROUP BY 1, 2, lo, hi""", CAT)
def q_length_hist(spark, d):
    return an.length_histogram(an.genome_statistics(sg.catalogue(spark, d)), "taxonomy_phylum", 40)


@query("box_stats", GSTATS + """
, long AS (SELECT taxonomy_order AS "group", 'completeness' AS metric, completeness AS v FROM gs
           UNION ALL SELECT taxonomy_order, 'contamination', contamination FROM gs)
SELECT "group", metric, CAST(COUNT(v) AS BIGINT) AS n,
       round(quantile_cont(v, 0.0), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
       round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3,
       round(quantile_cont(v, 1.0), 6) AS max
FROM long GROUP BY 1, 2""", CAT)
def q_box(spark, d):
    return an.box_stats(an.genome_statistics(sg.catalogue(spark, d)), "taxonomy_order")


@query("label_share", """
WITH e AS (
  SELECT COALESCE(NULLIF(ecosystem, ''), 'Unassigned') AS label,
         CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes, CAST(COUNT(*) AS BIGINT) AS sequences
  FROM catalogue GROUP BY 1
)
SELECT label, genomes, sequences, round(genomes / (SELECT SUM(genomes) FROM e), 6) AS share FROM e""", CAT)
def q_label_share(spark, d):
    return an.label_share(an.environment_distribution(sg.catalogue(spark, d), "ecosystem", None))


@query("orthogroup_coverage", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_proteins, CAST(COUNT(orthogroup_id) AS BIGINT) AS with_orthogroup,
       CAST(SUM(CASE WHEN is_singleton THEN 1 ELSE 0 END) AS BIGINT) AS singletons,
       CAST(SUM(CASE WHEN orthogroup_id IS NULL AND is_singleton IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_assignment
FROM catalogue WHERE seq_type = 'AA'""", CAT)
def q_og_cov(spark, d):
    return cat.orthogroup_coverage(sg.catalogue(spark, d))


@query("annotation_coverage", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_proteins,
       CAST(COUNT(emapper_cog_category) AS BIGINT) AS with_cog_category,
       CAST(COUNT(emapper_description) AS BIGINT) AS with_description,
       CAST(COUNT(emapper_pfams) AS BIGINT) AS with_pfams,
       CAST(COUNT(emapper_kegg_pathway) AS BIGINT) AS with_kegg_pathway
FROM catalogue WHERE seq_type = 'AA'""", CAT)
def q_annot_cov(spark, d):
    return cat.annotation_coverage(sg.catalogue(spark, d))


@query("top_cog", """
SELECT emapper_cog_category AS cog_category, CAST(COUNT(*) AS BIGINT) AS n_proteins FROM catalogue
WHERE seq_type = 'AA' AND emapper_cog_category IS NOT NULL GROUP BY 1 ORDER BY n_proteins DESC, cog_category LIMIT 10""", CAT)
def q_top_cog(spark, d):
    return cat.top_cog(sg.catalogue(spark, d), 10)


@query("representative_breakdown", """
SELECT is_skani_representative, seq_type, CAST(COUNT(*) AS BIGINT) AS n_sequences FROM catalogue GROUP BY 1, 2""", CAT)
def q_rep_breakdown(spark, d):
    return cat.representative_breakdown(sg.catalogue(spark, d))


@query("genome_size_by_order", """
SELECT dataset_id, "order", MAX(lenbp) AS genome_size FROM catalogue WHERE seq_type = 'NT' GROUP BY 1, 2""", CAT)
def q_size_by_order(spark, d):
    return cat.genome_size_by_order(sg.catalogue(spark, d))


@query("annotation_matrix_annotated", f"""
SELECT COALESCE(NULLIF(NULLIF({_rank_sql('order')}, ''), 'NA'), 'Unassigned') AS gvclass_order,
       emapper_cog_category AS annotation_value, CAST(COUNT(*) AS BIGINT) AS sequences
FROM catalogue WHERE seq_type = 'AA' AND NULLIF(emapper_cog_category, '') IS NOT NULL
GROUP BY 1, 2""", CAT)
def q_annot_annotated(spark, d):
    m = an.annotation_matrix(sg.catalogue(spark, d), "emapper_cog_category", "order", None)
    return an.filter_unannotated(m, include_unannotated=False)


@query("taxonomy_bar_order", f"""
SELECT label, genomes FROM (
  SELECT COALESCE(NULLIF(NULLIF({_rank_sql('phylum')}, ''), 'NA'), 'Unassigned') AS label,
         CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes
  FROM catalogue WHERE seq_type = 'NT' GROUP BY 1 ORDER BY genomes DESC, label LIMIT 10)""", CAT)
def q_bar_order(spark, d):
    dist = an.taxonomy_distribution(sg.catalogue(spark, d), "phylum", "classifier", None)
    return an.bar_order(dist, 10)
