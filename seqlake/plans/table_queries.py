"""Documented tables, FASTA text, registry and annotation marts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.taxonomy import PHYLO_COLUMNS, RANK_PREFIX
from ..operators import analytics as an
from ..operators import registry as R
from ..operators import tables as T
from ..sinks.export import fasta_text
from ..sources import surrogate as sg
from .catalogue_queries import _rank_sql
from .registry import query

CAT = ("catalogue",)


@query("fasta_records", """
SELECT gid, '>' || gid || chr(10) || rtrim(regexp_replace(sequence, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS value
FROM catalogue""", CAT)
def q_fasta(spark, d):
    return fasta_text(sg.catalogue(spark, d).select("gid", "sequence"))


@query("latest_product", """
SELECT dataset_id, product, arg_max(uri, created_epoch) AS uri, arg_max(sha256, created_epoch) AS sha256,
       arg_max(version, created_epoch) AS version
FROM products GROUP BY dataset_id, product""", ("products",))
def q_latest_product(spark, d):
    return R.latest_products(sg.products(spark, d)).select("dataset_id", "product", "uri", "sha256", "version")


@query("orthogroup_stats", """
SELECT orthogroup_id, CAST(COUNT(*) AS BIGINT) AS members, CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS genomes,
       MIN(gid) AS example_gid
FROM catalogue WHERE orthogroup_id IS NOT NULL GROUP BY 1""", CAT)
def q_og_stats(spark, d):
    return T.orthogroup_stats(sg.catalogue(spark, d))


GENOME_COLS_SQL = ("common_name, domain, phylum, \"class\", \"order\", family, genus, taxonomy_majority, "
                   "gvclass_species, s_cluster, skani_rep, is_skani_representative, pdm_cluster, ecosystem, "
                   "ecosystem_category, ecosystem_type, ecosystem_subtype, habitat, source, lenbp, genecount, "
                   "contigs, gcperc, codingperc, order_completeness, order_dup")


@query("genome_table", f"SELECT DISTINCT dataset_id, {GENOME_COLS_SQL} FROM catalogue", CAT)
def q_genome_table(spark, d):
    return T.genome_table(sg.catalogue(spark, d))


def _taxonomy_long_sql() -> str:
    parts = [f"SELECT dataset_id, 'classifier' AS source, '{lv}' AS level, "
             f"COALESCE(NULLIF(NULLIF({_rank_sql(lv)}, ''), 'NA'), 'Unassigned') AS label FROM g" for lv in RANK_PREFIX]
    parts += [f"SELECT dataset_id, 'phylo', '{lv}', COALESCE(NULLIF(\"{col}\", ''), 'Unassigned') FROM g"
              for lv, col in PHYLO_COLUMNS.items()]
    return ("WITH g AS (SELECT DISTINCT dataset_id, taxonomy_majority, domain, phylum, \"class\", \"order\", family, genus "
            "FROM catalogue)\n" + "\nUNION ALL ".join(parts))


@query("taxonomy_long", _taxonomy_long_sql(), CAT)
def q_tax_long(spark, d):
    return T.taxonomy_long(T.genome_table(sg.catalogue(spark, d)))


ANN_FIELDS = ["emapper_cog_category", "emapper_description", "emapper_pfams", "emapper_kegg_pathway"]


@query("annotations_long", """
SELECT gid, field, trim(value) AS value FROM (
  SELECT gid, 'cog_category' AS field, unnest([emapper_cog_category]) AS value FROM catalogue WHERE seq_type = 'AA'
  UNION ALL SELECT gid, 'description', unnest([emapper_description]) FROM catalogue WHERE seq_type = 'AA'
  UNION ALL SELECT gid, 'pfams', unnest(string_split(emapper_pfams, ',')) FROM catalogue WHERE seq_type = 'AA'
  UNION ALL SELECT gid, 'kegg_pathway', unnest(string_split(emapper_kegg_pathway, ',')) FROM catalogue WHERE seq_type = 'AA'
) WHERE value IS NOT NULL AND trim(value) <> ''""", CAT)
def q_ann_long(spark, d):
    return T.annotations_long(sg.catalogue(spark, d), ANN_FIELDS)


LEVELS = ("order", "family", "genus", "class", "phylum", "domain")


def _ann_all_sql() -> str:
    parts = []
    for f in ANN_FIELDS:
        for lv in LEVELS:
            parts.append(f"SELECT '{f}' AS field, '{lv}' AS level, "
                         f"COALESCE(NULLIF(NULLIF({_rank_sql(lv)}, ''), 'NA'), 'Unassigned') AS rank_label, "
                         f"COALESCE(NULLIF({f}, ''), 'Unannotated') AS annotation_value FROM catalogue WHERE seq_type = 'AA'")
    return ("SELECT field, level, rank_label, annotation_value, CAST(COUNT(*) AS BIGINT) AS sequences FROM ("
            + "\nUNION ALL ".join(parts) + ") GROUP BY 1, 2, 3, 4")


@query("annotation_matrix_all", _ann_all_sql(), CAT)
def q_ann_all(spark, d):
    return an.annotation_matrix_all(sg.catalogue(spark, d), ANN_FIELDS, LEVELS)
