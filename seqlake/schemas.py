"""Explicit schemas of external inputs and the lake (no inference at scale)."""

from __future__ import annotations

from pyspark.sql import types as T

# Integer and float columns of the genome metadata table.
METADATA_INT_COLUMNS = (
    "gvog4_unique", "gvog8_unique", "gvog8_total", "mcp_total", "mirus_unique", "mirus_total",
    "mrya_unique", "mrya_total", "lenbp", "genecount",
)
METADATA_FLOAT_COLUMNS = ("order_completeness", "gvog8_dup", "mirus_dup", "gcperc", "codingperc")

# Prefix of classifier rank columns and suffix of other
# classifier columns clashing with metadata names (the table contract).
CLASSIFIER_PREFIX = "gvclass_"
CLASSIFIER_SUFFIX = "_gvclass"

# Classifier table renames, integer and float columns.
CLASSIFIER_RANK_RENAMES = {
    "species": "gvclass_species",
    "genus": "gvclass_genus",
    "family": "gvclass_family",
    "order": "gvclass_order",
    "class": "gvclass_class",
    "phylum": "gvclass_phylum",
    "domain": "gvclass_domain",
}
CLASSIFIER_INT_COLUMNS = (
    "gvog4_unique", "gvog8_unique", "gvog8_total", "mcp_total", "mirus_unique", "mirus_total",
    "mrya_unique", "mrya_total", "phage_unique", "phage_total", "cellular_unique", "cellular_total",
    "contigs", "lenbp", "genecount",
)
CLASSIFIER_FLOAT_COLUMNS = (
    "avgdist", "order_dup", "order_completeness", "order_weighted_completeness", "order_confidence_score",
    "gvog8_dup", "mirus_dup", "cellular_dup", "gcperc", "codingperc",
)
# Columns the classifier overrides in the base metadata.
CLASSIFIER_OVERLAP_COLUMNS = (
    "order_completeness", "gvog4_unique", "gvog8_unique", "gvog8_total", "gvog8_dup", "mcp_total",
    "mirus_unique", "mirus_total", "mirus_dup", "mrya_unique", "mrya_total", "lenbp", "gcperc",
    "genecount", "codingperc", "ttable",
)
# Classifier columns added as typed nulls when no classifier file is given.
CLASSIFIER_COLUMNS = {
    "taxonomy_majority": "string", "taxonomy_strict": "string", "gvclass_species": "string",
    "gvclass_genus": "string", "gvclass_family": "string", "gvclass_order": "string",
    "gvclass_class": "string", "gvclass_phylum": "string", "gvclass_domain": "string",
    "avgdist": "double", "order_dup": "double", "order_weighted_completeness": "double",
    "order_confidence_score": "double", "phage_unique": "long", "phage_total": "long",
    "cellular_unique": "long", "cellular_total": "long", "cellular_dup": "double", "contigs": "long",
}

# Functional annotation columns, in file order after the query id.
ANNOTATION_COLUMNS = (
    "seed_ortholog", "evalue", "score", "eggNOG_OGs", "max_annot_lvl", "COG_category", "Description",
    "Preferred_name", "GOs", "EC", "KEGG_ko", "KEGG_Pathway", "KEGG_Module", "KEGG_Reaction",
    "KEGG_rclass", "BRITE", "KEGG_TC", "CAZy", "BiGG_Reaction", "PFAMs",
)

BLAST6 = T.StructType([
    T.StructField("qseqid", T.StringType()), T.StructField("sseqid", T.StringType()),
    T.StructField("pident", T.DoubleType()), T.StructField("length", T.IntegerType()),
    T.StructField("mismatch", T.IntegerType()), T.StructField("gapopen", T.IntegerType()),
    T.StructField("qstart", T.IntegerType()), T.StructField("qend", T.IntegerType()),
    T.StructField("sstart", T.IntegerType()), T.StructField("send", T.IntegerType()),
    T.StructField("evalue", T.DoubleType()), T.StructField("bitscore", T.DoubleType()),
])

HMM_HITS = T.StructType([
    T.StructField("query_name", T.StringType()), T.StructField("target_name", T.StringType()),
    T.StructField("evalue", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("bias", T.DoubleType()),
])

ANI_HITS = T.StructType([
    T.StructField("Ref_file", T.StringType()), T.StructField("Query_file", T.StringType()),
    T.StructField("ANI", T.DoubleType()), T.StructField("Align_fraction_ref", T.DoubleType()),
    T.StructField("Align_fraction_query", T.DoubleType()), T.StructField("Ref_name", T.StringType()),
    T.StructField("Query_name", T.StringType()),
    T.StructField("ANI_5_percentile", T.DoubleType()), T.StructField("ANI_95_percentile", T.DoubleType()),
])

PRODUCTS = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("product", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("sha256", T.StringType()),
    T.StructField("version", T.StringType()), T.StructField("created_at", T.TimestampType()),
])

# The lake table.  Core fields, metadata, classifier, then proteins of representatives.
LAKE_CORE = (
    ("gid", "string"), ("dataset_id", "string"), ("header", "string"), ("seq_type", "string"), ("length", "int"),
    ("gc_content", "float"), ("sequence", "string"), ("tnf_136", "array<float>"),
)
LAKE_METADATA = (
    ("genome", "string"), ("common_name", "string"), ("phylum", "string"), ("class", "string"), ("order", "string"),
    ("family", "string"), ("genus", "string"), ("s_cluster", "string"), ("skani_rep", "string"),
    ("pdmtree", "string"), ("pdm_cluster", "string"), ("mcl_rep", "string"), ("mcl_on_pdm46tree", "string"),
    ("order_completeness", "double"), ("gvog4_unique", "bigint"), ("gvog8_unique", "bigint"),
    ("gvog8_total", "bigint"), ("gvog8_dup", "double"), ("mcp_total", "bigint"), ("mirus_unique", "bigint"),
    ("mirus_total", "bigint"), ("mirus_dup", "double"), ("mrya_unique", "bigint"), ("mrya_total", "bigint"),
    ("lenbp", "bigint"), ("gcperc", "double"), ("genecount", "bigint"), ("codingperc", "double"),
    ("ttable", "string"), ("domain", "string"), ("sequencing_status", "string"), ("study_name", "string"),
    ("genome_name___sample_name", "string"), ("sequencing_center", "string"), ("img_genome_id", "string"),
    ("gold_analysis_project_type", "string"), ("assembly_method", "string"), ("pubmed_id", "string"),
    ("ecosystem", "string"), ("ecosystem_category", "string"), ("ecosystem_subtype", "string"),
    ("ecosystem_type", "string"), ("specific_ecosystem", "string"), ("habitat", "string"), ("source", "string"),
)
LAKE_CLASSIFIER = (
    ("taxonomy_majority", "string"), ("taxonomy_strict", "string"), ("gvclass_species", "string"),
    ("gvclass_genus", "string"), ("gvclass_family", "string"), ("gvclass_order", "string"),
    ("gvclass_class", "string"), ("gvclass_phylum", "string"), ("gvclass_domain", "string"), ("avgdist", "double"),
    ("order_dup", "double"), ("order_weighted_completeness", "double"), ("order_confidence_score", "double"),
    ("phage_unique", "bigint"), ("phage_total", "bigint"), ("cellular_unique", "bigint"),
    ("cellular_total", "bigint"), ("cellular_dup", "double"), ("contigs", "bigint"),
)
LAKE_PROTEIN = (
    ("is_skani_representative", "boolean"), ("orthogroup_id", "string"), ("is_singleton", "boolean"),
    *((f"emapper_{c}", "double" if c in ("evalue", "score") else "string") for c in ANNOTATION_COLUMNS),
)
LAKE_COLUMNS = LAKE_CORE + LAKE_METADATA + LAKE_CLASSIFIER + LAKE_PROTEIN
LAKE_SCHEMA = ", ".join(f"`{c}` {t}" for c, t in LAKE_COLUMNS)
