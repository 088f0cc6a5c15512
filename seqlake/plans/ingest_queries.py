"""Ingest operators over the driver-derived raw records and genome tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import ingest as ing
from ..sources import surrogate as sg
from .registry import query

RECORD_COLUMNS = ["gid", "dataset_id", "header", "seq_type", "length", "gc_content", "sequence"]

HEADER_SQL = """
CASE WHEN strpos(record_id, '|') > 0 THEN split_part(record_id, '|', 1)
     WHEN regexp_matches(record_id, '_[0-9]+$') THEN regexp_extract(record_id, '^(.*)_[0-9]+$', 1)
     ELSE record_id END"""
LOCAL_SQL = "CASE WHEN strpos(record_id, '|') > 0 THEN substr(record_id, strpos(record_id, '|') + 1) ELSE record_id END"
KIND_SQL = "CASE WHEN regexp_full_match(upper(raw_sequence), '[ACGTUN]+') THEN 'NT' ELSE 'AA' END"

PARSED_SQL = f"""
parsed0 AS (
  SELECT {HEADER_SQL} AS dataset_id, {LOCAL_SQL} AS header, {KIND_SQL} AS seq_type,
         CASE WHEN {KIND_SQL} = 'NT' THEN replace(upper(raw_sequence), 'U', 'T') ELSE upper(raw_sequence) END AS sequence
  FROM raw_records
),
parsed AS (
  SELECT concat_ws('|', dataset_id, header) AS gid, dataset_id, header, seq_type,
         CAST(length(sequence) AS INTEGER) AS length,
         CASE WHEN seq_type = 'NT' THEN
           CAST(CASE WHEN length(sequence) = 0 THEN 0.0
                     ELSE CAST(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) AS DOUBLE)
                          / length(sequence) * 100.0 END AS REAL) END AS gc_content,
         sequence
  FROM parsed0
)"""


def _parsed(spark, d):
    return ing.parse_records(sg.raw_records(spark, d), "record_id", "raw_sequence")


def _round_gc(df):
    return df.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


@query("parse_header", f"""
SELECT record_id, {HEADER_SQL} AS dataset_id, {LOCAL_SQL} AS header FROM raw_records""", ("raw_records",))
def q_parse_header(spark, d):
    from ..functions.sequence import header_cols
    r = sg.raw_records(spark, d)
    ds, hd = header_cols(F.col("record_id"))
    return r.select("record_id", ds.alias("dataset_id"), hd.alias("header"))


@query("detect_seq_type", f"SELECT record_id, {KIND_SQL} AS seq_type FROM raw_records", ("raw_records",))
def q_detect(spark, d):
    from ..functions.sequence import seq_type_col
    r = sg.raw_records(spark, d)
    return r.select("record_id", seq_type_col(F.upper(F.col("raw_sequence"))).alias("seq_type"))


@query("gc_content", "WITH " + PARSED_SQL.strip() + """
SELECT gid, round(CAST(gc_content AS DOUBLE), 6) AS gc_content FROM parsed WHERE seq_type = 'NT'""",
       ("raw_records",))
def q_gc(spark, d):
    return _round_gc(_parsed(spark, d).filter(F.col("seq_type") == "NT").select("gid", "gc_content"))


@query("ingest_records", "WITH " + PARSED_SQL.strip() + """
SELECT gid, dataset_id, header, seq_type, length, round(CAST(gc_content AS DOUBLE), 6) AS gc_content, sequence
FROM parsed""", ("raw_records",))
def q_ingest_records(spark, d):
    return _round_gc(_parsed(spark, d).select(*RECORD_COLUMNS))


@query("keep_known_genomes", "WITH " + PARSED_SQL.strip() + """
SELECT p.gid, p.dataset_id, p.seq_type, p.length, g.phylum, g.is_skani_representative
FROM parsed p JOIN genomes g ON p.dataset_id = g.dataset_id""", ("raw_records", "genomes"))
def q_keep_known(spark, d):
    g = sg.genomes(spark, d).select(F.col("dataset_id").alias("genome"), "phylum", "is_skani_representative")
    return ing.keep_known_genomes(_parsed(spark, d), g).select(
        "gid", "dataset_id", "seq_type", "length", "phylum", "is_skani_representative")


@query("unknown_genomes", "WITH " + PARSED_SQL.strip() + """
SELECT dataset_id, CAST(COUNT(*) AS BIGINT) AS skipped_records FROM parsed p
WHERE NOT EXISTS (SELECT 1 FROM genomes g WHERE g.dataset_id = p.dataset_id) GROUP BY dataset_id""",
       ("raw_records", "genomes"))
def q_unknown(spark, d):
    g = sg.genomes(spark, d).select(F.col("dataset_id").alias("genome"))
    return ing.unknown_genomes(_parsed(spark, d), g)


@query("representative_flag", """
SELECT gid, dataset_id, skani_rep, COALESCE(dataset_id IS NOT DISTINCT FROM skani_rep AND dataset_id IS NOT NULL, false) AS is_rep
FROM catalogue""", ("catalogue",))
def q_rep_flag(spark, d):
    c = sg.catalogue(spark, d)
    return c.select("gid", "dataset_id", "skani_rep",
                    ing.representative_flag(F.col("dataset_id"), F.col("skani_rep")).alias("is_rep"))


@query("dedupe_genomes", """
SELECT genome, row_pos, order_completeness, lenbp, ecosystem FROM (
  SELECT *, row_number() OVER (PARTITION BY genome ORDER BY row_pos DESC) AS rn FROM metadata_records
) WHERE rn = 1""", ("metadata_records",))
def q_dedupe(spark, d):
    return ing.dedupe_genomes(sg.metadata_records(spark, d), "genome", "row_pos")


@query("merge_classifier", """
WITH c AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY row_pos DESC) AS rn
                 FROM classifier_records) WHERE rn = 1
)
SELECT g.dataset_id AS genome, g."order", g.taxonomy_majority, c.taxonomy_majority AS taxonomy_majority_gvclass,
       c.gvclass_order, c.order_completeness, g.lenbp
FROM genomes g LEFT JOIN c ON c.query = g.dataset_id""", ("genomes", "classifier_records"))
def q_merge_classifier(spark, d):
    base = sg.genomes(spark, d).drop("dataset_id", "gvclass_order")  # as in a metadata file: no classifier ranks
    cls = an.latest_per_key(sg.classifier_records(spark, d), "query", "row_pos") \
        .withColumnRenamed("query", "genome").drop("row_pos")
    m = ing.merge_classifier(base, cls, "genome")
    return m.select("genome", "order", "taxonomy_majority", "taxonomy_majority_gvclass", "gvclass_order",
                    "order_completeness", "lenbp")


@query("attach_orthogroups", """
WITH m AS (SELECT gid, orthogroup_id AS og FROM catalogue WHERE orthogroup_id IS NOT NULL),
     s AS (SELECT gid FROM catalogue WHERE is_singleton)
SELECT c.gid, c.dataset_id,
       CASE WHEN c.is_skani_representative THEN m.og END AS orthogroup_id,
       CASE WHEN c.is_skani_representative AND m.og IS NOT NULL THEN false
            WHEN c.is_skani_representative AND s.gid IS NOT NULL THEN true END AS is_singleton
FROM catalogue c LEFT JOIN m ON m.gid = c.gid LEFT JOIN s ON s.gid = c.gid
WHERE c.seq_type = 'AA'""", ("catalogue",))
def q_attach_og(spark, d):
    c = sg.catalogue(spark, d)
    members = c.filter(F.col("orthogroup_id").isNotNull()).select("gid", "orthogroup_id")
    singles = c.filter(F.col("is_singleton")).select("gid")
    aa = c.filter(F.col("seq_type") == "AA")
    return ing.attach_orthogroups(aa, members, singles).select("gid", "dataset_id", "orthogroup_id", "is_singleton")


@query("attach_annotations", """
WITH a AS (SELECT gid, emapper_cog_category AS cog, emapper_description AS descr FROM catalogue
           WHERE seq_type = 'AA' AND emapper_cog_category IS NOT NULL)
SELECT c.gid, c.dataset_id,
       CASE WHEN c.is_skani_representative THEN a.cog END AS emapper_cog_category,
       CASE WHEN c.is_skani_representative THEN a.descr END AS emapper_description
FROM catalogue c LEFT JOIN a ON a.gid = c.gid WHERE c.seq_type = 'AA'""", ("catalogue",))
def q_attach_annot(spark, d):
    c = sg.catalogue(spark, d)
    ann = c.filter((F.col("seq_type") == "AA") & F.col("emapper_cog_category").isNotNull()) \
           .select("gid", "emapper_cog_category", "emapper_description")
    aa = c.filter(F.col("seq_type") == "AA").select("gid", "dataset_id", "is_skani_representative")
    return ing.attach_annotations(aa, ann).select("gid", "dataset_id", "emapper_cog_category", "emapper_description")
