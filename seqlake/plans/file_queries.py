"""File layer over files derived from the driver tables: write to the shared scratch folder, read back.

Covers the readers (S1-S11, F7, F8), lake ingest and its schema (I12-I14, S7, U1), exports (K1, O3),
marts (M1, S12) and the product registry (R1, U4).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import fasta_record
from ..operators import chunks
from ..operators import ingest as ing
from ..operators import registry as R
from ..operators.snapshots import read_snapshot
from ..session import scratch_path
from ..sinks import export as X
from ..sinks.mart_state import refresh_marts
from ..sinks.marts import build_marts
from ..sources import files, ranges
from ..sources import surrogate as sg
from ..sources.lake import open_catalog, read_mart
from . import catalogue_queries, search_queries, table_queries  # noqa: F401  (their oracles are reused below)
from .ingest_queries import PARSED_SQL
from .registry import ORACLE, QUERIES, query
from .search_queries import HIT_COLS


def _text(df, spark, name, value="value"):
    path = scratch_path(spark, name)
    df.select(F.col(value).alias("value")).write.text(path)
    return path


def _tsv(df, spark, name, header=True):
    path = scratch_path(spark, name)
    df.write.option("sep", "\t").option("header", header).csv(path)
    return path


def _fasta_file(spark, d):
    """FASTA with wrapped lines; every second record has Windows line ends and a description."""
    rec = fasta_record(F.concat("record_id", F.lit(" some words")), F.col("raw_sequence"))
    plain = fasta_record(F.col("record_id"), F.col("raw_sequence"))
    odd = F.col("record_pos") % 2 == 1
    return _text(sg.raw_records(spark, d).select(
        F.when(odd, F.regexp_replace(rec, "\n", "\r\n")).otherwise(plain).alias("value")), spark, "fasta")


@query("read_fasta", "SELECT record_id, raw_sequence AS sequence FROM raw_records", ("raw_records",))
def q_read_fasta(spark, d):
    return files.read_fasta(spark, _fasta_file(spark, d)).select("record_id", "sequence")


@query("read_fasta_blocks", "SELECT record_id, raw_sequence AS sequence FROM raw_records", ("raw_records",))
def q_read_blocks(spark, d):
    """Block-gzip files, each divided among tasks."""
    path = scratch_path(spark, "fasta-blocks")
    ranges.write_fasta_blocks(sg.raw_records(spark, d).select(
        fasta_record(F.col("record_id"), F.col("raw_sequence")).alias("value")), path)
    return ranges.read_fasta_blocks(spark, path, split_bytes=1 << 20).select("record_id", "sequence")


@query("read_fasta_chunks", "SELECT record_id, CAST(length(raw_sequence) AS BIGINT) AS letters FROM raw_records", ("raw_records",))
def q_read_chunks(spark, d):
    """Records in chunks of 1000 letters, never as one row; their letters add up."""
    c = chunks.read_fasta_chunks(spark, _fasta_file(spark, d), core=1000)
    return c.groupBy("record_id").agg(F.sum("core").alias("letters"))


def _metadata_file(spark, d):
    """Rows in ``row_pos`` order: the last row of a genome wins."""
    return _tsv(sg.metadata_records(spark, d).orderBy("row_pos").select(
        F.col("genome").alias("Genome"), (F.col("lenbp") + 0.5).alias("lenBP"),
        F.when(F.col("order_completeness").isNull(), F.lit("N/A"))
         .when(F.col("row_pos") % 10 == 4, F.lit("bad number"))
         .otherwise(F.col("order_completeness").cast("string")).alias("order_completeness"),
        F.when(F.col("row_pos") % 6 == 0, F.lit("NA")).otherwise(F.col("ecosystem")).alias("Ecosystem"),
        F.col("row_pos").alias("Genome Name / Sample Name")), spark, "metadata")


@query("read_metadata", """
SELECT genome, CAST(round_even(lenbp + 0.5, 0) AS BIGINT) AS lenbp,
       CASE WHEN row_pos % 10 <> 4 THEN order_completeness END AS order_completeness,
       CASE WHEN row_pos % 6 <> 0 THEN ecosystem END AS ecosystem,
       CAST(row_pos AS VARCHAR) AS genome_name___sample_name
FROM metadata_records""", ("metadata_records",))
def q_read_metadata(spark, d):
    return files.read_metadata(spark, _metadata_file(spark, d))


@query("read_classifier", """
SELECT query AS genome, gvclass_order, taxonomy_majority, order_completeness FROM classifier_records""",
       ("classifier_records",))
def q_read_classifier(spark, d):
    c = sg.classifier_records(spark, d).select(
        "query", F.col("gvclass_order").alias("order"), "taxonomy_majority", "order_completeness")
    return files.read_classifier(spark, _tsv(c, spark, "classifier"))


@query("read_blast_hits", f"SELECT {HIT_COLS} FROM protein_hits", ("protein_hits",))
def q_read_blast(spark, d):
    return files.read_blast_hits(spark, _tsv(sg.protein_hits(spark, d), spark, "blast", header=False))


@query("read_hmm_hits", "SELECT * FROM hmm_hits", ("hmm_hits",))
def q_read_hmm(spark, d):
    return files.read_hmm_hits(spark, _tsv(sg.hmm_hits(spark, d), spark, "hmm"))


@query("read_ani_hits", """
SELECT *, CAST(NULL AS DOUBLE) AS "ANI_5_percentile", CAST(NULL AS DOUBLE) AS "ANI_95_percentile" FROM ani_hits""",
       ("ani_hits",))
def q_read_ani(spark, d):
    return files.read_ani_hits(spark, _tsv(sg.ani_hits(spark, d), spark, "ani"))


@query("read_hits_any", """
SELECT 'target_name' AS id_column, target_name AS id, CAST(COUNT(*) AS BIGINT) AS hits FROM hmm_hits GROUP BY target_name""",
       ("hmm_hits",))
def q_read_any(spark, d):
    hits, column = files.read_hits_any(spark, _tsv(sg.hmm_hits(spark, d), spark, "any"), "sseqid")
    return hits.groupBy(F.lit(column).alias("id_column"), F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("hits"))


def _ordered_lines(spark, d, name, header, line):
    """A text file of ``header`` and one line per document in id order (part files in name order)."""
    docs = sg.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), line.alias("value"))
    head = spark.createDataFrame([(-1, header)], "pos long, value string")
    return _text(docs.unionByName(head).orderBy("pos"), spark, name)


def _own_id():
    return F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("|p"), F.col("doc_id").cast("string"))


OWN_ID_SQL = "concat('src', CAST(doc_id % 20 AS VARCHAR), '|p', CAST(doc_id AS VARCHAR))"


@query("read_orthogroups", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
m AS (SELECT {OWN_ID_SQL} AS gid, n FROM r WHERE doc_id % 4 <> 0
      UNION ALL SELECT concat('shared|', CAST(doc_id % 5 AS VARCHAR)), n FROM r WHERE doc_id % 4 <> 1)
SELECT gid, CAST(MAX(n) AS VARCHAR) AS orthogroup_id FROM m GROUP BY gid""")
def q_read_orthogroups(spark, d):
    kind = F.col("doc_id") % 4
    shared = F.concat(F.lit("shared|"), (F.col("doc_id") % 5).cast("string"))
    line = F.concat_ws("\t", F.lit("2"), F.lit("2"), F.lit("0.5"),
                       F.when(kind == 0, F.lit("*")).when(kind == 2, F.concat_ws(",", _own_id(), shared)).otherwise(_own_id()),
                       F.when((kind == 1) | (kind == 2), F.lit("*")).otherwise(shared))
    path = _ordered_lines(spark, d, "orthogroups", "Species\tGenes\tAlg.-Conn.\ta.faa\tb.faa", line)
    return files.read_orthogroups(spark, path)


@query("read_singletons", f"SELECT {OWN_ID_SQL} AS gid FROM documents WHERE doc_id % 3 <> 0")
def q_read_singletons(spark, d):
    kind = F.col("doc_id") % 3
    line = F.concat_ws("\t", F.lit("1"), F.lit("1"), F.lit("0"), F.when(kind == 1, _own_id()).otherwise(F.lit("*")),
                       F.when(kind == 0, F.lit("*")).otherwise(_own_id()))
    return files.read_singletons(spark, _ordered_lines(spark, d, "singletons", "Species\tGenes\tConn\ta\tb", line))


@query("read_annotations", """
WITH r AS (SELECT doc_id, doc_id // 3 AS g FROM documents),
last AS (SELECT g, MAX(doc_id) AS doc_id FROM r GROUP BY g)
SELECT concat('g|', CAST(g AS VARCHAR)) AS gid, CASE WHEN doc_id % 2 = 0 THEN concat('PF', CAST(doc_id % 9 AS VARCHAR)) END AS "emapper_PFAMs",
       CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS DOUBLE) / 4 END AS emapper_score,
       CASE WHEN doc_id % 5 <> 0 THEN 'K' END AS "emapper_COG_category"
FROM last""")
def q_read_annotations(spark, d):
    i = F.col("doc_id")
    line = F.concat_ws("\t", F.concat(F.lit("g|"), F.floor(i / 3).cast("string")),
                       F.when(i % 2 == 0, F.concat(F.lit("PF"), (i % 9).cast("string"))).otherwise(F.lit("-")),
                       F.when(i % 7 == 0, F.lit("bad")).otherwise((i / 4).cast("string")),
                       F.when(i % 5 == 0, F.lit(None)).otherwise(F.lit("K")))  # a short row
    path = _ordered_lines(spark, d, "annotations", "#query\tPFAMs\tscore\tCOG_category", line)
    return files.read_annotations(spark, path).select("gid", "emapper_PFAMs", "emapper_score", "emapper_COG_category")


LAKE_SQL = f"""
WITH {PARSED_SQL.strip()},
meta AS (SELECT genome, max_by(n_chars_, row_pos) AS lenbp, max_by(eco, row_pos) AS ecosystem FROM (
  SELECT genome, row_pos, CAST(round_even(lenbp + 0.5, 0) AS BIGINT) AS n_chars_,
         CASE WHEN row_pos % 6 <> 0 THEN ecosystem ELSE '' END AS eco FROM metadata_records) GROUP BY genome)
SELECT p.gid, p.dataset_id, p.dataset_id AS genome, p.header, p.seq_type, p.length,
       round(CAST(p.gc_content AS DOUBLE), 6) AS gc_content, p.sequence, m.lenbp, NULLIF(m.ecosystem, '') AS ecosystem,
       CAST(NULL AS VARCHAR) AS "emapper_PFAMs", false AS is_skani_representative
FROM parsed p JOIN meta m ON m.genome = p.dataset_id"""


@query("lake_readback", LAKE_SQL, ("raw_records", "metadata_records"))
def q_lake(spark, d):
    root = scratch_path(spark, "lake")
    ing.ingest(spark, _metadata_file(spark, d), [_fasta_file(spark, d)], root, compute_tnf=False)
    lake = open_catalog(spark, root, view=None)
    out = lake.select("gid", "dataset_id", "genome", "header", "seq_type", "length", "gc_content", "sequence", "lenbp",
                      "ecosystem", "emapper_PFAMs", "is_skani_representative")
    return out.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


@query("ingest_report", f"""
WITH {PARSED_SQL.strip()}
SELECT CAST(COUNT(*) AS BIGINT) AS records_read,
       CAST(COUNT(*) FILTER (WHERE dataset_id IN (SELECT genome FROM metadata_records)) AS BIGINT) AS records_written,
       CAST(COUNT(*) FILTER (WHERE dataset_id NOT IN (SELECT genome FROM metadata_records)) AS BIGINT) AS records_skipped
FROM parsed""", ("raw_records", "metadata_records"))
def q_ingest_report(spark, d):
    report = ing.ingest(spark, _metadata_file(spark, d), [_fasta_file(spark, d)], scratch_path(spark, "lake"), compute_tnf=False)
    return spark.createDataFrame([tuple(report[c] for c in ("records_read", "records_written", "records_skipped"))],
                                 "records_read long, records_written long, records_skipped long")


def _batch_records(spark, d):
    """A later delivery for two genomes: their records of even length."""
    of_batch = F.col("record_id").rlike("^(src1|src3)[|_]") & (F.length("raw_sequence") % 2 == 0)
    return _text(sg.raw_records(spark, d).where(of_batch).select(
        fasta_record(F.col("record_id"), F.col("raw_sequence")).alias("value")), spark, "fasta-batch")


def _batch_metadata(spark, d):
    """The metadata rows of the delivery's genomes."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(_metadata_file(spark, d))
    return _tsv(rows.where(F.col("Genome").isin("src1", "src3")).orderBy(F.col("Genome Name / Sample Name").cast("long")), spark, "metadata-batch")


LAKE_OUT = ("gid", "dataset_id", "genome", "header", "seq_type", "length", "gc_content", "sequence", "lenbp", "ecosystem",
            "emapper_PFAMs", "is_skani_representative")


def _delivered(spark, d):
    root = scratch_path(spark, "versioned-lake")
    ing.ingest(spark, _metadata_file(spark, d), [_fasta_file(spark, d)], root, compute_tnf=False, versioned=True)
    ing.ingest(spark, _batch_metadata(spark, d), [_batch_records(spark, d)], root, compute_tnf=False, versioned=True)
    return root


@query("lake_reingest", LAKE_SQL + """
WHERE p.dataset_id NOT IN ('src1', 'src3') OR p.length % 2 = 0""", ("raw_records", "metadata_records"))
def q_reingest(spark, d):
    """Two genomes of a versioned lake replaced by a later delivery."""
    out = read_snapshot(spark, _delivered(spark, d)).select(*LAKE_OUT)
    return out.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


@query("lake_old_version", LAKE_SQL, ("raw_records", "metadata_records"))
def q_old_version(spark, d):
    """The version before that delivery, read after it."""
    out = read_snapshot(spark, _delivered(spark, d), version=1).select(*LAKE_OUT)
    return out.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


def _refreshed(spark, d, name):
    """A mart refreshed before and after the delivery: the second time from the second commit's state alone."""
    lake, state, marts = scratch_path(spark, "versioned-lake"), scratch_path(spark, "mart-state"), scratch_path(spark, "marts")
    ing.ingest(spark, _metadata_file(spark, d), [_fasta_file(spark, d)], lake, compute_tnf=False, versioned=True)
    refresh_marts(spark, lake, state, marts)
    ing.ingest(spark, _batch_metadata(spark, d), [_batch_records(spark, d)], lake, compute_tnf=False, versioned=True)
    refresh_marts(spark, lake, state, marts)
    return read_mart(spark, marts, name)


REINGESTED_SQL = "WITH lake AS (" + LAKE_SQL + """
WHERE p.dataset_id NOT IN ('src1', 'src3') OR p.length % 2 = 0)"""


@query("mart_environment_refreshed", REINGESTED_SQL + """,
g AS (SELECT dataset_id, MAX(ecosystem) AS ecosystem, COUNT(*) AS n FROM lake GROUP BY dataset_id),
d AS (SELECT unnest(['ecosystem', 'ecosystem_category', 'ecosystem_type', 'ecosystem_subtype', 'habitat', 'source']) AS dimension)
SELECT dimension, CASE WHEN dimension = 'ecosystem' THEN COALESCE(ecosystem, 'Unassigned') ELSE 'Unassigned' END AS label,
       CAST(COUNT(*) AS BIGINT) AS genomes, CAST(SUM(n) AS BIGINT) AS sequences FROM g, d GROUP BY 1, 2""",
       ("raw_records", "metadata_records"))
def q_environment_refreshed(spark, d):
    return _refreshed(spark, d, "environment").select("dimension", "label", "genomes", "sequences")


@query("mart_overview_refreshed", REINGESTED_SQL + """
SELECT CAST(COUNT(*) AS BIGINT) AS total_sequences, CAST(COUNT(DISTINCT dataset_id) AS BIGINT) AS unique_genomes,
       round(COALESCE(AVG(CASE WHEN seq_type = 'NT' THEN gc END), 0.0), 4) AS avg_gc_nt
FROM (SELECT *, gc_content AS gc FROM lake)""", ("raw_records", "metadata_records"))
def q_overview_refreshed(spark, d):
    return _refreshed(spark, d, "overview").select("total_sequences", "unique_genomes", F.round("avg_gc_nt", 4).alias("avg_gc_nt"))


def _full_metadata(spark, d):
    """Every second genome represents itself."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(_metadata_file(spark, d))
    number = F.regexp_extract("Genome", r"(\d+)$", 1).cast("int")
    rep = F.concat(F.lit("src"), (number - number % 2).cast("string"))
    return _tsv(rows.withColumn("skani_rep", rep).orderBy(F.col("Genome Name / Sample Name").cast("long")), spark, "metadata-full")


def _own_files(spark, d):
    """Orthogroups, singletons and annotations of the protein records, in gid order."""
    aa = ing.parse_records(sg.raw_records(spark, d), "record_id", "raw_sequence").where("seq_type = 'AA'").select("gid", "length")
    kind = F.col("length") % 3
    both = lambda own: F.concat_ws("\t", F.lit("1"), F.lit("1"), F.lit("0"), own, F.lit("*"))

    def lines(name, header, rows, line):
        head = spark.createDataFrame([("", header)], "gid string, value string")
        return _text(rows.select("gid", line.alias("value")).unionByName(head).orderBy("gid"), spark, name)

    return (lines("og", "Species\tGenes\tAlg.-Conn.\ta.faa\tb.faa", aa.where(kind == 1), both(F.col("gid"))),
            lines("st", "Species\tGenes\tAlg.-Conn.\ta.faa\tb.faa", aa.where(kind == 2), both(F.col("gid"))),
            lines("an", "#query\tPFAMs\tscore\tCOG_category", aa.where(kind != 0), F.concat_ws(
                "\t", "gid", F.concat(F.lit("PF"), (F.col("length") % 7).cast("string")), (F.col("length") / 4).cast("string"), F.lit("K"))))


INGEST_FULL_SQL = f"""
WITH {PARSED_SQL.strip()},
kmers AS (SELECT gid, COUNT(*) AS windows FROM (
    SELECT gid, substr(sequence, p, 4) AS kmer
    FROM (SELECT gid, sequence, unnest(generate_series(1, length(sequence) - 3)) AS p FROM parsed WHERE seq_type = 'NT'))
  WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY gid),
acgt AS (SELECT gid, COUNT(*) AS n FROM (
    SELECT gid, substr(sequence, p, 4) AS kmer
    FROM (SELECT gid, sequence, unnest(generate_series(1, length(sequence) - 3)) AS p FROM parsed WHERE seq_type = 'NT'))
  WHERE kmer IN ('AAAA', 'TTTT') GROUP BY gid),
cls AS (SELECT query AS genome, max_by(gvclass_order, row_pos) AS gvclass_order, max_by(taxonomy_majority, row_pos) AS taxonomy_majority,
          max_by(order_completeness, row_pos) AS order_completeness FROM classifier_records GROUP BY query),
known AS (SELECT DISTINCT genome FROM metadata_records),
r AS (SELECT p.*, row_number() OVER (ORDER BY p.gid) AS place,
        CAST(regexp_extract(p.dataset_id, '([0-9]+)$', 1) AS INTEGER) % 2 = 0 AS rep FROM parsed p JOIN known k ON k.genome = p.dataset_id),
og AS (SELECT gid, CAST(row_number() OVER (ORDER BY gid) AS VARCHAR) AS orthogroup_id FROM parsed WHERE seq_type = 'AA' AND length % 3 = 1)
SELECT r.gid, r.dataset_id, r.seq_type, r.length, rep AS is_skani_representative, c.gvclass_order, c.taxonomy_majority, c.order_completeness,
       CASE WHEN rep THEN og.orthogroup_id END AS orthogroup_id,
       CASE WHEN rep AND og.gid IS NOT NULL THEN false WHEN rep AND r.seq_type = 'AA' AND r.length % 3 = 2 THEN true END AS is_singleton,
       CASE WHEN rep AND r.seq_type = 'AA' AND r.length % 3 <> 0 THEN concat('PF', CAST(r.length % 7 AS VARCHAR)) END AS "emapper_PFAMs",
       CASE WHEN rep AND r.seq_type = 'AA' AND r.length % 3 <> 0 THEN CAST(r.length AS DOUBLE) / 4 END AS emapper_score,
       CAST(CASE WHEN r.seq_type = 'NT' THEN 136 END AS INTEGER) AS tnf_entries,
       CASE WHEN r.seq_type = 'NT' THEN round(CASE WHEN w.windows IS NULL THEN 0.0 ELSE
            CAST(CAST(CAST(COALESCE(a.n, 0) AS DOUBLE) / w.windows AS REAL) AS DOUBLE) END, 6) END AS tnf_first
FROM r LEFT JOIN og USING (gid) LEFT JOIN cls c ON c.genome = r.dataset_id LEFT JOIN kmers w USING (gid) LEFT JOIN acgt a USING (gid)"""


@query("ingest_full_readback", INGEST_FULL_SQL, ("raw_records", "metadata_records", "classifier_records"))
def q_ingest_full(spark, d):
    """Proteins and nucleotides from two FASTA files, classifier, orthogroups, singletons, annotations and vectors."""
    aa = F.col("record_pos") % 5 == 0
    raw = sg.raw_records(spark, d)
    fasta = [_text(raw.where(part).select(fasta_record(F.col("record_id"), F.col("raw_sequence")).alias("value")), spark, name)
             for name, part in (("nt", ~aa), ("aa", aa))]
    c = sg.classifier_records(spark, d).orderBy("row_pos").select("query", "gvclass_order", "taxonomy_majority", "order_completeness")
    orthogroups, singletons, annotations = _own_files(spark, d)
    root = scratch_path(spark, "full-lake")
    ing.ingest(spark, _full_metadata(spark, d), fasta, root, classifier_path=_tsv(c, spark, "classifier"), orthogroups_path=orthogroups,
               singletons_path=singletons, annotations_path=annotations, compute_tnf=True)
    return open_catalog(spark, root, view=None).select(
        "gid", "dataset_id", "seq_type", "length", "is_skani_representative", "gvclass_order", "taxonomy_majority", "order_completeness",
        "orthogroup_id", "is_singleton", "emapper_PFAMs", "emapper_score",
        F.when(F.col("tnf_136").isNotNull(), F.size("tnf_136")).alias("tnf_entries"),
        F.round(F.col("tnf_136")[0].cast("double"), 6).alias("tnf_first"))


@query("export_fasta_readback", "SELECT gid AS record_id, sequence FROM catalogue WHERE seq_type = 'AA'", ("catalogue",))
def q_export(spark, d):
    path = scratch_path(spark, "export")
    X.export_fasta(sg.catalogue(spark, d), path, "AA")
    return files.read_fasta(spark, path).select("record_id", "sequence")


@query("export_by_genome_readback", """
SELECT dataset_id, gid AS record_id, sequence FROM catalogue WHERE seq_type = 'NT' AND dataset_id IN ('src1', 'src4', 'src9')""",
       ("catalogue",))
def q_export_genomes(spark, d):
    path = scratch_path(spark, "export-genomes")
    X.export_fasta_by_genome(sg.catalogue(spark, d), path, "NT", ["src1", "src4", "src9", "nothing"])
    return files.read_fasta(spark, path).select(
        F.regexp_extract("file", "dataset_id=([^/]+)/", 1).alias("dataset_id"), "record_id", "sequence")


def _mart(spark, d, name, **options):
    root = scratch_path(spark, "marts")
    build_marts(sg.catalogue(spark, d), root, names=(name,), **options)
    return read_mart(spark, root, name)


def _stored(name: str, source: str, **options):
    """Register ``mart_<name>``: the mart read back equals the direct query ``source``."""
    def build(spark, d):
        wanted = QUERIES[source](spark, d)
        rounded = {"overview": ["avg_gc_nt"]}.get(name, [])
        df = _mart(spark, d, name, **options).select(*wanted.columns)
        return df.withColumns({c: F.round(c, 6) for c in rounded})

    query(f"mart_{name}")(build)
    ORACLE[f"mart_{name}"] = ORACLE[source]


_stored("overview", "overview_metrics")
_stored("taxonomy", "taxonomy_classifier_all_levels")
_stored("environment", "environment_all_dimensions")
_stored("annotations", "annotation_matrix_all", annotation_fields=[
    "emapper_cog_category", "emapper_kegg_pathway", "emapper_pfams", "emapper_description"])
_stored("cluster_summary", "cluster_summary", cluster_limit=50)


@query("upsert_products", """
SELECT dataset_id, product, uri, sha256, version FROM (
  SELECT *, max(created_epoch) OVER (PARTITION BY dataset_id, product) AS newest FROM products) WHERE created_epoch = newest""",
       ("products",))
def q_upsert(spark, d):
    root, p = scratch_path(spark, "registry"), sg.products(spark, d)
    late = F.col("created_at") >= F.timestamp_seconds(F.lit(1700000100))
    R.register_products(spark, root, p.filter(late))
    R.register_products(spark, root, p.filter(~late))
    return R.load_products(spark, root).select("dataset_id", "product", "uri", "sha256", "version")
