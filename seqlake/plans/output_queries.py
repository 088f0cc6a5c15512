"""What the sinks write, read back: order and headers of FASTA, checksums, hits, placement, product files, vectors
(O3, F11, F13, V8, K3, K4, K5, R1, R2, M1)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import hits as H
from ..operators import kmers as K
from ..operators import registry as R
from ..session import scratch_path
from ..sinks import export as X
from ..sinks.marts import build_marts
from ..sources import files, ranges
from ..sources import surrogate as sg
from ..sources.lake import read_mart
from .catalogue_queries import _round_stats
from .registry import ORACLE, query

CAT = ("catalogue",)
FASTA_SQL = "'>' || gid || chr(10) || rtrim(regexp_replace(sequence, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) || chr(10)"


@query("export_fasta_order", """
SELECT CAST(COUNT(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS out_of_order FROM catalogue WHERE seq_type = 'NT'""", CAT)
def q_export_order(spark, d):
    """Records that stand before a smaller gid: in their file, or by a file that overlaps the one before it."""
    path = scratch_path(spark, "export")
    X.export_fasta(sg.catalogue(spark, d), path, "NT", num_partitions=7)
    text = spark.read.option("lineSep", "\n>").text(path).select(
        F.regexp_extract("value", r"^>?(\S+)", 1).alias("gid"), files.file_order().alias("at"))
    inside = W.partitionBy("at.file").orderBy("at")
    rows = text.withColumn("before", F.lag("gid").over(inside))
    per_file = rows.groupBy(F.col("at.file").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") >= F.col("gid")).alias("bad"), F.min("gid").alias("first"),
        F.max("gid").alias("last"))
    overlap = F.coalesce(F.max("last").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)) >= F.col("first"), F.lit(False))
    return per_file.withColumn("bad", F.col("bad") + overlap.cast("long")).agg(
        F.sum("n").alias("records"), F.sum("bad").alias("out_of_order"))


@query("enriched_headers", """
SELECT gid, gid || ' | genome=' || COALESCE(dataset_id, 'NA') || ' | phylum=' || COALESCE(phylum, 'NA') || ' | length=' ||
       COALESCE(CAST(length AS VARCHAR), 'NA') AS header FROM catalogue""", CAT)
def q_headers(spark, d):
    return sg.catalogue(spark, d).select("gid", X.enriched_header().alias("header"))


@query("file_hashes", f"""
SELECT dataset_id, sha256(string_agg({FASTA_SQL}, '' ORDER BY gid)) AS sha256,
       CAST(strlen(string_agg({FASTA_SQL}, '' ORDER BY gid)) AS BIGINT) AS size
FROM catalogue WHERE seq_type = 'AA' GROUP BY dataset_id""", CAT)
def q_hashes(spark, d):
    """Digest of every genome's FASTA file, as written by one partition."""
    path = scratch_path(spark, "hashed")
    X.export_fasta_by_genome(sg.catalogue(spark, d), path, "AA", num_partitions=1)
    return R.file_hashes(spark, f"{path}/*/part-*").select(
        F.regexp_extract("path", "dataset_id=([^/]+)/", 1).alias("dataset_id"), "sha256", "size")


@query("file_digests", f"""
SELECT dataset_id, sha256(string_agg({FASTA_SQL}, '' ORDER BY gid)) AS sha256,
       CAST(strlen(string_agg({FASTA_SQL}, '' ORDER BY gid)) AS BIGINT) AS size
FROM catalogue WHERE seq_type = 'AA' GROUP BY dataset_id""", CAT)
def q_digests(spark, d):
    """The same digests, streamed in bounded memory, for files of any size."""
    path = scratch_path(spark, "hashed")
    X.export_fasta_by_genome(sg.catalogue(spark, d), path, "AA", num_partitions=1)
    return ranges.file_digests(spark, f"{path}/*/part-*", chunk_bytes=10_000).select(
        F.regexp_extract("path", "dataset_id=([^/]+)/", 1).alias("dataset_id"), "sha256", "size")


@query("verify_checksums", """
SELECT dataset_id, n AS state, n IN (0, 1) AS verified FROM (
  SELECT DISTINCT dataset_id, CAST(regexp_extract(dataset_id, '([0-9]+)$', 1) AS INTEGER) % 4 AS n FROM catalogue WHERE seq_type = 'AA')""", CAT)
def q_verify(spark, d):
    """Genomes by turns with the right digest (0), none (1), a wrong one (2) and a missing file (3)."""
    path = scratch_path(spark, "verified")
    X.export_fasta_by_genome(sg.catalogue(spark, d), path, "AA", num_partitions=1)
    listed = R.manifest(spark, f"{path}/*/part-*", "", "faa", "v1").withColumn(
        "dataset_id", F.regexp_extract("uri", "dataset_id=([^/]+)/", 1))
    state = F.regexp_extract("dataset_id", r"(\d+)$", 1).cast("int") % 4
    listed = listed.withColumn("sha256", F.when(state == 1, F.lit(None)).when(state == 2, F.reverse("sha256")).otherwise(F.col("sha256")))
    listed = listed.withColumn("uri", F.when(state == 3, F.concat("uri", F.lit(".gone"))).otherwise(F.col("uri")))
    return R.verify_checksums(listed, R.file_hashes(spark, f"{path}/*/part-*")).select("dataset_id", state.alias("state"), "verified")


@query("get_product_files", """
WITH p AS (SELECT dataset_id, product, uri, sha256, concat('v', CAST((created_epoch - 1700000000) // 200 AS VARCHAR)) AS version,
             (created_epoch - 1700000000) // 200 AS age FROM products WHERE dataset_id = 'src1' AND product = 'faa')
SELECT dataset_id, product, uri, sha256, version FROM p WHERE age = (SELECT MAX(age) FROM p)""", ("products",))
def q_get_product(spark, d):
    """All files of the newest version of one product; versions have many files."""
    age = F.floor((F.unix_timestamp("created_at") - 1700000000) / 200)
    p = sg.products(spark, d).withColumn("version", F.concat(F.lit("v"), age.cast("string"))) \
          .withColumn("created_at", F.timestamp_seconds(age))
    return R.get_product(p, "src1", "faa").select("dataset_id", "product", "uri", "sha256", "version")


@query("valid_vectors", """
SELECT label, CAST(COUNT(*) FILTER (WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS BIGINT) AS valid,
       CAST(COUNT(*) FILTER (WHERE vec_id % 7 = 0 OR vec_id % 11 = 0) AS BIGINT) AS rejected
FROM embeddings GROUP BY label""")
def q_valid(spark, d):
    """Vectors cut short (id % 7 = 0) or missing (id % 11 = 0) are told from whole ones."""
    e = sg.table(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(
        F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("vector"))
    good, bad = K.valid_vectors(e, "vector", 64)
    both = good.select("label", F.lit(1).alias("valid"), F.lit(0).alias("rejected")).unionByName(
        bad.select("label", F.lit(0).alias("valid"), F.lit(1).alias("rejected")))
    return both.groupBy("label").agg(F.sum("valid").alias("valid"), F.sum("rejected").alias("rejected"))


@query("export_hits_readback", """
SELECT form, gid, phylum, length, sequence FROM catalogue, (SELECT unnest(['fasta', 'tsv', 'json']) AS form)
WHERE gid IN (SELECT sseqid FROM protein_hits)""", CAT + ("protein_hits",))
def q_export_hits(spark, d):
    """Extracted hits as enriched FASTA, TSV and JSON lines, each read back."""
    root = scratch_path(spark, "hits")
    found = H.extract_hits(sg.protein_hits(spark, d), sg.catalogue(spark, d), "sseqid")
    X.export_hits(found, f"{root}/fasta", f"{root}/tsv", f"{root}/json")
    head = F.split("description", r" \| ")
    value = lambda i, name: F.regexp_replace(head.getItem(i), f"^{name}=", "")
    fasta = files.read_fasta(spark, f"{root}/fasta").select(
        F.lit("fasta").alias("form"), head.getItem(0).alias("gid"), value(2, "phylum").alias("phylum"),
        value(3, "length").cast("int").alias("length"), "sequence")
    tsv = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/tsv").select(
        F.lit("tsv").alias("form"), "gid", "phylum", F.col("length").cast("int").alias("length"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    json = spark.read.schema("gid string, phylum string, length int, sequence string").json(f"{root}/json").select(
        F.lit("json").alias("form"), "gid", "phylum", "length", "sequence")
    return fasta.unionByName(tsv).unionByName(json)


@query("write_hits_readback", """
SELECT h.qseqid, h.sseqid, h.bitscore, h.evalue, m.dataset_id, m.length AS target_length
FROM protein_hits h LEFT JOIN catalogue m ON m.gid = h.sseqid""", CAT + ("protein_hits",))
def q_write_hits(spark, d):
    """The raw table without a header and the annotated one with a header, read back and joined."""
    root = scratch_path(spark, "written-hits")
    raw = sg.protein_hits(spark, d)
    X.write_hits(raw, f"{root}/raw", H.enrich_protein_hits(raw, sg.catalogue(spark, d), "sseqid"), f"{root}/annotated")
    hits = files.read_blast_hits(spark, f"{root}/raw").select("qseqid", "sseqid", "bitscore", "evalue")
    meta = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/annotated").select(
        F.col("qseqid").alias("q"), F.col("sseqid").alias("s"), "dataset_id", F.col("target_length").cast("int").alias("target_length"))
    return hits.join(meta, (F.col("qseqid") == F.col("q")) & (F.col("sseqid") == F.col("s"))).drop("q", "s")


@query("write_placement_readback", """
WITH best AS (SELECT "Query_name" AS query_id, "Ref_name" AS dataset_id, MAX("ANI") AS ani FROM ani_hits GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ani DESC, dataset_id) AS place FROM best)
SELECT query_id, CAST(place AS INTEGER) AS place, dataset_id, ani, CAST((SELECT COUNT(*) FROM best b WHERE b.query_id = r.query_id) AS BIGINT) AS matches
FROM r WHERE place <= 10""", ("ani_hits",))
def q_write_placement(spark, d):
    """The ten best matches of every query from the JSON lines, and the size of its whole table in TSV."""
    root = scratch_path(spark, "written-placement")
    ani = sg.ani_hits(spark, d).groupBy(F.col("Query_name").alias("query_id"), F.col("Ref_name").alias("dataset_id")).agg(F.max("ANI").alias("ani"))
    placement = ani.groupBy("query_id").agg(F.max("ani").alias("best"))
    X.write_placement(placement, root, ani_hits=ani, top=10)
    lists = spark.read.schema("query_id string, ani_top_matches array<struct<dataset_id: string, ani: double>>").json(f"{root}/placement_json")
    best = lists.select("query_id", F.posexplode("ani_top_matches").alias("place", "m")).select(
        "query_id", (F.col("place") + 1).alias("place"), "m.dataset_id", "m.ani")
    sizes = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/ani_matches").groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"))
    return best.join(sizes, "query_id")


@query("mart_genome_statistics")
def q_mart_statistics(spark, d):
    """The genome statistics mart read back."""
    root = scratch_path(spark, "marts")
    build_marts(sg.catalogue(spark, d), root, names=("genome_statistics",))
    wanted = an.genome_statistics(sg.catalogue(spark, d)).columns
    return _round_stats(read_mart(spark, root, "genome_statistics").select(*wanted))


ORACLE["mart_genome_statistics"] = ORACLE["genome_statistics"]
