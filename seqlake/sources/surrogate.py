"""Catalogue tables derived from the driver's parquet tables.

The driver data holds no biological sequences, so the catalogue is derived
deterministically: every ``documents`` row becomes one sequence record of
genome ``documents.source`` (one in five of each genome a protein, the rest
recoded to nucleotides), and ``nation`` x ``region`` provide the genome metadata.  The
same definitions exist as DuckDB SQL in ``seqlake.plans.views``; the two are
written independently so the oracle check compares two implementations.

Everything here is a lazy projection of a parquet scan: Catalyst prunes the
columns each query needs and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_col

# Letter recoding used to turn prose into sequences.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
NT_RECODE = "ACGTACGTACGTACGTACGTACGTAC"
# raw FASTA-like records use lower case and include N and U so that
# normalisation and window skipping are exercised
RAW_NT_RECODE = "acgtacgtnacgtacgtacguacgta"
# blanks and marks, which are no letters; digits and accented letters and what they become
MARKS = r"[\x00-\x20\x7f\p{P}\p{S}\p{Z}]"
EXTRA_LETTERS = "0123456789àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
EXTRA_RECODE = "adeghiklmnaaaaaaaceeeeiiiinooooooouuuuyys"


# tables whose rows carry heavy per-row work (long texts, vectors)
SPREAD = ("documents", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  The small ones are single files of one row group, which no split size
    divides; such a scan is one task, so its rows are dealt to all cores first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and len(df.inputFiles()) < cores else df


def _s(x) -> F.Column:
    return x.cast("string")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per genome: metadata + classifier lineage + representative flag."""
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    j = nation.join(region, nation.n_regionkey == region.r_regionkey)
    lineage = F.concat(F.lit("d_"), F.col("r_name"), F.lit(";p_"), F.col("r_name"),
                       F.lit(";c_C"), _s(n % 3), F.lit(";o_"), F.col("n_name"),
                       F.lit(";f_F"), _s(n % 5), F.lit(";g_G"), _s(n % 8),
                       F.lit(";s_S"), _s(n % 9))
    return j.select(
        F.concat(F.lit("src"), _s(n)).alias("dataset_id"),
        F.concat(F.lit("src"), _s(n)).alias("genome"),
        F.concat(F.lit("genome "), F.col("n_name")).alias("common_name"),
        F.when(n % 7 == 6, F.lit("")).otherwise(F.lit("Viruses")).alias("domain"),
        F.col("r_name").alias("phylum"),
        F.concat(F.lit("C"), _s(n % 3)).alias("class"),
        F.when(n % 6 == 5, F.lit("")).otherwise(F.col("n_name")).alias("order"),
        F.when(n % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("F"), _s(n % 5))).alias("family"),
        F.concat(F.lit("G"), _s(n % 8)).alias("genus"),
        F.when(n % 6 == 5, F.lit("unclassified"))
         .when(n % 6 == 4, F.lit(None).cast("string"))
         .when(n % 6 == 3, F.concat(F.lit("d_"), F.col("r_name"), F.lit(";o_NA")))
         .otherwise(lineage).alias("taxonomy_majority"),
        F.when(n % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sp"), _s(n % 7))).alias("gvclass_species"),
        F.concat(F.lit("G"), _s(n % 8)).alias("gvclass_genus"),
        F.when(n % 5 == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("F"), _s(n % 5))).alias("gvclass_family"),
        F.col("n_name").alias("gvclass_order"),
        F.concat(F.lit("C"), _s(n % 3)).alias("gvclass_class"),
        F.col("r_name").alias("gvclass_phylum"),
        F.concat(F.lit("M"), _s(n % 6)).alias("mcl_rep"),
        F.when(n % 4 == 2, F.lit(None).cast("double")).otherwise((n % 9).cast("double") / 8)
         .alias("order_confidence_score"),
        F.when(n % 4 == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("S"), _s(n % 4))).alias("s_cluster"),
        F.concat(F.lit("src"), _s(n - n % 2)).alias("skani_rep"),
        (n % 2 == 0).alias("is_skani_representative"),
        F.concat(F.lit("P"), _s(n % 3)).alias("pdm_cluster"),
        F.when(n % 4 == 0, F.lit("Marine")).when(n % 4 == 1, F.lit("Freshwater"))
         .when(n % 4 == 2, F.lit("")).otherwise(F.lit(None).cast("string")).alias("ecosystem"),
        F.when(n % 3 == 0, F.lit("Aquatic")).when(n % 3 == 1, F.lit("Terrestrial"))
         .otherwise(F.lit(None).cast("string")).alias("ecosystem_category"),
        F.concat(F.lit("T"), _s(n % 4)).alias("ecosystem_type"),
        F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("U"), _s(n % 2))).alias("ecosystem_subtype"),
        F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("H"), _s(n % 4))).alias("habitat"),
        F.when(n % 2 == 0, F.lit("IMG")).otherwise(F.lit("GenBank")).alias("source"),
        (F.lit(100000) + n * 7919).cast("long").alias("lenbp"),
        (F.lit(100) + n * 3).cast("long").alias("genecount"),
        (F.lit(1) + n).cast("long").alias("contigs"),
        (F.lit(20) + n).cast("double").alias("gcperc"),
        (F.lit(80) + n % 15).cast("double").alias("codingperc"),
        (n * 37 % 101).cast("double").alias("order_completeness"),
        F.when(n % 5 == 4, F.lit(None).cast("double"))
         .otherwise((n % 5).cast("double") / 4).alias("order_dup"),
    )


def _letters(text: F.Column) -> F.Column:
    """Every letter and digit of a text as one of a-z: blanks and marks go, accented letters and
    digits are recoded, letters of other alphabets become x.  The last pattern runs over the a-z between two
    others in one step; a search for single others tries every letter, at thrice the cost of all the rest."""
    kept = F.translate(F.lower(F.regexp_replace(text, MARKS, "")), EXTRA_LETTERS, EXTRA_RECODE)
    return F.regexp_replace(kept, r"\G([a-z]*+)[^a-z]", "$1x")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sequence record (NT contig or AA protein) with annotations."""
    d = F.col("doc_id")
    is_aa = F.floor(d / 20) % 5 == 0  # independent of the genome, which follows d % 20
    letters = _letters(F.col("text"))
    seq = F.when(is_aa, F.upper(letters)).otherwise(F.translate(letters, LETTERS, NT_RECODE))
    seq_type = F.when(is_aa, F.lit("AA")).otherwise(F.lit("NT"))
    base = table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("|"), F.col("source"), F.lit("_"), _s(d)).alias("gid"),
        F.col("source").alias("dataset_id"),
        F.concat(F.col("source"), F.lit("_"), _s(d)).alias("header"),
        seq_type.alias("seq_type"),
        seq.alias("sequence"),
        F.when(is_aa & (d % 3 != 0), F.concat(F.lit("OG"), _s(d % 7))).alias("orthogroup_id"),
        F.when(is_aa & (d % 3 != 0), F.lit(False))
         .when(is_aa & (d % 2 == 0), F.lit(True)).alias("is_singleton"),
        F.when(is_aa & (d % 4 != 0), F.upper(F.col("lang"))).alias("emapper_cog_category"),
        F.when(is_aa & ((d % 4 == 1) | (d % 4 == 2)),
               F.concat(F.lit("protein family "), _s(d % 13))).alias("emapper_description"),
        F.when(is_aa & (d % 3 != 2),
               F.concat(F.lit("PF"), _s(d % 7), F.lit(",PF"), _s(d % 11))).alias("emapper_pfams"),
        F.when(is_aa & (d % 2 == 0), F.concat(F.lit("ko"), _s(d % 9))).alias("emapper_kegg_pathway"),
    )
    return (base
            .withColumn("length", F.length("sequence"))
            .withColumn("gc_content", gc_col(F.col("sequence"), F.col("seq_type"))))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide ``sequences`` view: records joined to their genome's metadata.

    Records of genomes without metadata are dropped (inner join).  The genome
    table has one row per genome; the join is left to the planner, which
    broadcasts it when its estimated size is under the broadcast threshold
    (and AQE re-checks with the real size at run time).
    """
    return sequences(spark, sf_dir).join(genomes(spark, sf_dir), "dataset_id", "inner")


def protein_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAST-6 style protein hits (12 columns), ids with and without a catalogue match."""
    d = F.col("doc_id")
    own = F.concat(F.col("source"), F.lit("|"), F.col("source"), F.lit("_"), _s(d))
    return (table(spark, sf_dir, "documents").select(
        F.concat(F.lit("q"), _s(d % 10)).alias("qseqid"),
        F.when(d % 11 == 0, F.concat(F.lit("unknown|"), _s(d))).otherwise(own).alias("sseqid"),
        (F.lit(30) + d * 13 % 70).cast("double").alias("pident"),
        (F.lit(20) + d * 17 % 500).cast("int").alias("length"),
        (d % 7).cast("int").alias("mismatch"),
        (d % 3).cast("int").alias("gapopen"),
        F.lit(1).cast("int").alias("qstart"),
        (F.lit(20) + d * 17 % 500).cast("int").alias("qend"),
        (F.lit(1) + d % 50).cast("int").alias("sstart"),
        (F.lit(20) + d * 17 % 500 + d % 50).cast("int").alias("send"),
        F.when(d % 4 == 0, F.lit(0.001)).otherwise(F.lit(1e-30)).alias("evalue"),
        (d * 29 % 300).cast("double").alias("bitscore"),
    ))


def hmm_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile-search style hits (query_name, target_name, evalue, score, bias)."""
    return protein_hits(spark, sf_dir).select(
        F.regexp_replace("qseqid", "q", "HMM").alias("query_name"), F.col("sseqid").alias("target_name"),
        "evalue", F.col("bitscore").alias("score"), F.round(F.col("pident") / 10, 3).alias("bias"))


def ani_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANI-tool style hits: many per query, some to unknown genomes, both sides of 80/95."""
    d = F.col("doc_id")
    ref = F.when(d % 11 == 0, F.concat(F.lit("src9"), _s(d % 5), F.lit("|x_"), _s(d))) \
           .otherwise(F.concat(F.col("source"), F.lit("|"), F.col("source"), F.lit("_"), _s(d)))
    return (table(spark, sf_dir, "documents").select(
        F.lit("query.fna").alias("Ref_file"),
        F.lit("refs.fna").alias("Query_file"),
        (F.lit(76) + d * 7 % 24).cast("double").alias("ANI"),
        (F.lit(40) + d % 60).cast("double").alias("Align_fraction_ref"),
        (F.lit(50) + d % 50).cast("double").alias("Align_fraction_query"),
        ref.alias("Ref_name"),
        F.concat(F.lit("query"), _s(d % 3)).alias("Query_name"),
    ))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA-like records (id, sequence) before ingest: mixed header forms,
    lower case, U and N in nucleotides, genomes with and without metadata."""
    d = F.col("doc_id")
    g = F.concat(F.lit("src"), _s(d % 31))
    rid = (F.when(d % 4 == 0, F.concat(g, F.lit("|contig_"), _s(d)))
            .when(d % 4 == 1, F.concat(g, F.lit("_"), _s(d)))
            .when(d % 4 == 2, F.concat(g, F.lit("|c"), _s(d), F.lit("|x")))
            .otherwise(F.concat(F.lit("orphan"), _s(d), F.lit("x"))))
    letters = _letters(F.col("text"))
    seq = F.when(d % 5 == 0, letters).otherwise(F.translate(letters, LETTERS, RAW_NT_RECODE))
    return table(spark, sf_dir, "documents").select(rid.alias("record_id"), seq.alias("raw_sequence"),
                                                   d.alias("record_pos"))


def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows with repeated genomes (later rows win on ingest)."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("genome"),
        d.alias("row_pos"),
        F.when(d % 10 == 3, F.lit(None).cast("double")).otherwise((d % 97).cast("double"))
         .alias("order_completeness"),
        F.col("n_chars").alias("lenbp"),
        F.col("lang").alias("ecosystem"),
    )


def classifier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier rows (``query`` = genome); some genomes have none."""
    d = F.col("doc_id")
    return (table(spark, sf_dir, "documents")
            .select(F.when(F.col("source").endswith("5"), F.concat(F.lit("other_"), F.col("source")))
                    .otherwise(F.col("source")).alias("query"),
                    d.alias("row_pos"),
                    F.concat(F.lit("GO_"), F.upper(F.col("lang"))).alias("gvclass_order"),
                    F.concat(F.lit("d_V;o_"), F.upper(F.col("lang"))).alias("taxonomy_majority"),
                    (d % 89).cast("double").alias("order_completeness")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product registry entries, several versions per (dataset, product)."""
    d = F.col("doc_id")
    product = F.when(d % 3 == 0, F.lit("fna")).when(d % 3 == 1, F.lit("faa")).otherwise(F.lit("tnf"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset_id"),
        product.alias("product"),
        F.concat(F.lit("lake/"), F.col("source"), F.lit("/"), product, F.lit("/v"), _s(d), F.lit(".parquet")).alias("uri"),
        F.sha2(F.col("text"), 256).alias("sha256"),
        F.concat(F.lit("v"), _s(d)).alias("version"),
        F.timestamp_seconds(F.lit(1700000000) + d).alias("created_at"),
    )
