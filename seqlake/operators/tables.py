"""Documented normalised tables (T1) and orthogroup statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import PHYLO_COLUMNS, RANK_PREFIX, clean_label, rank_raw

GENOME_COLUMNS = ["common_name", "domain", "phylum", "class", "order", "family", "genus", "taxonomy_majority",
                  "gvclass_species", "s_cluster", "skani_rep", "is_skani_representative", "pdm_cluster",
                  "ecosystem", "ecosystem_category", "ecosystem_type", "ecosystem_subtype", "habitat", "source",
                  "lenbp", "genecount", "contigs", "gcperc", "codingperc", "order_completeness", "order_dup"]


def genome_table(seqs: DataFrame, columns: list[str] = GENOME_COLUMNS) -> DataFrame:
    """``genomes``: one row per genome out of the wide table (genome columns
    are constant per genome; a partial aggregate keeps one row per task)."""
    cols = [c for c in columns if c in seqs.columns]
    return seqs.groupBy("dataset_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def taxonomy_long(genomes: DataFrame, anchored: bool = True) -> DataFrame:
    """``taxonomy``: (dataset_id, source, level, label) for both lineage sources."""
    triples = [F.struct(F.lit("classifier").alias("source"), F.lit(lv).alias("level"),
                        clean_label(rank_raw(F.col("taxonomy_majority"), lv, anchored)).alias("label"))
               for lv in RANK_PREFIX]
    triples += [F.struct(F.lit("phylo").alias("source"), F.lit(lv).alias("level"),
                         clean_label(F.col(col), na_is_missing=False).alias("label"))
                for lv, col in PHYLO_COLUMNS.items()]
    return genomes.select("dataset_id", F.explode(F.array(*triples)).alias("t")).select("dataset_id", "t.*")


# Annotation fields holding comma-separated lists.
MULTI_VALUED = ("emapper_pfams", "emapper_kegg_pathway", "emapper_gos", "emapper_ec", "emapper_kegg_ko")


def annotations_long(seqs: DataFrame, fields: list[str]) -> DataFrame:
    """``annotations``: (gid, field, value), list-valued fields exploded on ','."""
    pairs = [F.struct(F.lit(f.removeprefix("emapper_")).alias("field"),
                      (F.split(F.col(f), ",") if f.lower() in MULTI_VALUED else F.array(F.col(f))).alias("vals"))
             for f in fields]
    long = (seqs.filter(F.col("seq_type") == "AA")
            .select("gid", F.explode(F.array(*pairs)).alias("p"))
            .select("gid", F.col("p.field").alias("field"), F.explode("p.vals").alias("value")))
    return long.filter(F.col("value").isNotNull() & (F.trim("value") != "")) \
               .withColumn("value", F.trim("value"))


def orthogroup_stats(seqs: DataFrame) -> DataFrame:
    """A28 ``orthogroups``: members, genomes and an example member per orthogroup."""
    return (seqs.filter(F.col("orthogroup_id").isNotNull())
            .groupBy("orthogroup_id")
            .agg(F.count(F.lit(1)).alias("members"), F.countDistinct("dataset_id").alias("genomes"),
                 F.min("gid").alias("example_gid")))


TABLE_NAMES = ("genomes", "taxonomy", "annotations", "orthogroups", "tnf", "sketch")


def write_tables(spark, lake_root: str, root: str, sketch_k: int = 16, sketch_c: int = 1000,
                 seqs: DataFrame | None = None) -> dict[str, str]:
    """The normalised tables of a lake: genomes, taxonomy, annotations, orthogroups, and what searches
    and placement read instead of sequences -- tnf (vector and length per contig) and sketch (sampled
    k-mers per genome).  ``seqs`` is a lake read already, such as a version of a versioned one."""
    from ..sources.lake import open_catalog
    from .search import write_sketch

    seqs = open_catalog(spark, lake_root, view=None) if seqs is None else seqs
    out = {name: f"{root.rstrip('/')}/{name}" for name in TABLE_NAMES}

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(out[name])

    write("genomes", genome_table(seqs))
    write("taxonomy", taxonomy_long(spark.read.parquet(out["genomes"])))
    write("annotations", annotations_long(seqs, [c for c in seqs.columns if c.startswith("emapper_")
                                                 and c not in ("emapper_evalue", "emapper_score")]))
    write("orthogroups", orthogroup_stats(seqs))
    write("tnf", seqs.filter((F.col("seq_type") == "NT") & F.col("tnf_136").isNotNull())
          .select("gid", "dataset_id", "seq_type", "length", "tnf_136"))
    write_sketch(seqs, out["sketch"], "dataset_id", sketch_k, sketch_c)
    return out
