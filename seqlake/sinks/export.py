"""Exports (K1-K5, F10, F11, O3).

FASTA is written as text rows, one record per row (``>id\\n`` + 60-column
lines), range-partitioned and sorted by gid: the part files, concatenated in
name order, form one valid FASTA in gid order.  Per-genome exports are ONE
partitioned write (a folder per genome), not a loop of queries.  Counts come
from ``Observation`` metrics on the write itself (no second pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.sequence import fasta_record
from ..operators.common import partitions_for
from ..session import scratch_path


def _na(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("NA"))


def enriched_header(gid: str = "gid", genome: str = "dataset_id", phylum: str = "phylum",
                    length: str = "length") -> Column:
    """``gid | genome=.. | phylum=.. | length=..`` (missing values print NA)."""
    return F.concat_ws(" | ", F.col(gid), F.concat(F.lit("genome="), _na(genome)),
                       F.concat(F.lit("phylum="), _na(phylum)), F.concat(F.lit("length="), _na(length)))


def fasta_text(df: DataFrame, header: Column | None = None, width: int = 60) -> DataFrame:
    """(gid, value) with value = one FASTA record."""
    h = F.col("gid") if header is None else header
    return df.select("gid", fasta_record(h, F.col("sequence"), width).alias("value"))


def _letters(df: DataFrame) -> Column:
    """Letters of a record: the stored length where there is one, so that no sequence is read to plan a write."""
    return F.col("length") if "length" in df.columns else F.length("sequence")


def _write_sorted(df: DataFrame, order: list[str], header: Column, path: str, num_partitions: int | None, folder: str | None = None) -> int:
    """Write the records of ``df`` as FASTA text in ``order``; returns their number.

    Records are dealt as they are and wrapped after the exchange, so each is wrapped once; they are counted there
    too, since the exchange's sampling pass runs what is below it again.
    """
    obs = Observation("fasta_export")
    n = num_partitions or partitions_for(df.agg(F.sum(_letters(df).cast("long"))).first()[0])
    out = (df.repartitionByRange(n, *order).observe(obs, F.count(F.lit(1)).alias("records")).sortWithinPartitions(*order)
           .select(*([folder] if folder else []), fasta_record(header, F.col("sequence")).alias("value")))
    writer = out.write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", 5_000_000)
    (writer.partitionBy(folder) if folder else writer).text(path)
    return int(obs.get["records"])


def export_fasta(seqs: DataFrame, path: str, seq_type: str, dataset_id: str | None = None,
                 num_partitions: int | None = None) -> int:
    """K1: every record of one type (optionally one genome) as FASTA ordered by gid; returns the count."""
    df = seqs.filter(F.col("seq_type") == F.lit(seq_type))
    if dataset_id:
        df = df.filter(F.col("dataset_id") == F.lit(dataset_id))
    df = df.select("gid", "sequence", *[c for c in ("length",) if c in df.columns])
    return _write_sorted(df, ["gid"], F.col("gid"), path, num_partitions)


def export_fasta_by_genome(seqs: DataFrame, root: str, seq_type: str, genome_ids: list[str] | None = None,
                           num_partitions: int | None = None) -> int:
    """K2: one FASTA folder per genome (``dataset_id=<id>/part-*``) in a single write; returns the count.

    Range partitioning on (dataset_id, gid) -- not hashing on dataset_id --
    so a genome with a third of all records is written by many tasks; its
    part files, in name order, are in gid order.
    """
    df = seqs.filter(F.col("seq_type") == F.lit(seq_type))
    if genome_ids:
        wanted = seqs.sparkSession.createDataFrame([(g,) for g in genome_ids], "dataset_id string")
        df = df.join(wanted, "dataset_id", "left_semi")
    df = df.select("dataset_id", "gid", "sequence", *[c for c in ("length",) if c in df.columns])
    return _write_sorted(df, ["dataset_id", "gid"], F.col("gid"), root, num_partitions, "dataset_id")


def export_hits(extracted: DataFrame, fasta_path: str | None = None, tsv_path: str | None = None,
                json_path: str | None = None) -> None:
    """K3: extracted hit records as enriched FASTA, TSV (with header) and/or JSON lines."""
    if not (fasta_path or tsv_path or json_path):
        raise ValueError("at least one of fasta_path, tsv_path, json_path is required")
    if sum(bool(p) for p in (fasta_path, tsv_path, json_path)) > 1:  # found once for all forms
        stored = scratch_path(extracted.sparkSession, "extracted")
        extracted.write.option("compression", "zstd").parquet(stored)
        extracted = extracted.sparkSession.read.schema(extracted.schema).parquet(stored)
    if fasta_path:
        _write_sorted(extracted, ["gid"], enriched_header(), fasta_path, None)
    if tsv_path:
        extracted.write.mode("overwrite").option("sep", "\t").option("header", True).csv(tsv_path)
    if json_path:
        extracted.write.mode("overwrite").json(json_path)


def write_hits(raw: DataFrame, raw_path: str, annotated: DataFrame | None = None,
               annotated_path: str | None = None) -> None:
    """K4: raw 12-column hit table without header, plus the annotated table with header."""
    raw.write.mode("overwrite").option("sep", "\t").option("header", False).csv(raw_path)
    if annotated is not None and annotated_path:
        annotated.write.mode("overwrite").option("sep", "\t").option("header", True).csv(annotated_path)


def write_placement(placement: DataFrame, root: str, tnf_hits: DataFrame | None = None,
                    ani_hits: DataFrame | None = None, top: int = 10) -> None:
    """K5: placement rows as TSV; the whole TNF and ANI tables as TSV; and JSON lines, one per
    query, whose ``tnf_top_matches`` and ``ani_top_matches`` list the best ``top`` matches."""
    placement.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{root}/placement_tsv")
    out = placement
    for hits, name, order in ((tnf_hits, "tnf", ["tnf_distance", "dataset_id"]), (ani_hits, "ani", ["-ani", "dataset_id"])):
        if hits is None:
            continue
        hits.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{root}/{name}_matches")
        key = [(-F.col(c[1:]) if c[0] == "-" else F.col(c)) for c in order]
        ranked = hits.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*key)))
        lists = (ranked.filter(F.col("_rank") <= top).groupBy("query_id")
                 .agg(F.array_sort(F.collect_list(F.struct("_rank", *[c for c in hits.columns if c != "query_id"])))
                      .alias(f"{name}_top_matches")))
        lists = lists.withColumn(f"{name}_top_matches", F.transform(f"{name}_top_matches", lambda x: x.dropFields("_rank")))
        out = out.join(lists, "query_id", "left")
    out.write.mode("overwrite").json(f"{root}/placement_json")
