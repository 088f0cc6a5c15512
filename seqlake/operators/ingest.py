"""Ingest: FASTA records + genome tables -> the sequence lake.

One Spark job replaces the reference's batch loop and process pool: records
are parsed with column expressions, joined to genome metadata (broadcast when
the planner/AQE sees it is small, shuffle + skew-join splitting otherwise),
joined to orthogroups/annotations on ``gid`` (one shared hash partitioning
for the chain of joins), range-partitioned by (dataset_id, gid) and written
as zstd parquet partitioned by ``seq_type``.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.sequence import gc_col, header_cols, normalise_sequence, seq_type_col
from .analytics import latest_per_key


def parse_records(records: DataFrame, id_col: str = "record_id", seq_col: str = "sequence",
                  protein_u_to_t: bool = False) -> DataFrame:
    """(record id, raw sequence) -> gid, dataset_id, header, seq_type, length, gc, sequence."""
    dataset_id, header = header_cols(F.col(id_col))
    up = F.upper(F.col(seq_col))
    kind = seq_type_col(up)
    seq = normalise_sequence(up, kind, protein_u_to_t)
    out = records.select(
        "*",
        dataset_id.alias("_ds"), header.alias("_hd"), kind.alias("_kind"), seq.alias("_seq"))
    return out.select(
        F.concat_ws("|", "_ds", "_hd").alias("gid"),
        F.col("_ds").alias("dataset_id"),
        F.col("_hd").alias("header"),
        F.col("_kind").alias("seq_type"),
        F.length("_seq").alias("length"),
        gc_col(F.col("_seq"), F.col("_kind")).alias("gc_content"),
        F.col("_seq").alias("sequence"),
        *[c for c in records.columns if c not in (id_col, seq_col)],
    )


def dedupe_genomes(metadata: DataFrame, genome_col: str = "genome", order_col: str = "row_pos") -> DataFrame:
    """Later rows of the same genome win (partial max_by aggregate, skew safe)."""
    return latest_per_key(metadata, genome_col, order_col)


def representative_flag(genome: Column, skani_rep: Column) -> Column:
    """I8: a genome is a representative when it names itself; unknown -> false."""
    return F.coalesce(genome.eqNullSafe(skani_rep) & genome.isNotNull(), F.lit(False))


def merge_classifier(base: DataFrame, classifier: DataFrame | None, genome_col: str = "genome") -> DataFrame:
    """Classifier wins on the overlapping count columns; other name clashes
    get the classifier suffix; LEFT join keeps every base genome.  Without a
    classifier the classifier columns are added as typed nulls."""
    if classifier is None:
        missing = {c: F.lit(None).cast(t) for c, t in S.CLASSIFIER_COLUMNS.items() if c not in base.columns}
        return base.withColumns(missing)
    overlap = [c for c in S.CLASSIFIER_OVERLAP_COLUMNS if c in base.columns and c in classifier.columns]
    left = base.drop(*overlap)
    clash = [c for c in classifier.columns if c in left.columns and c != genome_col]
    right = classifier.withColumnsRenamed({c: f"{c}{S.CLASSIFIER_SUFFIX}" for c in clash})
    return left.join(right, genome_col, "left")


def genome_table(metadata: DataFrame, classifier: DataFrame | None = None,
                 genome_col: str = "genome", order_col: str | None = None) -> DataFrame:
    """S2+S3+I6+I7+I8: one row per genome with the representative flag."""
    base = dedupe_genomes(metadata, genome_col, order_col) if order_col else metadata
    merged = merge_classifier(base, classifier, genome_col)
    rep = F.col("skani_rep") if "skani_rep" in merged.columns else F.lit(None).cast("string")
    return merged.withColumn("is_skani_representative", representative_flag(F.col(genome_col), rep))


def keep_known_genomes(records: DataFrame, genomes: DataFrame, genome_col: str = "genome") -> DataFrame:
    """Records of genomes with metadata, joined to that metadata."""
    g = genomes.withColumnRenamed(genome_col, "dataset_id")
    return records.join(g, "dataset_id", "inner")


def unknown_genomes(records: DataFrame, genomes: DataFrame, genome_col: str = "genome") -> DataFrame:
    """Records skipped for lack of metadata, counted per genome id."""
    g = genomes.select(F.col(genome_col).alias("dataset_id"))
    return (records.join(g, "dataset_id", "left_anti")
            .groupBy("dataset_id").agg(F.count(F.lit(1)).alias("skipped_records")))


def attach_orthogroups(seqs: DataFrame, members: DataFrame, singletons: DataFrame,
                       rep_col: str = "is_skani_representative") -> DataFrame:
    """Representatives only: member -> (id, false); singleton -> (null, true); else nulls."""
    m = members.select("gid", F.col("orthogroup_id").alias("_og"))
    s = singletons.select("gid", F.lit(True).alias("_single"))
    j = seqs.drop("orthogroup_id", "is_singleton").join(m, "gid", "left").join(s, "gid", "left")
    rep = F.coalesce(F.col(rep_col), F.lit(False))
    return (j.withColumn("orthogroup_id", F.when(rep, F.col("_og")))
            .withColumn("is_singleton", F.when(rep & F.col("_og").isNotNull(), F.lit(False))
                        .when(rep & F.col("_single"), F.lit(True)))
            .drop("_og", "_single"))


def attach_annotations(seqs: DataFrame, annotations: DataFrame,
                       rep_col: str = "is_skani_representative") -> DataFrame:
    """Representatives get their annotation columns, everyone else nulls."""
    cols = [c for c in annotations.columns if c != "gid"]
    a = annotations.select("gid", *[F.col(c).alias(f"_a_{c}") for c in cols])
    j = seqs.drop(*[c for c in cols if c in seqs.columns]).join(a, "gid", "left")
    rep = F.coalesce(F.col(rep_col), F.lit(False))
    return j.select(*[c for c in j.columns if not c.startswith("_a_")],
                    *[F.when(rep, F.col(f"_a_{c}")).alias(c) for c in cols])


def build_sequences(records: DataFrame, genomes: DataFrame, members: DataFrame | None = None,
                    singletons: DataFrame | None = None, annotations: DataFrame | None = None,
                    genome_col: str = "genome", protein_u_to_t: bool = False) -> DataFrame:
    """I1-I11 as one lazy plan: parsed records of known genomes, wide."""
    parsed = parse_records(records.select("record_id", "sequence"), protein_u_to_t=protein_u_to_t)
    wide = keep_known_genomes(parsed, genomes, genome_col)
    if members is not None and singletons is not None:
        wide = attach_orthogroups(wide, members, singletons)
    if annotations is not None:
        wide = attach_annotations(wide, annotations)
    return wide


def to_contract(df: DataFrame) -> DataFrame:
    """Exactly the lake's columns, in order and type; absent ones are typed nulls, others are left out."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{c}`") if c.lower() in have else F.lit(None)).cast(t).alias(c)
                       for c, t in S.LAKE_COLUMNS])


def extra_columns(df: DataFrame) -> list[str]:
    """Columns that the lake contract does not have."""
    known = {c.lower() for c, _ in S.LAKE_COLUMNS}
    return [c for c in df.columns if c.lower() not in known]


#: Places of the input that the layout is sampled at, and the bytes read at each.
SAMPLED_PLACES = 256
SAMPLED_BYTES = 64 << 10


def sampled_headers(spark, paths: list[str], places: int = SAMPLED_PLACES, each: int = SAMPLED_BYTES) -> list[str]:
    """Titles of FASTA records at evenly spaced places of the files: where the bytes are, records are sampled.

    Reads ``places`` times ``each`` bytes at most, whatever the input's size; compressed files have no
    places and give none.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        for found in fs.globStatus(place) or []:
            inside = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            files += [(fs, f.getPath(), f.getLen()) for f in inside if f.isFile() and f.getLen()
                      and not f.getPath().getName().startswith(("_", ".")) and not f.getPath().getName().endswith((".gz", ".bz2", ".zst"))]
    total, titles, before = sum(n for *_, n in files), [], 0
    for fs, path, n in files:
        mine = [i for i in range(places) if before <= (i + 0.5) * total / places < before + n]
        before += n
        if not mine:
            continue
        stream = fs.open(path)
        try:
            for i in mine:
                at = max(0, min(int((i + 0.5) * total / places) - before + n, n - 1))
                stream.seek(at)
                text = bytes(stream.readNBytes(min(each, n - at))).decode("utf-8", "replace")
                start = 0 if at == 0 and text.startswith(">") else text.find("\n>") + 1
                if start or at == 0 and text.startswith(">"):
                    title = text[start + 1:].split("\n", 1)[0].split()
                    titles += title[:1]
        finally:
            stream.close()
    return titles


def range_bounds(titles: DataFrame, partitions: int) -> list[tuple[str, str]]:
    """At most ``partitions - 1`` ascending (dataset_id, gid) that cut the sampled records into equal parts."""
    dataset, header = header_cols(F.col("record_id"))
    keys = sorted((r["d"], r["g"]) for r in titles.select(dataset.alias("d"), F.concat_ws("|", dataset, header).alias("g")).collect())
    cuts = [keys[len(keys) * i // partitions] for i in range(1, partitions)] if keys else []
    return sorted(set(cuts))


def _part(bounds: list[tuple[str, str]], partitions: int) -> Column:
    """Number of the range that (dataset_id, gid) falls into; without bounds, a hash of the gid."""
    if not bounds:
        return F.pmod(F.xxhash64("gid"), F.lit(partitions)).cast("int")

    # annotations must be types here, not strings
    def part(dataset, gid):
        return pd.Series([bisect.bisect_right(bounds, key) for key in zip(dataset, gid)], dtype="int32")

    part.__annotations__ = {"dataset": pd.Series, "gid": pd.Series, "return": pd.Series}
    return F.pandas_udf("int")(part)("dataset_id", "gid")


def write_sequences(df: DataFrame, root: str, num_partitions: int, mode: str = "overwrite",
                    compute_tnf: bool = False, bounds: list[tuple[str, str]] | None = None) -> int:
    """Sorted lake: range partitions on (dataset_id, gid), zstd, by seq_type; returns the records written.

    Sorting makes row-group min/max statistics selective for every reference
    predicate (seq_type partition, dataset_id and gid ranges), and range
    partitioning on (dataset_id, gid) splits a hot genome over many tasks.
    ``overwrite`` replaces earlier files (re-ingest never duplicates).

    With ``bounds`` (from :func:`range_bounds`) ``df`` is computed once; without them Spark's range exchange
    computes it a second time for its own sample.  Vectors are computed and records counted after the
    exchange, once per record.  Every column group of a file has a Bloom filter on gid, so a lookup of an id within a
    file's range that the file does not hold reads no sequence pages.
    """
    from ..session import ship_package
    from .kmers import add_tnf

    ship_package(df.sparkSession)
    obs = Observation("ingest")
    if bounds is None:
        out = df.repartitionByRange(num_partitions, "dataset_id", "gid")
    else:
        dealt = df.withColumn("_part", _part(bounds, num_partitions))
        out = dealt.repartitionById(num_partitions, F.col("_part")).drop("_part")
    out = out.observe(obs, F.count(F.lit(1)).alias("written")).sortWithinPartitions("dataset_id", "gid")
    if compute_tnf:
        out = add_tnf(out)
    to_contract(out).write.mode(mode).options(**LAKE_OPTIONS).partitionBy("seq_type").parquet(root)
    return int(obs.get["written"])


#: Of the lake's Parquet files.  The Bloom filter's size follows the ids of a row group.
LAKE_OPTIONS = {"compression": "zstd", "maxRecordsPerFile": "5000000", "parquet.bloom.filter.enabled#gid": "true",
                "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(4 << 20)}


def ingest(spark, metadata_path: str, fasta_paths: list[str], root: str,
           classifier_path: str | None = None, orthogroups_path: str | None = None,
           singletons_path: str | None = None, annotations_path: str | None = None,
           num_partitions: int | None = None, compute_tnf: bool = True, tables_root: str | None = None,
           versioned: bool = False) -> dict:
    """Metadata -> (annotations if all three given) -> NT and AA -> lake.

    The FASTA files are read once: the layout comes from titles sampled at a bounded number of places, and
    records are counted as they are read.  Records of genomes without metadata are dropped before anything is shuffled.
    The report counts records read, written and skipped and names input columns that the lake contract has
    no place for.  With ``tables_root`` the normalised tables (genomes, taxonomy, annotations, orthogroups, tnf,
    sketch) are written too.

    ``versioned`` commits to a versioned lake (:mod:`.snapshots`): the genomes of the metadata file, and no others, are
    replaced, and the report has the new ``version``.  Without it the lake below ``root`` is replaced.
    """
    from ..sources import files
    from .common import input_bytes, partitions_for
    from .snapshots import commit_genomes, read_snapshot

    meta = files.read_metadata(spark, metadata_path, with_position=True)
    cls = None
    if classifier_path:
        cls = dedupe_genomes(files.read_classifier(spark, classifier_path, with_position=True)).drop("row_pos")
    genomes = genome_table(meta, cls, order_col="row_pos").drop("row_pos")
    members = singletons = annotations = None
    if orthogroups_path and singletons_path and annotations_path:
        members = files.read_orthogroups(spark, orthogroups_path)
        singletons = files.read_singletons(spark, singletons_path)
        annotations = files.read_annotations(spark, annotations_path)
    records = None
    for p in fasta_paths:
        r = files.read_fasta(spark, p).select("record_id", "sequence")
        records = r if records is None else records.unionByName(r)
    n = num_partitions or partitions_for(input_bytes(spark, fasta_paths))
    titles = spark.createDataFrame([(t,) for t in sampled_headers(spark, fasta_paths)], "record_id string")
    bounds = range_bounds(titles, n)
    obs = Observation("ingest_read")
    records = records.observe(obs, F.count(F.lit(1)).alias("read"))
    wide = build_sequences(records, genomes.withColumn("_genome", F.col("genome")), members, singletons, annotations)
    wide = wide.withColumnRenamed("_genome", "genome")
    report = {}

    def write(folder: str) -> None:
        report["records_written"] = write_sequences(wide, folder, n, compute_tnf=compute_tnf, bounds=bounds)

    if versioned:
        version = commit_genomes(spark, root, genomes.select(F.col("genome").alias("dataset_id")), write)
    else:
        write(root)
    read, written = int(obs.get["read"]), report["records_written"]
    if tables_root:
        from .tables import write_tables

        write_tables(spark, root, tables_root, seqs=read_snapshot(spark, root, version) if versioned else None)
    return {"records_read": read, "records_written": written, "records_skipped": read - written,
            "ignored_columns": extra_columns(genomes)} | ({"version": version} if versioned else {})
