"""File sources (S1-S6, S8-S12) as DataFrame readers.

Every reader is a distributed scan: FASTA is split on record boundaries by
the text source itself (``lineSep="\\n>"``), TSVs are read with explicit
string schemas and typed with ``try_cast``.  Only tiny header probes (one
line) touch the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S


# ------------------------------------------------------------------ FASTA

def read_fasta(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Multi-FASTA -> (record_id, description, sequence, file).

    ``lineSep="\\n>"`` makes each text row one record, and Hadoop's line reader
    resolves records that straddle split boundaries, so a large file is read by
    many tasks.  ``record_id`` is the title up to the first blank; sequence
    lines are joined with all whitespace (including ``\\r``) removed.
    Gzip input is not splittable: pass ``min_partitions`` to spread the
    records after reading.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    rec = F.regexp_replace(F.col("value"), "^>", "")
    parts = F.split(rec, "\n", 2)
    title = F.regexp_replace(parts.getItem(0), "\r$", "")
    body = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    out = (raw.select(title.alias("title"), body.alias("body"), F.col("_metadata.file_path").alias("file"))
           .filter(F.length(F.trim(F.col("title"))) > 0)
           .select(F.regexp_extract("title", r"^\s*(\S+)", 1).alias("record_id"),
                   F.trim(F.col("title")).alias("description"),
                   F.regexp_replace("body", r"\s+", "").alias("sequence"),
                   "file"))
    if min_partitions:
        out = out.repartition(min_partitions)
    return out


# ------------------------------------------------------- metadata TSVs

def normalise_header(name: str) -> str:
    return name.lower().replace(" ", "_").replace("/", "_")


def _read_tsv_strings(spark: SparkSession, path: str) -> DataFrame:
    df = (spark.read.option("sep", "\t").option("header", True).option("quote", '"')
          .option("inferSchema", False).csv(path))
    return df.toDF(*[normalise_header(c) for c in df.columns])


def _na_clean(c: str) -> Column:
    # the CSV source reads an empty field as null; the metadata contract keeps
    # it as '' and treats only NA / N/A as missing
    v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return F.when(v.isin("NA", "N/A"), F.lit(None).cast("string")).otherwise(v)


def _typed(c: str, ints, floats) -> Column:
    v = _na_clean(c)
    if c in ints:
        # numeric coercion with failures -> null, integers rounded half-to-even
        return F.bround(v.try_cast("double")).cast("long").alias(c)
    if c in floats:
        return v.try_cast("double").alias(c)
    return v.alias(c)


def file_order() -> Column:
    """A sortable position of each row in its input files.

    (file, split start offset, increasing id within the task): rows of one
    split keep their order within a task, and split offsets order the splits,
    so this orders rows as they appear in the files -- without numbering them
    on the driver.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_metadata(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    """Genome metadata TSV: normalised headers, NA handling, typed numbers.

    ``with_position`` adds ``row_pos`` (file order) for last-row-wins dedupe.
    """
    df = _read_tsv_strings(spark, path)
    cols = [_typed(c, S.METADATA_INT_COLUMNS, S.METADATA_FLOAT_COLUMNS) for c in df.columns]
    if with_position:
        cols.append(file_order().alias("row_pos"))
    return df.select(*cols)


def read_classifier(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    """Classifier TSV: ``query`` -> ``genome``, ranks prefixed ``gvclass_``."""
    df = _read_tsv_strings(spark, path)
    renames = {"query": "genome", **S.CLASSIFIER_RANK_RENAMES}
    cols = []
    for c in df.columns:
        name = renames.get(c, c)
        cols.append(_typed(c, S.CLASSIFIER_INT_COLUMNS, S.CLASSIFIER_FLOAT_COLUMNS).alias(name))
    if with_position:
        cols.append(file_order().alias("row_pos"))
    return df.select(*cols)


# ------------------------------------------------ orthogroups/singletons

def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) with line_no = 0 for the first line, following file order.

    Lines of one split have consecutive ids within their task; splits are
    counted (one small row each) and put in order, and a line's number is its
    split's offset plus its place in the split.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), file_order().alias("at"))
    splits = lines.groupBy("at.file", "at.block").agg(F.min("at.row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), "first",
                            F.coalesce(before, F.lit(0)).alias("before"))
    on = (F.col("at.file") == F.col("f")) & (F.col("at.block") == F.col("b"))
    return lines.join(offsets, on).select((F.col("before") + F.col("at.row") - F.col("first")).alias("line_no"), "line")


def read_orthogroups(spark: SparkSession, path: str, split_cells: bool = True) -> DataFrame:
    """Orthogroup matrix -> (gid, orthogroup_id).

    The first three columns are counts; every other non-``*`` cell names a
    member protein.  The orthogroup id is the 1-based data row number.
    ``split_cells`` splits comma-joined co-orthologs into separate members
    (the reference keeps them as one unmatched id).  A protein listed in
    several rows belongs to the last one.
    """
    lines = _numbered_lines(spark, path).filter(F.col("line_no") > 0)
    cells = lines.select(F.col("line_no"), F.posexplode(F.split(F.trim(F.regexp_replace("line", "\r$", "")), "\t")).alias("pos", "cell"))
    members = cells.filter((F.col("pos") >= 3) & (F.col("cell") != "*"))
    if split_cells:
        members = members.select("line_no", F.explode(F.split("cell", ",")).alias("cell"))
    members = members.filter(F.length("cell") > 0)
    return (members.groupBy(F.col("cell").alias("gid"))
            .agg(F.max("line_no").cast("string").alias("orthogroup_id")))


def read_singletons(spark: SparkSession, path: str) -> DataFrame:
    """Singleton table -> distinct (gid): first non-``*`` member cell of each row after the header line."""
    lines = _numbered_lines(spark, path).filter(F.col("line_no") > 0)
    fields = F.split(F.trim(F.regexp_replace("line", "\r$", "")), "\t")
    members = F.filter(fields, lambda c, i: (i >= 3) & (c != "*") & (c != ""))
    return (lines.select(F.try_element_at(members, F.lit(1)).alias("gid"))
            .filter(F.col("gid").isNotNull()).distinct())


# ------------------------------------------------------- annotations

def _annotation_header(spark: SparkSession, path: str) -> list[str]:
    probe = (spark.read.text(path).filter(F.col("value").startswith("#query")).limit(1).collect())
    if probe:
        return probe[0][0].strip().lstrip("#").split("\t")
    return ["query", *S.ANNOTATION_COLUMNS]


def read_annotations(spark: SparkSession, path: str, prefix: str = "emapper_") -> DataFrame:
    """Annotation TSV -> (gid, emapper_* x 20); last row per protein wins.

    The header is taken from the ``#query`` comment line (a one-line probe),
    so moved columns are followed; a fixed order is used when it is absent.
    ``-`` and empty -> null; evalue/score -> double (bad -> null); short rows
    give nulls.
    """
    header = _annotation_header(spark, path)
    idx = {c: i for i, c in enumerate(header)}
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), file_order().alias("at"))
    body = lines.filter((F.length(F.trim("line")) > 0) & ~F.trim("line").startswith("#"))
    fields = F.split(F.trim(F.col("line")), "\t")

    def field(name: str) -> Column:
        if name not in idx:
            return F.lit(None).cast("string")
        v = F.try_element_at(fields, F.lit(idx[name] + 1))
        return F.when((v == "") | (v == "-"), F.lit(None).cast("string")).otherwise(v)

    gid = field("query") if "query" in idx else F.try_element_at(fields, F.lit(1))
    cols = [gid.alias("gid"), F.col("at")]
    for c in S.ANNOTATION_COLUMNS:
        v = field(c)
        if c in ("evalue", "score"):
            v = v.try_cast("double")
        cols.append(v.alias(prefix + c))
    rows = body.select(*cols)
    keep = [prefix + c for c in S.ANNOTATION_COLUMNS]
    return (rows.groupBy("gid").agg(F.max_by(F.struct(*keep), F.col("at")).alias("a"))
            .select("gid", "a.*"))


# ------------------------------------------------------------ hits

def read_blast_hits(spark: SparkSession, path: str) -> DataFrame:
    """12-column tabular protein hits without header; an empty file is an empty frame."""
    return spark.read.schema(S.BLAST6).option("sep", "\t").csv(path)


def read_hmm_hits(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.schema(S.HMM_HITS).option("sep", "\t").option("header", header).csv(path)


def read_ani_hits(spark: SparkSession, path: str) -> DataFrame:
    """ANI table with header; the two percentile columns are optional (null when absent)."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    cols = []
    for f in S.ANI_HITS.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_hits_any(spark: SparkSession, path: str, id_column: str = "sseqid") -> tuple[DataFrame, str]:
    """Hit table with a header and a flexible id column.

    Uses ``id_column`` if present, else ``target_name``, else ``gid``; raises
    ``ValueError`` naming the columns otherwise.  Returns (hits, id column).
    """
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    for c in (id_column, "target_name", "gid"):
        if c in df.columns:
            return df, c
    raise ValueError(f"No id column ({id_column}, target_name, gid) in hits; columns: {df.columns}")
