"""Sequences as a table of overlapping chunks (V1, V3, V4): one long contig is many rows, and so many tasks.

A chunk holds ``core`` letters of its sequence and up to ``overlap`` letters after them, so every k-mer of up to
``overlap + 1`` letters starts in the core of exactly one chunk.  Chunks come from records
(:func:`write_chunks`) or from FASTA files line by line (:func:`read_fasta_chunks`), where a sequence is never
one row and may be longer than a row can hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import code_counts
from ..session import scratch_path
from .common import map_in_arrow
from .kmers import BASES, TNF_DIM, class_counts_batch, decode_kmer, list_array

CORE = 1 << 20
OVERLAP = 30
#: Letters that one partition of summed k-mers should stand for.
PARTITION_LETTERS = 8 << 20
#: Letters of one sequence whose chunks are dealt to one task.
STRETCH = 64 << 20


def cut_chunks(seqs: DataFrame, id_cols: list[str], seq_col: str = "sequence", core: int = CORE, overlap: int = OVERLAP) -> DataFrame:
    """(*id_cols, place, core, sequence): the chunks of every sequence; an empty or null one is one empty chunk."""
    rows = seqs.select(*id_cols, seq_col)
    width = len(id_cols)

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(width)[i].as_py() or ""
                starts = range(0, max(1, len(text)), core)
                for at in range(0, len(starts), 64):  # a batch of chunks at a time
                    part = starts[at:at + 64]
                    ids = [c.take(pa.array([i] * len(part))) for c in b.columns[:width]]
                    yield pa.RecordBatch.from_arrays(
                        [*ids, pa.array(part, pa.int64()), pa.array([min(core, len(text) - s) for s in part], pa.int32()),
                         pa.array([text[s:s + core + overlap] for s in part], pa.string())], [*id_cols, "place", "core", "sequence"])

    return map_in_arrow(rows, cut, T.StructType([*rows.schema.fields[:width], T.StructField("place", T.LongType()),
                                                 T.StructField("core", T.IntegerType()), T.StructField("sequence", T.StringType())]))


def write_chunks(seqs: DataFrame, path: str, id_cols: list[str], seq_col: str = "sequence", core: int = CORE,
                 overlap: int = OVERLAP) -> None:
    """Store the chunks of ``seqs``, dealt by ids and stretch of places so that no task holds a whole long sequence,
    while the chunks of a short one lie one after the other."""
    (cut_chunks(seqs, id_cols, seq_col, core, overlap).repartition(*id_cols, F.floor(F.col("place") / STRETCH))
     .sortWithinPartitions(*id_cols, "place")
     .write.option("compression", "zstd").parquet(path))


def read_fasta_chunks(spark: SparkSession, path: str, core: int = CORE, overlap: int = OVERLAP) -> DataFrame:
    """(record_id, description, place, core, sequence) of FASTA files, read line by line.

    A task cuts the lines of its part of a file into pieces; a piece that continues a record of an earlier part
    learns the record and its place in it from one row per part.  The letters after a chunk come from
    the next two pieces, so a part of a file must be longer than ``overlap`` letters.  The pieces are written once.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"), "value")
    schema = ("file string, block long, record int, title string, at long, n int, sequence string, head string")

    def cut(batches):
        part, record, title, at, held = None, 0, None, 0, ""

        def piece(text):
            return (*part, record, title, at, len(text), text, text[:overlap])

        out = []
        for b in batches:
            for file, block, line in zip(*[c.to_pylist() for c in b.columns]):
                if (file, block) != part:
                    if part is not None:
                        out.append(piece(held))
                    part, record, title, at, held = (file, block), 0, None, 0, ""
                if line.startswith(">"):
                    out.append(piece(held))
                    record, title, at, held = record + 1, line[1:].strip(), 0, ""
                    continue
                held += "".join(line.split())
                while len(held) >= 2 * core:
                    out.append(piece(held[:core]))
                    at, held = at + core, held[core:]
                if len(out) >= 256:
                    yield _piece_batch(out)
                    out = []
        if part is not None:
            while len(held) > core:
                out.append(piece(held[:core]))
                at, held = at + core, held[core:]
            out.append(piece(held))
            yield _piece_batch(out)

    stored = scratch_path(spark, "fasta-pieces")
    map_in_arrow(lines, cut, schema).write.option("compression", "zstd").parquet(stored)
    pieces = spark.read.schema(schema).parquet(stored)
    last = F.struct("record", "at", "n", "title")
    parts = pieces.groupBy("file", "block").agg(F.max(last).alias("last"))
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # where the record that a part begins with was opened, and its letters up to there
    opened = F.when(F.col("last.record") > 0, F.struct(F.col("block").alias("block"), F.col("last.record").alias("record"), F.col("last.title").alias("title")))
    tail = F.col("last.at") + F.col("last.n")
    parts = parts.withColumn("open", F.last(opened, ignorenulls=True).over(before)).withColumn("tail", tail) \
                 .withColumn("base", F.sum("tail").over(before))
    # letters since the opening part: all tails up to here less the tails before the opening part
    opening = parts.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce("base", F.lit(0)).alias("skipped"))
    parts = parts.join(opening, (F.col("file") == F.col("f")) & (F.col("open.block") == F.col("b")), "left").select(
        F.col("file").alias("f"), F.col("block").alias("b"), "open", (F.coalesce("base", F.lit(0)) - F.coalesce("skipped", F.lit(0))).alias("letters"))
    joined = pieces.join(parts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    goes_on = F.col("record") == 0
    known = joined.select(
        F.struct("file", F.when(goes_on, F.col("open.block")).otherwise(F.col("block")).alias("block"),
                 F.when(goes_on, F.col("open.record")).otherwise(F.col("record")).alias("record")).alias("key"),
        F.when(goes_on, F.col("open.title")).otherwise(F.col("title")).alias("title"),
        (F.col("at") + F.when(goes_on, F.col("letters")).otherwise(F.lit(0))).alias("place"), "n", "sequence", "head") \
        .where("title is not null and trim(title) <> ''")
    # the letters after a piece: heads of the pieces that follow, small rows joined back
    heads = known.where("n > 0").select("key", "place", "head")
    follow = Window.partitionBy("key").orderBy("place")
    nexts = heads.select("key", "place", F.substring(F.concat(F.coalesce(F.lead("head", 1).over(follow), F.lit("")),
                                                              F.coalesce(F.lead("head", 2).over(follow), F.lit(""))), 1, overlap).alias("after"))
    filled = known.where("n > 0").join(nexts, ["key", "place"])
    empty = known.groupBy("key").agg(F.max("title").alias("title"), F.sum("n").alias("letters")).where("letters = 0").select(
        "title", F.lit(0).cast("long").alias("place"), F.lit(0).alias("core"), F.lit("").alias("sequence"))
    whole = filled.select("title", "place", F.col("n").alias("core"), F.concat("sequence", "after").alias("sequence")).unionByName(empty)
    return whole.select(F.regexp_extract("title", r"^\s*(\S+)", 1).alias("record_id"), F.trim("title").alias("description"),
                        "place", "core", "sequence")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      ["file", "block", "record", "title", "at", "n", "sequence", "head"])


def _runs(ids: pa.Array) -> tuple[pa.Array, list[tuple[int, int]]]:
    """Neighbouring rows of one id: the first row of each run, and (first row, row after the last) pairs."""
    same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, max(0, len(ids) - 1))), False).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.nonzero(~same.astype(bool))[0] + 1).tolist(), len(ids)] if len(ids) else [0]
    return pa.array(cuts[:-1], pa.int64()), list(zip(cuts[:-1], cuts[1:]))


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several pieces as counts of the whole."""
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def kmer_counts(chunks: DataFrame, k: int = 4, id_col: str = "gid", alphabet: str = BASES, overlap: int = OVERLAP) -> DataFrame:
    """V1 over chunks: (id, kmer, count), equal to :func:`.kmers.kmer_counts` of the whole sequences."""
    if k > overlap + 1:
        raise ValueError("k is longer than the chunks' overlap allows")

    def run(batches):
        for b in batches:
            at, runs = _runs(b.column(0))
            cores = b.column(1).to_pylist()
            codes, counts = [], []
            for low, high in runs:
                found = [code_counts(s[:core + k - 1], k, alphabet) for s, core in
                         zip(b.column(2).slice(low, high - low).to_pylist(), cores[low:high])]
                c, n = found[0] if len(found) == 1 else _added(found)
                codes.append(c.astype("int64"))
                counts.append(n.astype("int64"))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), list_array(codes), list_array(counts)], [id_col, "codes", "counts"])

    schema = T.StructType([chunks.schema[id_col], T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    pairs = map_in_arrow(chunks.select(id_col, "core", "sequence"), run, schema).select(
        id_col, F.explode(F.arrays_zip("codes", "counts")).alias("z")).select(id_col, F.col("z.codes").alias("code"), F.col("z.counts").alias("n"))
    # a task's table of sums is bounded: the partitions grow with the letters
    parts = -(-int(chunks.agg(F.sum(F.col("core").cast("long"))).first()[0] or 0) // PARTITION_LETTERS)
    if parts > int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        pairs = pairs.repartition(parts, id_col, "code")
    summed = pairs.groupBy(id_col, "code").agg(F.sum("n").alias("count"))
    return summed.select(id_col, decode_kmer(F.col("code"), k, alphabet).alias("kmer"), "count")


def tnf_136(chunks: DataFrame, id_col: str = "gid") -> DataFrame:
    """V3 (V4 with a genome's id) over chunks: (id, tnf_136, windows), equal to the vectors of the whole sequences."""
    def run(batches):
        for b in batches:
            at, runs = _runs(b.column(0))
            cores = b.column(1).to_pylist()
            sums = []
            for low, high in runs:  # chunks of one sequence that lie side by side are summed here
                pieces = [s[:core + 3] for s, core in zip(b.column(2).slice(low, high - low).to_pylist(), cores[low:high])]
                sums.append(np.sum(class_counts_batch(pieces), axis=0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), list_array(sums)], [id_col, "class_counts"])

    schema = T.StructType([chunks.schema[id_col], T.StructField("class_counts", T.ArrayType(T.LongType()))])
    counts = map_in_arrow(chunks.select(id_col, "core", "sequence"), run, schema)
    # element-wise sums: 136 partial aggregates of numbers, no explode
    summed = counts.groupBy(id_col).agg(F.array(*[F.sum(F.col("class_counts")[i]) for i in range(TNF_DIM)]).alias("class_counts"))
    total = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return summed.withColumn("windows", total).select(id_col, F.transform(
        "class_counts", lambda x: F.when(F.col("windows") > 0, x / F.col("windows")).otherwise(F.lit(0.0)).cast("float")).alias("tnf_136"), "windows")
