"""K-mer counting and tetranucleotide frequency vectors (V1-V4, V8).

Counting is a two-level generate: each sequence is cut into chunks of
``chunk`` characters (one regex pass over the string), every chunk borrows the
first k-1 characters of the next one, and k-mers are generated inside the
short chunk.  Taking substrings of a long string at every position would walk
the string from its start each time (quadratic); chunks keep it linear.
Rows are generated and partially aggregated inside the same task, so only
(id, k-mer) partial counts are shuffled -- never the k-mer occurrences.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from .common import map_in_arrow, map_in_pandas

BASES = "ACGT"
TNF_DIM = 136


def _rc_code(code: int, k: int) -> int:
    out = 0
    for _ in range(k):
        out = (out << 2) | (3 - (code & 3))
        code >>= 2
    return out


@lru_cache(maxsize=8)
def canonical_classes(k: int = 4) -> tuple[tuple[str, int, int], ...]:
    """(kmer, code, class) for all 4^k k-mers.

    A k-mer and its reverse complement share a class; classes are numbered in
    increasing order of the smaller code (A<C<G<T, first base most
    significant), which is the order of first appearance when codes are
    enumerated from 0.  For k=4: 256 k-mers, 136 classes.
    """
    canon = sorted({min(c, _rc_code(c, k)) for c in range(4 ** k)})
    cls = {c: i for i, c in enumerate(canon)}
    rows = []
    for c in range(4 ** k):
        kmer = "".join(BASES[(c >> (2 * (k - 1 - j))) & 3] for j in range(k))
        rows.append((kmer, c, cls[min(c, _rc_code(c, k))]))
    return tuple(rows)


def canonical_index(spark: SparkSession, k: int = 4) -> DataFrame:
    """(kmer, idx) lookup table: 4^k rows (256 for k=4), safe to broadcast."""
    return spark.createDataFrame([(m, i) for m, _, i in canonical_classes(k)], "kmer string, idx int")


def kmer_occurrences(df: DataFrame, k: int, id_cols: list[str], seq_col: str = "sequence",
                     chunk: int = 256) -> DataFrame:
    """One row per k-mer window: (*id_cols, kmer).  Windows of every letter are
    produced; callers filter the alphabet (or inner-join a k-mer table).

    Chunk starts are exploded first and each chunk (with the k - 1 letters
    after it) is cut by offset, then positions inside the chunk are exploded and
    the k-mer is cut from the short chunk.  Offsets into the sequence are
    resolved in one pass over pieces of ``chunk ** 2`` letters, so the work grows
    linearly with a record's length.
    """
    big = chunk * chunk
    first = df.filter(F.length(seq_col) >= k).select(*id_cols, F.col(seq_col).alias("_seq"))

    def cut(rows: DataFrame, size: int) -> DataFrame:
        start = F.explode(F.sequence(F.lit(1), F.length("_seq") - (k - 1), F.lit(size))).alias("_p")
        return (rows.select(*id_cols, "_seq", start)
                .select(*id_cols, F.substr(F.col("_seq"), F.col("_p"), F.lit(size + k - 1)).alias("_seq")))

    pos = F.explode(F.sequence(F.lit(1), F.length("_seq") - (k - 1))).alias("_p")
    return (cut(cut(first, big), chunk).select(*id_cols, "_seq", pos)
            .select(*id_cols, F.substr(F.col("_seq"), F.col("_p"), F.lit(k)).alias("kmer")))


def decode_kmer(code: Column, k: int, alphabet: str) -> Column:
    """Integer code -> k-mer text: the code's base-len(alphabet) digits, mapped to letters."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:len(alphabet)]
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, len(alphabet)), k, "0"), digits, alphabet)


def kmer_counts(df: DataFrame, k: int = 4, id_col: str = "gid", seq_col: str = "sequence",
                alphabet: str | None = BASES, chunk: int = 256, method: str = "arrow") -> DataFrame:
    """V1: (id, kmer, count); windows with a letter outside ``alphabet`` are skipped.

    ``arrow`` (default, needs an alphabet): each record's k-mers are counted
    as integer codes inside its own task -- a record is one row, so no
    shuffle is needed -- and exploded as (code, count) pairs.  ``explode``:
    one row per window and a (id, kmer) aggregate.
    """
    if method == "arrow" and alphabet and len(alphabet) <= 36 and len(alphabet) ** k < 2 ** 63:
        import pandas as pd
        from pyspark.sql import types as T

        from ..functions.codes import code_counts

        def run(batches):
            for pdf in batches:
                codes, counts = [], []
                for s in pdf[seq_col].tolist():
                    c, n = code_counts(s or "", k, alphabet)
                    codes.append(c.astype("int64").tolist())
                    counts.append(n.astype("int64").tolist())
                yield pd.DataFrame({id_col: pdf[id_col], "codes": codes, "counts": counts})

        schema = T.StructType([df.schema[id_col], T.StructField("codes", T.ArrayType(T.LongType())),
                               T.StructField("counts", T.ArrayType(T.LongType()))])
        per = map_in_pandas(df.select(id_col, seq_col), run, schema)
        pairs = per.select(id_col, F.explode(F.arrays_zip("codes", "counts")).alias("z"))
        return pairs.select(id_col, decode_kmer(F.col("z.codes"), k, alphabet).alias("kmer"),
                            F.col("z.counts").alias("count"))
    occ = kmer_occurrences(df, k, [id_col], seq_col, chunk)
    if alphabet:
        occ = occ.filter(F.col("kmer").rlike(f"^[{alphabet}]+$"))
    return occ.groupBy(id_col, "kmer").agg(F.count(F.lit(1)).alias("count"))


def _class_counts(df: DataFrame, id_col: str, seq_col: str, chunk: int) -> DataFrame:
    """(id, idx, n) per canonical class, plus an (id, -1, 0) row for every input
    id so ids without any valid window still produce a (zero) vector."""
    spark = df.sparkSession
    occ = kmer_occurrences(df, 4, [id_col], seq_col, chunk)
    # 256-row table: proven size, broadcast; the inner join also drops windows
    # containing N or any other non-ACGT letter
    hits = occ.join(F.broadcast(canonical_index(spark, 4)), "kmer").select(id_col, "idx")
    ids = df.select(id_col, F.lit(-1).alias("idx"))
    return (hits.withColumn("n", F.lit(1)).unionByName(ids.withColumn("n", F.lit(0)))
            .groupBy(id_col, "idx").agg(F.sum("n").alias("n")))


def _to_vector(class_counts: DataFrame, id_col: str) -> DataFrame:
    per = class_counts.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("idx") >= 0, F.struct("idx", "n")))).alias("m"),
        F.sum("n").alias("total"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(TNF_DIM - 1)), lambda i: F.when(
        F.col("total") > 0, (F.coalesce(F.element_at(F.col("m"), i), F.lit(0)) / F.col("total")))
        .otherwise(F.lit(0.0)).cast("float"))
    return per.select(id_col, vec.alias("tnf_136"), F.col("total").alias("windows"))


@lru_cache(maxsize=1)
def _class_matrix():
    """(256, 136): 1 where a 4-mer code is of a class."""
    import numpy as np
    out = np.zeros((4 ** 4, TNF_DIM), dtype=np.int64)
    for _, code, i in canonical_classes(4):
        out[code, i] = 1
    return out


def class_counts_batch(seqs) -> "list":
    """Canonical 4-mer class counts (136 ints) of each sequence in a batch.

    Small numpy helper run inside Arrow-batched tasks: ``COUNT_ROWS`` sequences are coded
    as one run of letters, a window is valid when its 4 letters are bases of one sequence, and (sequence, code)
    pairs are counted with one ``bincount`` per piece and folded to their reverse-complement classes.
    """
    import numpy as np

    from ..functions.codes import PIECE, dna_windows, joined

    out = []
    seqs = list(seqs)
    for low in range(0, len(seqs), COUNT_ROWS):
        data, ends = joined(seqs[low:low + COUNT_ROWS])
        counts = np.zeros((len(ends), 4 ** 4), dtype=np.int64)
        for at in range(0, len(data) - 3, PIECE):
            code, _, valid = dna_windows(data[at:at + PIECE + 3], 4)
            first, last = np.searchsorted(ends, [at, at + len(code) - 1], side="right")
            sizes = np.diff(np.concatenate([[at], ends[first:last], [at + len(code)]]))
            key = np.repeat(np.arange(last - first + 1) << 8, sizes)
            key |= code
            cells = (last - first + 1) << 8
            found = np.bincount(key, minlength=cells) - np.bincount(key[~valid], minlength=cells)
            counts[first:last + 1] += found.reshape(-1, 4 ** 4)
        out.extend(counts @ _class_matrix())
    return out


#: Records counted at a time: a task holds the count arrays of these alone.
COUNT_ROWS = 512


def list_array(rows):
    """One list of longs per numpy array of ``rows``."""
    import numpy as np
    import pyarrow as pa
    ends = np.cumsum([0, *(len(x) for x in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _arrow_class_counts(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id, class_counts) of every record, ``COUNT_ROWS`` records at a time."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, COUNT_ROWS):
                part = b.slice(at, COUNT_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(class_counts_batch(part.column(1).to_pylist()))],
                                                 [id_col, "class_counts"])

    schema = T.StructType([df.schema[id_col], T.StructField("class_counts", T.ArrayType(T.LongType()))])
    return map_in_arrow(df.select(id_col, seq_col), run, schema)


def _summed_class_counts(df: DataFrame, owner_col: str, seq_col: str) -> DataFrame:
    """(owner, class_counts): one row per owner and Arrow batch, the sum over its records there."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            owners = b.column(0).dictionary_encode(null_encoding="encode")
            place = owners.indices.to_numpy()
            sums = np.zeros((len(owners.dictionary), TNF_DIM), dtype=np.int64)
            for at in range(0, b.num_rows, COUNT_ROWS):
                counts = class_counts_batch(b.column(1).slice(at, COUNT_ROWS).to_pylist())
                np.add.at(sums, place[at:at + COUNT_ROWS], np.stack(counts))
            yield pa.RecordBatch.from_arrays([owners.dictionary, list_array(list(sums))], [owner_col, "class_counts"])

    schema = T.StructType([df.schema[owner_col], T.StructField("class_counts", T.ArrayType(T.LongType()))])
    return map_in_arrow(df.select(owner_col, seq_col), run, schema)


def tnf_136(df: DataFrame, id_col: str = "gid", seq_col: str = "sequence", chunk: int = 256,
            method: str = "arrow") -> DataFrame:
    """V3: (id, tnf_136 array<float>, windows): canonical 136-dim tetranucleotide
    frequencies; each valid window counted once under its class, divided by the
    number of valid windows; all zeros when there is none.

    ``method="arrow"`` (default): per-row vectors from Arrow batches -- no
    shuffle at all, each record is handled where it is read.  ``"explode"``:
    pure DataFrame plan (k-mer rows -> broadcast 256-row class table ->
    partial aggregates -> vector); same result, two small shuffles.
    """
    if method == "explode":
        return _to_vector(_class_counts(df, id_col, seq_col, chunk), id_col)
    if method != "arrow":
        raise ValueError(f"unknown method {method}")
    cc = _arrow_class_counts(df, id_col, seq_col)
    total = F.aggregate(F.col("class_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    vec = F.transform(F.col("class_counts"), lambda x: F.when(F.col("_t") > 0, x / F.col("_t"))
                      .otherwise(F.lit(0.0)).cast("float"))
    return cc.withColumn("_t", total).select(id_col, vec.alias("tnf_136"), F.col("_t").alias("windows"))


def genome_tnf(df: DataFrame, genome_col: str = "dataset_id", id_col: str = "gid",
               seq_col: str = "sequence", chunk: int = 256, method: str = "arrow") -> DataFrame:
    """V4: TNF of a whole genome = class counts summed over its contigs (no
    windows are invented across contig ends).

    Class counts (136 numbers) are summed per genome in the task that reads its contigs, an
    Arrow batch at a time; these few rows are exploded and summed per (genome, class), then turned into
    one vector per genome.
    """
    if method == "explode":
        cc = _class_counts(df.select(genome_col, id_col, seq_col), id_col, seq_col, chunk)
        owner = df.select(id_col, genome_col)
        per_genome = cc.join(owner, id_col).groupBy(genome_col, "idx").agg(F.sum("n").alias("n"))
        return _to_vector(per_genome, genome_col)
    cc = _summed_class_counts(df, genome_col, seq_col)
    per_class = (cc.select(genome_col, F.posexplode("class_counts").alias("idx", "n"))
                 .groupBy(genome_col, "idx").agg(F.sum("n").alias("n")))
    return _to_vector(per_class, genome_col)


def tnf_long(vectors: DataFrame, id_col: str = "gid", vec_col: str = "tnf_136", digits: int = 6) -> DataFrame:
    """Vectors as (id, idx, value) rows, values rounded (for tables and checks)."""
    return vectors.select(id_col, F.posexplode(vec_col).alias("idx", "value")) \
                  .withColumn("value", F.round(F.col("value").cast("double"), digits))


def valid_vectors(df: DataFrame, vec_col: str = "tnf_136", dim: int = TNF_DIM) -> tuple[DataFrame, DataFrame]:
    """V8: split rows into (valid, rejected) by vector length."""
    ok = F.coalesce(F.size(F.col(vec_col)) == dim, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def add_tnf(df: DataFrame, seq_col: str = "sequence", type_col: str = "seq_type",
            out_col: str = "tnf_136") -> DataFrame:
    """``df`` with ``tnf_136`` (null for non-NT rows): only nucleotide sequences travel to Python, in
    Arrow batches; nothing is shuffled."""
    import numpy as np

    from ..session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def vector(seqs: pd.Series) -> pd.Series:
        out = [None] * len(seqs)
        at = [i for i, s in enumerate(seqs) if s is not None]
        for i, c in zip(at, class_counts_batch([seqs.iloc[i] for i in at])):
            total = c.sum()
            out[i] = (c / total).astype(np.float32).tolist() if total else [0.0] * TNF_DIM
        return pd.Series(out, dtype=object)

    return df.withColumn(out_col, vector(F.when(F.col(type_col) == "NT", F.col(seq_col))))
