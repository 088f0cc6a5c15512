"""Distributed candidate search by shared k-mers.

The reference shells out to single-machine search tools; here the same
questions are answered as Spark joins:

* ``protein_seed_search``: rank target proteins by distinct shared k-mers
  with each query protein (a seed/candidate search -- no alignment, no
  E-values; externally computed alignments come in through the hit readers).
* ``ani_estimate``: FracMinHash containment ANI (Mash 2016; FracMinHash
  2022-23): keep the canonical k-mers whose hash falls in the lowest 1/c of
  the hash space, C = |A n B| / |A|, ANI ~ 100 * C^(1/k).

K-mers are integer codes computed per record in Arrow batches (a small
numpy helper, ``seqlake.functions.codes``) where the record is read: no
k-mer string rows are materialised and sketching happens before any shuffle
(only sampled codes move).
There is one plan for every size.  Sketches are joined on the code by a plain
join: Spark broadcasts a small side at run time and splits skewed codes.
Protein searches count packs of targets against blocks of queries
(:mod:`.packs`), and a task gives the best targets per query, never all pairs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_in_arrow, map_in_pandas, stored

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def revcomp(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def _codes_per_row(df: DataFrame, owner_col: str, seq_col: str, fn) -> DataFrame:
    """(owner, code) rows: ``fn(sequence) -> distinct int codes`` run in Arrow
    batches where the rows are read (no shuffle); ``distinct`` afterwards
    merges owners spread over several records (partial aggregate)."""
    import pandas as pd
    from pyspark.sql import types as T

    def run(batches):
        for pdf in batches:
            owners, codes = [], []
            for o, s in zip(pdf[owner_col].tolist(), pdf[seq_col].tolist()):
                c = fn(s or "")
                owners.extend([o] * len(c))
                codes.append(c.astype("int64"))
            import numpy as np
            if owners:
                yield pd.DataFrame({owner_col: owners, "code": np.concatenate(codes)})

    schema = T.StructType([df.schema[owner_col], T.StructField("code", T.LongType(), False)])
    return map_in_pandas(df.select(owner_col, seq_col), run, schema).distinct()


#: Owners of one code that one partition of a stored sketch holds; a code with more is split.
CODE_OWNERS = 50_000
SKETCH_BUCKETS = 256


def write_sketch(seqs: DataFrame, path: str, owner_col: str = "dataset_id", k: int = 16, c: int = 1000) -> None:
    """Store the reference sketch (owner, code) once, clustered by code so a
    later join reads it without a shuffle-heavy rebuild."""
    (sketch(seqs.filter(F.col("seq_type") == "NT") if "seq_type" in seqs.columns else seqs, owner_col, k, c)
     .repartitionByRange("code").sortWithinPartitions("code")
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def store_sketch(seqs: DataFrame, path: str, owner_col: str = "dataset_id", k: int = 16, c: int = 1000,
                 buckets: int = SKETCH_BUCKETS, code_owners: int = CODE_OWNERS) -> None:
    """Store the sketch of every owner, co-partitioned for joins on the code.

    ``codes`` is bucketed and sorted by (code, split), so a search joins it where it lies.  A code of more than
    ``code_owners`` owners is split by a hash of the owner; ``splits`` names these codes and ``owners`` the size of every
    sketch.  ``buckets`` should reach the session's number of shuffle partitions, or Spark deals both sides anew.
    """
    spark = seqs.sparkSession
    found = sketch(seqs.filter(F.col("seq_type") == "NT") if "seq_type" in seqs.columns else seqs, owner_col, k, c)
    raw = scratch_path(spark, "sketch")
    found.write.parquet(raw)
    found = spark.read.schema(found.schema).parquet(raw)
    splits = found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > code_owners) \
                  .select("code", F.ceil(F.col("n") / code_owners).cast("int").alias("splits"))
    splits.write.mode("overwrite").parquet(f"{path}/splits")
    splits = spark.read.schema("code long, splits int").parquet(f"{path}/splits")
    dealt = found.join(splits, "code", "left").withColumn(
        "split", F.coalesce(F.pmod(F.xxhash64(owner_col), F.col("splits")), F.lit(0)).cast("int")).drop("splits")
    name = f"sketch_{uuid.uuid4().hex}"
    (dealt.write.mode("overwrite").option("compression", "zstd").option("path", f"{path}/codes")
     .bucketBy(buckets, "code", "split").sortBy("code", "split").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    found.groupBy(owner_col).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/owners")
    spark.createDataFrame([(owner_col, found.schema[owner_col].dataType.simpleString(), k, c, buckets)],
                          "owner_col string, owner_type string, k int, c int, buckets int").coalesce(1) \
         .write.mode("overwrite").parquet(f"{path}/meta")


class StoredSketch:
    """A sketch written by :func:`store_sketch`; ``codes`` is read as the bucketed table that it is."""

    def __init__(self, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/meta").first()
        self.owner_col, self.k, self.c = meta["owner_col"], meta["k"], meta["c"]
        name = f"sketch_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} (`{self.owner_col}` {meta['owner_type']}, code BIGINT, split INT) USING parquet "
                  f"CLUSTERED BY (code, split) SORTED BY (code, split) INTO {meta['buckets']} BUCKETS LOCATION '{path}/codes'")
        self.codes = spark.table(name)
        self.splits = spark.read.schema("code long, splits int").parquet(f"{path}/splits")
        self.owners = spark.read.parquet(f"{path}/owners")


def sketch(seqs: DataFrame, owner_col: str, k: int = 16, c: int = 1000, seq_col: str = "sequence") -> DataFrame:
    """Distinct sampled canonical k-mer codes per owner: (owner, code).

    Canonical code = min(2-bit code, reverse-complement code); kept when the
    32-bit murmur3-finalizer hash of the code is below 2^32/c (FracMinHash).
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..functions.codes import sketch_batch
    if not 1 <= k <= 31:
        raise ValueError("k must be in 1..31")

    def run(batches):
        for b in batches:
            owners = b.column(0).dictionary_encode(null_encoding="encode")
            row, code = sketch_batch(b.column(1).to_pylist(), k, c)
            owner = owners.indices.to_numpy()[row]
            order = np.lexsort((code, owner))
            owner, code = owner[order], code[order]
            first = np.ones(len(code), dtype=bool)
            first[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
            yield pa.RecordBatch.from_arrays([owners.dictionary.take(pa.array(owner[first])), pa.array(code[first])],
                                             [owner_col, "code"])

    schema = T.StructType([seqs.schema[owner_col], T.StructField("code", T.LongType(), False)])
    return map_in_arrow(seqs.select(owner_col, seq_col), run, schema).distinct()


def ani_estimate(query_seqs: DataFrame, ref_seqs: DataFrame | None, k: int = 16, c: int = 1000,
                 min_ani: float | None = 80.0, query_col: str = "query_id", ref_col: str = "dataset_id",
                 ref_sketch: DataFrame | StoredSketch | None = None, query_sketch: DataFrame | None = None) -> DataFrame:
    """(query, ref, shared, query_kmers, ref_kmers, containment, ani).

    Sketches are made and stored when this is called: sequences are read once, and the plan reads the sketches.

    ``ref_sketch``: a sketch built once (same k and c), then only the queries are sketched.  A
    :class:`StoredSketch` is joined where it lies, without an exchange of its codes; a (ref_col, code) table is joined as any.
    ``query_sketch``: the stored :func:`sketch` of ``query_seqs``, if the caller has it.
    """
    if query_sketch is None:
        query_sketch = stored(sketch(query_seqs, query_col, k, c), "query-sketch")
    qs = query_sketch.withColumnRenamed(query_col, "_q")
    qn = qs.groupBy("_q").agg(F.count(F.lit(1)).alias("query_kmers"))
    if isinstance(ref_sketch, StoredSketch):
        if (ref_sketch.k, ref_sketch.c) != (k, c):
            raise ValueError(f"the stored sketch has k={ref_sketch.k}, c={ref_sketch.c}")
        rs = ref_sketch.codes.withColumnRenamed(ref_sketch.owner_col, "_r")
        rn = ref_sketch.owners.select(F.col(ref_sketch.owner_col).alias("_r"), F.col("n").alias("ref_kmers"))
        asked = qs.join(ref_sketch.splits, "code", "left").select(
            "_q", "code", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)).alias("split"))
        pairs = rs.join(asked, ["code", "split"])
    else:
        rs = (ref_sketch if ref_sketch is not None else stored(sketch(ref_seqs, ref_col, k, c), "ref-sketch")) \
            .select(F.col(ref_col).alias("_r"), "code")
        rn = rs.groupBy("_r").agg(F.count(F.lit(1)).alias("ref_kmers"))
        pairs = rs.join(qs, "code")
    shared = pairs.groupBy("_q", "_r").agg(F.count(F.lit(1)).alias("shared"))
    out = (shared.join(qn, "_q").join(rn, "_r")
           .withColumn("containment", F.col("shared") / F.col("query_kmers"))
           .withColumn("ani", F.lit(100.0) * F.pow(F.col("containment"), F.lit(1.0 / k))))
    if min_ani is not None:
        out = out.filter(F.col("ani") >= F.lit(min_ani))
    return out.select(F.col("_q").alias(query_col), F.col("_r").alias(ref_col), "shared", "query_kmers",
                      "ref_kmers", "containment", "ani")


def protein_codes(seqs: DataFrame, id_cols: list[str], seq_col: str = "sequence", k: int = 5,
                  alphabet: str = AMINO_ACIDS) -> DataFrame:
    """(*id_cols, codes): the distinct k-mer codes of every row, ascending."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..functions.codes import distinct_codes
    if len(alphabet) ** k >= 2 ** 63:
        raise ValueError("k too large for 64-bit codes")

    def run(batches):
        for b in batches:
            codes = [distinct_codes(s or "", k, alphabet).astype("int64") for s in b.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(id_cols)], pa.array(codes, pa.list_(pa.int64()))], [*id_cols, "codes"])

    rows = seqs.select(*id_cols, seq_col)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("codes", T.ArrayType(T.LongType()))])
    return map_in_arrow(rows, run, schema)


def protein_kmers(seqs: DataFrame, id_col: str, k: int = 5, alphabet: str = AMINO_ACIDS,
                  seq_col: str = "sequence") -> DataFrame:
    """Distinct k-mer codes (base len(alphabet)) per protein: (id, code)."""
    from ..functions.codes import distinct_codes
    if len(alphabet) ** k >= 2 ** 63:
        raise ValueError("k too large for 64-bit codes")
    return _codes_per_row(seqs, id_col, seq_col, lambda s: distinct_codes(s, k, alphabet))


def protein_seed_search(queries: DataFrame, targets: DataFrame, k: int = 5, max_target_seqs: int = 100,
                        query_col: str = "query_id", target_col: str = "gid", seq_col: str = "sequence",
                        alphabet: str = AMINO_ACIDS, min_shared: int = 1, query_rows: int = 4096) -> DataFrame:
    """J11 (+W2): per query protein, the targets sharing the most distinct k-mers.

    Output: query, target, shared, query_kmers, containment (shared /
    query_kmers), hit_rank <= max_target_seqs (ties -> target id).  A query id
    with several rows is one set of k-mers; a target id with several rows
    counts with its best row.

    Blocks of about ``query_rows`` queries meet packs of targets (:mod:`.packs`): the targets with the most codes are
    counted first, in full, when this is called; of the others only those that can reach a query's last kept count.
    """
    from .packs import Search, write_packs

    if len(alphabet) ** k >= 2 ** 63:
        raise ValueError("k too large for 64-bit codes")
    ids = lambda df, c, name: df.filter(F.col(c).isNotNull()).select(
        F.col(c).cast("string").alias(name), F.col(seq_col).alias("_s"))
    packs = write_packs(ids(targets, target_col, "_t"), scratch_path(targets.sparkSession, "packs"), k, alphabet)
    asked = protein_codes(ids(queries, query_col, "_q"), ["_q"], "_s", k, alphabet).withColumnRenamed("codes", "_s")
    return ranked_shared(Search(asked, packs, max_target_seqs, min_shared, query_rows).batches(), max_target_seqs, query_col)


def best_shared(batches: DataFrame, k: int) -> DataFrame:
    """(_q, _t, shared, query_kmers, hit_rank) of the ``k`` best targets per query; a target counts with its best row."""
    from .hits import top_hits_per_query

    best = batches.groupBy("_q", "_t").agg(F.max("shared").alias("shared"), F.first("query_kmers").alias("query_kmers"))
    return top_hits_per_query(best, k, "_q", "shared", "_t")


def ranked_shared(batches: DataFrame, k: int, query_col: str) -> DataFrame:
    """The ``k`` best targets per query out of (_q, _t, shared, query_kmers) rows."""
    ranked = best_shared(batches, k).withColumn("containment", F.col("shared") / F.col("query_kmers"))
    return ranked.select(F.col("_q").alias(query_col), F.col("_t").alias("target_id"), "shared", "query_kmers",
                         "containment", "hit_rank")
