"""Protein candidate search over a stored inverted k-mer index.

The index holds each target's own codes, in packs of a few thousand targets (:mod:`.packs`); the posting lists, a row
per code and pack with the numbers that the code's targets have in the pack, two bytes each, in folders by a hash of the
code and sorted by it; and the length of every list.  A search reads only the folders of its queries' codes and stops
early (MaxScore): a list adds at most one to a target's count, so once a lower bound t on a query's last kept count is
known, a target that is in none but the t - 1 longest lists cannot be kept.  Candidates come from the shorter lists alone,
as a bit per target and not as (query, target) pairs, whose number grows with the square of the table; they are counted
from their own codes where these are stored.  Results equal :func:`.search.protein_seed_search`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_in_arrow
from .packs import PACK, PACK_ROWS, Search, write_packs
from .search import AMINO_ACIDS, protein_codes, ranked_shared

#: Folders that codes are hashed into.
BUCKETS = 64
#: Targets with the most postings, this many at least, that are counted first to bound every query's last kept count.
PROBE_POSTINGS = 2000
#: Postings that one partition of the index should hold.
PARTITION_POSTINGS = 5_000_000


def build_seed_index(targets: DataFrame, root: str, k: int = 5, target_col: str = "gid", seq_col: str = "sequence",
                     alphabet: str = AMINO_ACIDS, buckets: int = BUCKETS) -> None:
    """Store the index of ``targets`` below ``root``.

    A target id with several rows is several targets, which count one by one; null ids are left out.  Postings are
    range-partitioned by (folder, code, pack), so a code that every target has is spread over tasks.
    """
    spark = targets.sparkSession
    packs = write_packs(targets.where(F.col(target_col).isNotNull()).select(F.col(target_col).cast("string"), F.col(seq_col)),
                        f"{root}/targets", k, alphabet)
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x)).alias("n")).first()["n"] or 0
    bucket = F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int").alias("bucket")
    postings = map_in_arrow(packs, _postings, "code long, pack long, targets binary").select("*", bucket)
    order = ["bucket", "code", "pack"]
    (postings.repartitionByRange(max(1, -(-size // PARTITION_POSTINGS)), *order).sortWithinPartitions(*order)
     .write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings"))
    lists = spark.read.schema(POSTINGS).parquet(f"{root}/postings").groupBy("bucket", "code") \
        .agg(F.sum(F.octet_length("targets") / 2).cast("long").alias("length")) \
        if size else spark.createDataFrame([], "bucket int, code long, length long")
    lists.repartitionByRange(max(1, -(-size // PARTITION_POSTINGS)), "bucket", "code").sortWithinPartitions("code") \
         .write.partitionBy("bucket").parquet(f"{root}/lists")
    spark.createDataFrame([(k, alphabet, buckets, size)], "k int, alphabet string, buckets int, postings long") \
         .coalesce(1).write.parquet(f"{root}/meta")


POSTINGS = "code long, pack long, targets binary, bucket int"


def _postings(batches):
    """(code, pack, numbers of the code's targets in the pack) rows of packs."""
    import numpy as np
    import pyarrow as pa

    from .packs import pack_rows

    for b in batches:
        for pack, _, sizes, codes, _ in pack_rows(b, ()):
            if not len(codes):
                continue
            order = np.argsort(codes, kind="stable")
            code, target = codes[order], np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            ends = np.append(first, len(code)).astype(np.int32) * 2
            lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(target.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(code[first].astype(np.int64)), pa.array(np.full(len(first), pack, dtype=np.int64)), lists],
                                             ["code", "pack", "targets"])


def _wanted(batches):
    """(pack, a bit per target) of posting rows, one row per pack that a task has met."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    slots, seen = {}, np.zeros((0, PACK_ROWS), dtype=bool)
    for b in batches:
        packs, slot = np.unique(b.column(0).to_numpy(), return_inverse=True)
        for p in packs.tolist():
            slots.setdefault(p, len(slots))
        if len(slots) > len(seen):
            seen = np.concatenate([seen, np.zeros((max(len(slots) - len(seen), len(seen)), PACK_ROWS), dtype=bool)])
        size = pc.binary_length(b.column(1)).to_numpy() // 2
        row = np.array([slots[p] for p in packs.tolist()])[slot]
        seen.reshape(-1)[np.repeat(row * PACK_ROWS, size) + np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16)] = True
    if slots:
        bits = [np.packbits(x, bitorder="little").tobytes() for x in seen[:len(slots)]]
        yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int64()), pa.array(bits, pa.binary())], ["pack", "wanted"])


def _united(batches):
    """(pack, wanted, n): the bits of all rows of a pack and their number, from rows that lie together by pack."""
    import numpy as np
    import pyarrow as pa

    found = {}
    for b in batches:
        for p, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            bits = np.frombuffer(bits, dtype=np.uint8)
            found[p] = found[p] | bits if p in found else bits
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary()),
                                          pa.array([int(np.bitwise_count(x).sum()) for x in found.values()], pa.int64())], ["pack", "wanted", "n"])


class SeedIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.k, self.alphabet, self.buckets, self.size = spark.read.parquet(f"{root}/meta").first()

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the index; with ``buckets``, those folders alone."""
        schema = {"targets": PACK, "postings": POSTINGS, "lists": "code long, length long, bucket int"}[name]
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def search(self, queries: DataFrame, max_target_seqs: int = 100, query_col: str = "query_id", seq_col: str = "sequence",
               min_shared: int = 1) -> tuple[DataFrame, DataFrame]:
        """(hits, work): hits as :func:`.search.protein_seed_search` gives them, and as (figure, n) rows how many
        postings the queries' lists have, how many were read for candidates and how many candidates they gave to count from their codes."""
        spark, k = self.spark, max_target_seqs
        named = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).cast("string").alias("q"), F.col(seq_col).alias("sequence"))
        asked = protein_codes(named, ["q"], "sequence", self.k, self.alphabet).select(F.col("q").alias("_q"), F.col("codes").alias("_s"))
        search = Search(asked, self.table("targets"), k, min_shared, probe=PROBE_POSTINGS)
        codes = search.asked.rows.select(F.col("_q").alias("q"), F.explode("_s").alias("code")).distinct()
        folder = F.pmod(F.xxhash64("code"), F.lit(self.buckets)).cast("int")
        wanted = sorted(r[0] for r in codes.select(folder).distinct().collect())  # ``buckets`` numbers at most
        # a query's lists, the shortest first, but the ``least - 1`` longest
        by_length = Window.partitionBy("q").orderBy("length", "code")
        least = F.greatest(F.coalesce("least", F.lit(1)), F.lit(min_shared), F.lit(1))
        lists = (codes.join(self.table("lists", wanted).drop("bucket"), "code")
                 .withColumn("place", F.row_number().over(by_length)).withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("q")))
                 .join(search.least.withColumnRenamed("_q", "q"), "q", "left")
                 .groupBy("code", "length").agg(F.count(F.lit(1)).alias("asking"),
                                                F.count_if(F.col("place") <= F.col("lists") - least + 1).alias("reading")))
        path = scratch_path(spark, "seed-lists")
        lists.write.parquet(path)
        lists = spark.read.schema("code long, length long, asking long, reading long").parquet(path)
        found = map_in_arrow(self.table("postings", wanted).join(lists.where("reading > 0"), "code", "left_semi").select("pack", "targets"),
                             _wanted, "pack long, wanted binary")
        path = scratch_path(spark, "seed-candidates")
        map_in_arrow(found.repartition("pack"), _united, "pack long, wanted binary, n long").write.parquet(path)
        candidates = spark.read.schema("pack long, wanted binary, n long").parquet(path)
        ranked = ranked_shared(search.batches(candidates.drop("n")), k, query_col)
        figures = {"postings": lists.select((F.col("length") * F.col("asking")).alias("length")),
                   "read": lists.select((F.col("length") * F.col("reading")).alias("length")),
                   "counted_in_full": candidates.select(F.col("n").alias("length"))}
        work = None
        for name, df in figures.items():
            one = df.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("figure"), "n")
            work = one if work is None else work.unionByName(one)
        return ranked, work
