"""Token ids in ORC files.

ORC stores an integer list as run-length encoded streams in stripes, with a row index every
``orc.row.index.stride`` rows and a Bloom filter per row group.  Rows are range-partitioned and
sorted on the id, so files and stripes hold disjoint id ranges: readers work stripe by stripe in
parallel, and a lookup by id skips files, stripes and row groups by statistics and Bloom filters.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, written
from .tokens import encoder, text_slices

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, spaced: bool,
                    id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write (doc_id, row, ids) below ``path``.

    Files hold ascending, disjoint id ranges; ``row`` is a row's place in its file.  A null text is
    empty (the end id alone); a null id sorts first; repeated ids stay together, ordered by text;
    repeated rows are all written.  Other columns of ``docs`` are ignored, whatever their names.
    An empty table writes files without rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # split points are sampled from a scan; texts are encoded after the exchange, once
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        with encoder(tokenizer_path, spaced) as enc:
            yield from encode_with(enc, batches)

    def encode_with(enc, batches):
        at = 0
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, bounds = enc.encode_batch(part.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(at, at + part.num_rows, dtype=np.int64)), lists],
                    ["doc_id", "row", "ids"])
                at += part.num_rows

    (map_arrow(dealt, encode, "doc_id long, row long, ids array<int>").write
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", str(BLOOM_FPP)).orc(path))


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids, file) of files written by :func:`write_token_orc`; filters on doc_id are
    pushed to the stripes' statistics and Bloom filters."""
    return (spark.read.schema("doc_id long, row long, ids array<int>").orc(path)
            .select("doc_id", "row", "ids", F.col("_metadata.file_path").alias("file")))


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per document of a read table: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all earlier documents: each file is summed once, files are put in id
    order (one row per file), and rows are summed within their file only.
    """
    def digest(batches):
        for b in batches:
            lists = b.column(3)
            offsets = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            crc = [zlib.crc32(flat[s:e].data) for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets).astype(np.int64)),
                 pa.array(crc, pa.int64())], ["doc_id", "row", "file", "n_tokens", "ids_crc32"])

    small = written(map_arrow(tokens.select("doc_id", "row", "file", "ids"), digest,
                              "doc_id long, row long, file string, n_tokens long, ids_crc32 long"), "token-digests")
    files = small.groupBy(F.col("file").alias("of_file")).agg(
        F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first_id"))
    offsets = files.select("of_file", F.coalesce(F.sum("total").over(
        W.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    ranked = small.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return ranked.join(offsets, F.col("file") == F.col("of_file")).select(
        "doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
