"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Texts are encoded and cut at multiples of the sequence length; pieces are dealt to randomised groups
of documents, and each group is packed by itself: pieces in decreasing length, each put into the
first sequence with room, found by descending a tournament tree whose nodes hold the largest free
capacity below them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import encoder, text_slices

#: Documents and bytes of text per group on average (a token but the end id has a byte at least), and the tokens
#: after which a single document goes on in another group.
DOCS_PER_GROUP = 4096
BYTES_PER_GROUP = 1 << 24
TOKENS_PER_SEGMENT = 1 << 19


class CapacityTree:
    """Free capacities of bins 0..n-1, each ``capacity`` at first; a node holds its children's maximum."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; return (bin, room it had before)."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        room = best[at]
        best[at] = room - size
        spot = at - self.leaves
        at //= 2
        while at:
            winner = best[2 * at] if best[2 * at] > best[2 * at + 1] else best[2 * at + 1]
            if best[at] == winner:
                break
            best[at] = winner
            at //= 2
        return spot, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece (lengths 1..capacity); equal lengths keep their order."""
    tree = CapacityTree(max(1, len(lengths)), capacity)
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        spot, room = tree.take(int(lengths[i]))
        bins[i], offsets[i] = spot, capacity - room
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, spaced: bool, capacity: int = 2048,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, doc_crc32, copy, ids): every text's ids and ``end_id``, cut at
    multiples of ``capacity``; ``ids`` are little-endian unsigned 32-bit integers.  ``copy`` numbers a task's rows
    of the same id and contents, with the task above: equal rows may swap numbers, so a task that is run
    again in another order still gives the same rows."""
    def cut(batches):
        with encoder(tokenizer_path, spaced) as enc:
            yield from cut_with(enc, batches)

    def cut_with(enc, batches):
        task, seen = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, Counter()
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, bounds = enc.encode_batch(part.column(1), end_id)
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    crc = zlib.crc32(ids[a:b].data)
                    key = hash((doc, b - a, crc))
                    copy = task + seen[key]
                    seen[key] += 1
                    for s in range(0, b - a, capacity):
                        piece = ids[a + s:min(b, a + s + capacity)]
                        for col, value in zip(out, (doc, s, len(piece), b - a, crc, copy, piece.tobytes())):
                            col.append(value)
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                                 ["doc_id", "start", "length", "doc_tokens", "doc_crc32", "copy", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, cut, "doc_id long, start long, length long, doc_tokens long, doc_crc32 long, copy long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, spaced: bool, capacity: int = 2048,
                   docs_per_group: int = DOCS_PER_GROUP, seed: int = 1,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset,
    sequence_tokens and padded_length (``capacity``, or ``sequence_tokens`` at a power of two).

    The number of groups follows the number of documents and the bytes of their texts; a group is a seeded
    hash of the document (id and contents), its number among a task's equal rows and, beyond
    ``TOKENS_PER_SEGMENT`` tokens, the segment, so a task holds about ``docs_per_group`` documents and
    ``BYTES_PER_GROUP`` tokens at most, whatever the input's size, however long the texts are and however
    often a row is repeated.  Another split of the input into tasks gives other groups.  Null texts are empty
    (the end id alone), null ids are packed like any other, equal lengths and repeated rows are placed in
    (doc_id, start) order, other columns of ``docs`` are ignored, an empty table gives no rows.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()
    groups = max(1, -(-size["n"] // docs_per_group), -(-(size["bytes"] or 0) // BYTES_PER_GROUP))
    pieces = cut_pieces(docs, tokenizer_path, end_id, spaced, capacity, id_col, text_col)
    segment = F.floor(F.col("start") / F.lit(TOKENS_PER_SEGMENT))
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64(
        "doc_id", "doc_crc32", "copy", segment, F.lit(seed)), F.lit(groups)).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        padded = np.where((used & (used - 1)) == 0, used, capacity)
        group = table["grp"][0].as_py()
        return pa.table({c: table[c] for c in ("doc_id", "start", "length", "doc_tokens", "ids")} | {
            "sequence_id": pa.array((group << 32) + bins), "offset": pa.array(offsets),
            "sequence_tokens": pa.array(used), "padded_length": pa.array(padded.astype(np.int64))})

    return grouped.drop("doc_crc32", "copy").groupBy("grp").applyInArrow(
        pack, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long,"
              " sequence_tokens long, padded_length long")
