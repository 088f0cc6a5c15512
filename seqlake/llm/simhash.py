"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where more than half of a text's word-shingle hashes have it.  Two
fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` bit ranges, so every link
lies inside a bucket of fingerprints that share two ranges; all such buckets are compared.  Inside a
bucket, bit planes are stored vertically (one machine word holds one bit of 64 fingerprints), the
distances of a query to all of them are counted with carry-save adders, and queries whose every
distance exceeds the radius are abandoned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written
from .components import components

SEED = 42
#: Fingerprints of one bucket that one task compares at once; larger buckets are dealt as pairs of blocks.
BLOCK = 4096
#: Rows of small buckets that share one bit-sliced comparison.
_GATHER = 768
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    counts, n = np.zeros(64, dtype=np.int64), len(hashes)
    for i in range(0, n, 1 << 15):
        part = np.array(hashes[i:i + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int, text_col: str, name: str) -> DataFrame:
    """``docs`` and its texts' fingerprints as column ``name`` (a long)."""
    at = docs.columns.index(text_col)

    def add(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                prints = [fingerprint(t, shingle) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.int64())],
                                                 [*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, add, f"{fields}, `{name}` long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 consecutive fingerprints in each word of row b."""
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((lanes, 64), dtype=np.uint8)
    bits[:len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_rows(prints: np.ndarray, radius: int, queries: int = 256):
    """(query, later positions within ``radius`` bits of it) for every position that has any."""
    planes, n = bit_planes(prints), len(prints)
    words = planes.shape[1]
    counters = max(1, radius.bit_length())
    position = np.arange(words * 64)
    for first in range(0, n, queries):
        rows = np.arange(first, min(n, first + queries))
        low = first // 64  # lanes before the first query are never later positions
        slab = planes[:, low:]
        # a set bit in ``far`` is a pair that is settled: too distant, or not a later position
        settled = (position[None, low * 64:] <= rows[:, None]) | (position[None, low * 64:] >= n)
        far = np.packbits(settled, axis=1, bitorder="little").view(np.uint64)
        flips = np.where(np.unpackbits(prints[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"),
                         _FULL, np.uint64(0))
        count = [np.zeros_like(far) for _ in range(counters)]
        for b in range(0, 64, 2):
            x, y = slab[b][None, :] ^ flips[:, b:b + 1], slab[b + 1][None, :] ^ flips[:, b + 1:b + 2]
            both = x ^ y
            carry = (x & y) | (both & count[0])  # carry-save: two planes and the ones become ones and twos
            count[0] ^= both
            for c in count[1:]:
                c ^= carry
                carry &= ~c
            far |= carry
            if b % 8 == 6:
                over = _above(count, radius)
                alive = ((far | over) != _FULL).any(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.sum() * 2 < len(alive):  # abandon queries that are far from the whole block
                    rows, far, flips = rows[alive], far[alive], flips[alive]
                    count = [c[alive] for c in count]
        if len(rows):
            near = np.unpackbits((~(far | _above(count, radius))).view(np.uint8), axis=1, bitorder="little")
            for row, hits in zip(rows.tolist(), near):
                if hits.any():
                    yield row, np.flatnonzero(hits) + low * 64


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``."""
    above, equal = np.zeros_like(count[0]), np.full_like(count[0], _FULL)
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def spanning_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that connect exactly what links within ``radius`` bits connect: at most n - 1."""
    group = np.arange(len(prints))
    for row, hits in near_rows(prints, radius):
        found = np.unique(np.append(group[hits], group[row]))
        for other in found[1:]:
            group[group == other] = found[0]
    member = np.flatnonzero(group != np.arange(len(prints)))
    return prints[group[member]], prints[member]


def bucket_masks(radius: int) -> list[int]:
    """Bits of every choice of two out of ``radius + 2`` ranges, as signed longs."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    ranges = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [(m - (1 << 64) if m >> 63 else m) for m in (a | b for a, b in combinations(ranges, 2))]


def links(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(u, v): pairs of the distinct longs in ``fp`` whose transitive closure is that of all links.

    Buckets above ``block`` fingerprints are cut into blocks and every pair of blocks is its own group, so no
    task holds a whole hot bucket; each group gives at most as many pairs as it has fingerprints.
    """
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(bucket_masks(radius))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    hot = (keyed.groupBy(F.col("t").alias("ht"), F.col("key").alias("hkey")).agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > block))
    sized = keyed.join(hot, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hkey")), "left")
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    dealt = (sized.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    order = ["t", "key", "i", "j"]

    def compare(batches):
        held, held_keys = np.zeros(0, dtype=np.uint64), np.zeros((0, 4), dtype=np.int64)
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)]
            held = np.concatenate([held, cols[4].view(np.uint64)])
            held_keys = np.concatenate([held_keys, np.stack(cols[:4], axis=1)])
            changes = np.flatnonzero((held_keys[1:] != held_keys[:-1]).any(axis=1)) + 1
            if len(changes):  # the last group may go on in the next batch
                yield from _compared(held[:changes[-1]], np.append(0, changes), radius)
                held, held_keys = held[changes[-1]:], held_keys[changes[-1]:]
        yield from _compared(held, np.array([0, len(held)]), radius)

    grouped = dealt.repartition(*order).sortWithinPartitions(*order)
    return map_arrow(grouped.select(*order, "fp"), compare, "u long, v long")


def _compared(prints: np.ndarray, bounds: np.ndarray, radius: int):
    """Links of consecutive groups; small groups are gathered, and links between them are links too."""
    sizes = np.diff(bounds)
    keep = np.repeat(sizes > 1, sizes)
    prints, sizes = prints[keep], sizes[sizes > 1]
    at = 0
    while at < len(sizes):
        last, n = at + 1, int(sizes[at])
        while last < len(sizes) and n + sizes[last] <= _GATHER:
            n += int(sizes[last])
            last += 1
        u, v = spanning_links(np.unique(prints[:n]), radius)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
        prints, at = prints[n:], last


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp (its fingerprint, a long), root (least fingerprint of its component) and
    component_id (smallest id of its component).

    Null, empty and blank texts share fingerprint 0 and are linked like any other.  Repeated rows are each
    returned; null ids never give a component's id unless all are null.  Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(with_fingerprint(rows, shingle, "text", "fp").select("doc_id", "fp"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct, radius, block))
    placed = (distinct.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy(F.col("root").alias("of_root")).agg(F.min("first_id").alias("component_id"))
    of_print = placed.join(least, F.col("root") == F.col("of_root")).select(
        F.col("fp").alias("of_fp"), "root", "component_id")
    return prints.join(of_print, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "root", "component_id")


def survivors(found: DataFrame) -> DataFrame:
    """(keep_id, keep_fp) of one document per component: the smallest id, then the smallest fingerprint."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("first")
    return found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("keep_id"), F.col("first.fp").alias("keep_fp"))


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
