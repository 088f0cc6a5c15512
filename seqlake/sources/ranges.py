"""Files read by byte ranges in tasks: block-gzip FASTA (S1) and digests of files of any size.

Ranges are rows of a listing, so they are planned and spread by Spark and no file is one task.  Tasks open files
through Arrow's file systems (local, HDFS, S3, GCS), which seek without reading.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import map_in_arrow

#: Compressed bytes that one task reads of a block-gzip file, and bytes of a digest's chunk.
SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 64 << 20
_READ = 1 << 20

# Fixed values of the block-gzip format: member header with the extra field that holds a block's size, and the empty
# last block.  A block holds at most 64 KiB.
BLOCK_HEAD = b"\x1f\x8b\x08\x04"
BLOCK_EXTRA = b"BC\x02\x00"
EMPTY_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_TEXT = 0xFF00


def open_file(path: str):
    """(Arrow input file, size) of a path as Spark lists it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inside = fs.FileSystem.from_uri(path)
    f = system.open_input_file(inside)
    return f, f.size()


def listed_ranges(spark: SparkSession, path: str, each: int) -> DataFrame:
    """(path, start, stop, size): ranges of ``each`` bytes of every file, dealt over tasks; an empty file has one."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))  # contents are not read
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(each).cast("long"))).alias("start")
    rows = files.select("path", "size", start)
    return rows.select("path", "start", F.least(F.col("start") + each, "size").alias("stop"), "size").repartition("path", "start")


# ------------------------------------------------------------------ block gzip

def block(text: bytes, level: int = 6) -> bytes:
    """One block of at most ``BLOCK_TEXT`` bytes of text."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(text) + z.flush()
    size = 18 + len(data) + 8
    return (BLOCK_HEAD + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + BLOCK_EXTRA + struct.pack("<H", size - 1) + data
            + struct.pack("<II", zlib.crc32(text), len(text)))


def write_fasta_blocks(text: DataFrame, path: str, value_col: str = "value") -> None:
    """Write FASTA records (rows of text, each with its line feeds) as block-gzip files below ``path``, one a task."""
    def pack(batches):
        held = b""
        for b in batches:
            held += b"".join((r or "").rstrip("\n").encode() + b"\n" for r in b.column(0).to_pylist())
            cut = len(held) - len(held) % BLOCK_TEXT
            if cut:
                blocks = [block(held[i:i + BLOCK_TEXT]) for i in range(0, cut, BLOCK_TEXT)]
                held = held[cut:]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(held)], pa.binary())], ["block"])

    (map_in_arrow(text.select(value_col), pack, "block binary").select(F.col("block").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", EMPTY_BLOCK.decode("latin-1")).text(path))


def _block_size(data: bytes, at: int) -> int:
    """Size of the block whose header is at ``at``, 0 if there is none."""
    if data[at:at + 4] != BLOCK_HEAD or data[at + 12:at + 16] != BLOCK_EXTRA:
        return 0
    return struct.unpack_from("<H", data, at + 16)[0] + 1


def block_texts(f, size: int, start: int):
    """(offset, text) of the blocks from the first that begins at or after ``start``.

    A block's header in the middle of another's data is told by what follows: a block must inflate and check, and the
    next one begin where it ends.
    """
    f.seek(start)
    head = f.read(min(size - start, (1 << 17) + 64))
    at = start
    if start:
        found = head.find(BLOCK_HEAD)
        while found >= 0:
            n = _block_size(head, found)
            end = found + n
            if n and (start + end == size or _block_size(head, end)):
                try:
                    zlib.decompress(head[found:end], 31)
                    break
                except zlib.error:
                    pass
            found = head.find(BLOCK_HEAD, found + 1)
        if found < 0:
            return
        at = start + found
    while at < size:
        f.seek(at)
        data = f.read(_READ)
        inside = 0
        while inside < len(data):
            n = _block_size(data, inside)
            if not n and len(data) - inside >= 18:
                raise ValueError(f"no block-gzip block at byte {at}")
            if not n or inside + n > len(data):
                break
            yield at, zlib.decompress(data[inside:inside + n], 31)
            inside += n
            at += n
        if not inside:
            raise ValueError(f"block-gzip file cut off at byte {at}")


def read_fasta_blocks(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(record_id, description, sequence, file) of block-gzip FASTA files, each file read by many tasks.

    A record belongs to the range that holds the line feed before its ``>`` (the file's first record to
    the first range); a task reads on past its range to the end of its last record.
    """
    def read(batches):
        for b in batches:
            for name, start, stop, size in zip(*[c.to_pylist() for c in b.columns]):
                if not size:
                    continue
                f, _ = open_file(name)
                out: list[str] = []
                parts: list[str] = []  # of the record that is open
                inside, past, last = start == 0, False, ""
                for at, raw in block_texts(f, size, start):
                    text = raw.decode("latin-1")
                    pieces = (last + text).split("\n>")
                    straddles = last == "\n" and text.startswith(">")  # the line feed is in the block before
                    pieces[0] = pieces[0][len(last):]
                    last = text[-1:] or last
                    if at >= stop:  # past the range: only the record that is open
                        if straddles and not past:
                            out += ["".join(parts)] * inside
                            inside, parts, pieces = True, [], pieces[1:]
                        past = True
                        parts.append(pieces[0])
                        if not inside or len(pieces) > 1:
                            break
                        continue
                    parts.append(pieces[0])
                    for piece in pieces[1:]:
                        out += ["".join(parts)] * inside
                        inside, parts = True, [piece]
                    if not inside:
                        parts = []
                    if len(out) >= 1000:
                        yield _records(out, name)
                        out = []
                f.close()
                yield _records(out + ["".join(parts)] * inside, name)

    return map_in_arrow(listed_ranges(spark, path, split_bytes), read,
                        "record_id string, description string, sequence string, file string")


def _records(texts: list[str], name: str) -> pa.RecordBatch:
    rows = []
    for text in texts:
        title, _, body = text.removeprefix(">").partition("\n")
        title = title.encode("latin-1").decode("utf-8", "replace").strip()
        if title:
            rows.append((title.split()[0], title, "".join(body.split()), name))
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["record_id", "description", "sequence", "file"])


# ------------------------------------------------------------------ digests

def file_digests(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, sha256, tree, size) of files of any size.

    ``sha256`` is of the whole file, streamed by one task in bounded memory.  ``tree`` is the SHA-256 of
    the chunks' SHA-256 digests in order, whose chunks are hashed by many tasks: the digest to check a very large file by.
    """
    def whole(batches):
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                f, _ = open_file(name)
                digest = hashlib.sha256()
                while data := f.read(_READ):
                    digest.update(data)
                f.close()
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path").repartition("path")
    return map_in_arrow(files, whole, "path string, sha256 string").join(tree_digests(spark, path, chunk_bytes), "path")


def tree_digests(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, tree, size): see :func:`file_digests`; no task reads more than chunks."""
    def chunks(batches):
        for b in batches:
            out = []
            for name, start, stop in zip(*[c.to_pylist() for c in b.columns[:3]]):
                f, _ = open_file(name)
                f.seek(start)
                digest, left = hashlib.sha256(), stop - start
                while left:
                    data = f.read(min(_READ, left))
                    if not data:
                        raise ValueError(f"{name} ends before byte {stop}")
                    digest.update(data)
                    left -= len(data)
                f.close()
                out.append(digest.digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(out, pa.binary())], ["path", "start", "size", "leaf"])

    leaves = map_in_arrow(listed_ranges(spark, path, chunk_bytes), chunks, "path string, start long, size long, leaf binary")
    joined = leaves.groupBy("path").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("start", "leaf"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.hex(x["leaf"])), "")
    return joined.select("path", F.sha2(F.unhex(text), 256).alias("tree"), "size")
