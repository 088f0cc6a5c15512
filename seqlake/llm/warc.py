"""WARC archives: a writer through Spark's own file sink and a salvaging reader.

Writer: every record is one gzip member.  Members are bytes, so they go through the text sink with
an empty gzip member as line separator: files are committed by Spark's output protocol on any file
system it can write, and their decompressed contents are exactly the WARC records.

Reader: walks an archive member by member (or, in uncompressed stretches, version line by version
line).  When a check fails -- gzip CRC, version line, Content-Length, block digest, record end -- it
searches on for the next member or version line that passes, and reports the bytes between as a gap.  The
contents of a member are searched the same way, also what could be inflated of a damaged or cut one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

# Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

#: Payloads below this many bytes are always stored as responses.
MIN_REVISIT_BYTES = 1000
_FEED = 1 << 14
#: Bytes of a run of members and runs of a file: files of about 128 MB at most, or little more than one record.
RUN_BYTES = 1 << 20
RUNS_PER_FILE = 128


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to): refers_to is null for a response.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest id is
    the response.  A null payload is empty; a null id never wins unless all are null (then all are
    responses); repeated rows of the largest id are all responses.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = (rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long")))
    short, long = (rows.where(F.col("payload_bytes") < min_revisit_bytes), rows.where(F.col("payload_bytes") >= min_revisit_bytes))
    # partial aggregation first: a payload shared by a third of the pages is one row per map task
    best = (long.groupBy(F.col("digest").alias("of_digest"))
            .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    joined = long.join(best, F.col("digest") == F.col("of_digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes",
                         F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to")
                         ).unionByName(short.withColumn("refers_to", F.lit(None).cast("long")))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, payload_bytes: int,
                 refers_to: int | None) -> bytes:
    """One WARC 1.1 record: an HTTP response, or a revisit that carries headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str, level: int = 1) -> None:
    """Write the rows of :func:`plan_records` as gzip-member archives below ``path``.

    Rows of the sink are runs of members of about ``RUN_BYTES`` (or one larger member), and a file takes
    ``RUNS_PER_FILE`` of them at most, so no file outgrows a reading task.
    """

    def members(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500).to_pydict()
                out, held = [[]], 0
                for page, url, payload, digest, size, ref in zip(*part.values()):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(record_bytes(page, url, payload, digest, size, ref)) + z.flush()
                    if held and held + len(member) > RUN_BYTES:
                        out.append([])
                        held = 0
                    out[-1].append(member)
                    held += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(run) for run in out], pa.binary())], ["members"])

    # a revisit's payload stays behind: only its length and digest are written
    rows = records.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload").cast("binary"))
                          .otherwise(F.lit(b"")).alias("payload"), "digest", "payload_bytes", "refers_to")
    (map_arrow(rows, members, "members binary").select(F.col("members").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", RUNS_PER_FILE).text(path))


def parse_record(data: bytes, at: int) -> tuple[dict, int, int] | str:
    """(headers, block start, end) of the valid record at ``at``, or what is wrong with it."""
    line = VERSION_LINE.match(data, at)
    if not line:
        return "no version line"
    head_end = data.find(b"\r\n\r\n", line.end() - 2)
    if head_end < 0:
        return "header without end"
    headers = {}
    for row in data[line.end():head_end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon and row:
            return "bad header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "bad Content-Length"
    start = head_end + 4
    end = start + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return "record end not found"
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm.lower() == "sha1" and hashlib.sha1(data[start:end]).hexdigest() != digest.lower():
        return "block digest differs"
    return headers, start, end + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """(contents, end, fault) of the gzip member at ``at``; with a fault, what was inflated before it."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        if pos >= len(data):
            return b"".join(out), pos, "member cut off"
        step, before = data[pos:pos + _FEED], z.copy()
        try:
            out.append(z.decompress(step))
            pos += len(step)
        except zlib.error:  # what this step gives up to the faulty byte
            for i in range(len(step)):
                try:
                    out.append(before.decompress(step[i:i + 1]))
                except zlib.error:
                    return b"".join(out), pos + i, "gzip check failed"
            return b"".join(out), pos + len(step), "gzip check failed"
    return b"".join(out), pos - len(z.unused_data), None


def walk(contents: bytes, proven: bool = False) -> Iterator[tuple]:
    """('record', start, end, headers, block) and ('gap', start, end, reason, None) of uncompressed records, in order.

    After a failed check the search goes on at the next version line.  ``proven`` takes only records whose block
    digest was checked.
    """
    at, bad_from, reason = 0, None, ""
    while at < len(contents):
        record = parse_record(contents, at)
        if not isinstance(record, str) and proven and not record[0].get("warc-block-digest", "").lower().startswith("sha1:"):
            record = "no block digest"
        if isinstance(record, str):
            if bad_from is None:
                bad_from, reason = at, record
            following = VERSION_LINE.search(contents, at + 1)
            at = following.start() if following else len(contents)
            continue
        if bad_from is not None:
            yield "gap", bad_from, at, reason, None
            bad_from = None
        headers, start, end = record
        yield "record", at, end, headers, contents[start:end - 4]
        at = end
    if bad_from is not None:
        yield "gap", bad_from, len(contents), reason, None


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', offset, length, headers, block), ('gap', offset, length, reason, None) and
    ('inner gap', offset, length, (reason, start, end), None) in order of offset.

    Records and gaps cover every byte but those of empty gzip members.  A member's records and its inner gaps, at
    bytes ``start`` to ``end`` of its contents, have the member's offset and length.  A damaged member is a
    gap; the records that it still gave, proven by their digests, stand before it.
    """
    view, starts = memoryview(data), re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
    at, bad_from, reason = 0, None, ""
    kept: list[tuple] = []  # what damaged members of the open gap gave
    fault_end, given = 0, set()
    while at < len(data):
        found, end, fault = [], at, None
        if at >= fault_end:
            given = set()
        if data.startswith(GZIP_MAGIC, at):
            contents, end, fault = inflate(view, at)
            parts = list(walk(contents, fault is not None))
            found = [p for p in parts if p[0] == "record"]
            if fault:
                kept += [("record", at, end - at, *p[3:]) for p in found if p[4] not in given]
                given |= {p[4] for p in found}
                fault_end = max(fault_end, end)
            elif contents and not found:
                fault = parts[0][3]
            else:
                found = [("inner gap", at, end - at, (p[3], p[1], p[2]), None) if p[0] == "gap" else ("record", at, end - at, *p[3:])
                         for p in parts]
        else:
            record = parse_record(data, at)
            if isinstance(record, str):
                fault = record
            else:
                headers, start, end = record
                found = [("record", at, end - at, headers, data[start:end - 4])]
        if fault:
            if bad_from is None:
                bad_from, reason = at, fault
            following = starts.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad_from is not None:
            yield from kept
            yield "gap", bad_from, at - bad_from, reason, None
            bad_from, kept = None, []
        # inside a damaged member's bytes, a record that it gave already is not given again
        yield from (f for f in found if f[0] != "record" or at >= fault_end or f[4] not in given)
        at = end
    if bad_from is not None:
        yield from kept
        yield "gap", bad_from, at - bad_from, reason, None


READ_SCHEMA = ("file string, kind string, offset long, length long, reason string, record_type string, record_id string,"
               " refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary,"
               " inner_start long, inner_end long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of every archive below ``path``: kind is ``record``, ``gap`` or ``inner gap`` (bytes
    ``inner_start`` to ``inner_end`` of a member's contents).

    A task holds one archive file at a time, so a file must fit into a task; the writer bounds its files by
    bytes.  ``payload`` is the body of an HTTP block (a revisit's is empty) or the whole block of
    other records; ``payload_bytes`` is the body's declared length for HTTP blocks.  Empty files give no rows.
    """

    def scan(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, held, name = [], 0, name.as_py()
                for kind, offset, length, info, block in salvage(data.as_py()):
                    if kind != "record":
                        reason, *inner = (info, None, None) if kind == "gap" else info
                        rows.append((name, kind, offset, length, reason, *[None] * 7, *inner))
                        continue
                    payload, size = block, len(block)
                    if info.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        declared = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
                        size = int(declared[1]) if declared else len(payload)
                    rows.append((name, kind, offset, length, None, info.get("warc-type"), info.get("warc-record-id"),
                                 info.get("warc-refers-to"), info.get("warc-target-uri"),
                                 info.get("warc-payload-digest"), size, payload, None, None))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, scan, READ_SCHEMA)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in READ_SCHEMA.split(",")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def page_captures(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records of an archive.

    A response's length and digest are taken from the payload read back, a revisit's from its headers.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    stored = F.col("record_type") == "response"
    return archive.where(F.col("kind") == "record").select(
        number(F.col("record_id")).alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
        .alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"))
