"""Archives: round trip, revisits, salvage after every kind of damage."""

import gzip
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from seqlake.llm import queries, warc
from seqlake.llm.common import scratch_folder


def member(i, payload=b"x", ref=None):
    return warc.record_bytes(i, f"http://h/{i}", payload, hashlib.sha1(payload).hexdigest(), len(payload), ref)


def ids(data):
    return [info["warc-record-id"] for kind, _, _, info, _ in warc.salvage(data) if kind == "record"]


def gaps(data):
    return [(a, n) for kind, a, n, _, _ in warc.salvage(data) if kind == "gap"]


def covered(data):
    at = 0
    for _, start, length, _, _ in warc.salvage(data):
        assert start == at
        at = start + length
    assert at == len(data)


def names(*numbers):
    return [f"<urn:page:{i}>" for i in numbers]


def test_salvage_recovers_later_records_and_logs_gaps():
    rng = random.Random(1)
    members = [gzip.compress(member(i, rng.randbytes(3000))) for i in range(6)]
    whole = b"".join(members)
    assert ids(whole) == names(*range(6)) and gaps(whole) == []
    starts = [sum(map(len, members[:i])) for i in range(7)]
    hurt = bytearray(whole)
    hurt[starts[2] + 900] ^= 0x55  # data of member 2
    hurt[starts[4] + 1] = 0  # magic of member 4
    assert ids(bytes(hurt)) == names(0, 1, 3, 5)
    assert gaps(bytes(hurt)) == [(starts[2], len(members[2])), (starts[4], len(members[4]))]
    covered(bytes(hurt))
    cut = whole[:starts[3] + 500]  # truncated file
    assert ids(cut) == names(0, 1, 2) and gaps(cut) == [(starts[3], 500)]
    lost = whole[:starts[1] + 700] + whole[starts[2]:]  # bytes missing in the middle of member 1
    assert ids(lost) == names(0, 2, 3, 4, 5) and gaps(lost) == [(starts[1], 700)]
    covered(lost)
    assert ids(b"junk" + whole) == names(*range(6)) and gaps(b"junk" + whole) == [(0, 4)]


def test_salvage_of_plain_records_and_failed_checks():
    a, b, c = (member(i, b"<p>%d</p>" % i) for i in range(3))
    data = a + b.replace(b"<p>1", b"<p>X") + c  # digest of b differs
    assert ids(data) == names(0, 2) and gaps(data) == [(len(a), len(b))]
    quoted = member(7, b"see\r\n\r\n" + a + b"end")  # a record quoted in a payload stays part of it
    assert ids(quoted + c) == names(7, 2)
    short = a.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert ids(short + b) == names(1)
    assert ids(gzip.compress(a + b) + c) == names(0, 1, 2)
    assert ids(gzip.compress(b"not a record") + c) == names(2)
    assert list(warc.salvage(b"")) == [] and ids(warc.EMPTY_MEMBER * 3) == []


def inner(data):
    return [info[1:] for kind, _, _, info, _ in warc.salvage(data) if kind == "inner gap"]


def test_salvage_inside_one_member():
    rng = random.Random(4)
    records = [member(i, rng.randbytes(40_000)) for i in range(6)]
    ends = [sum(map(len, records[:i])) for i in range(7)]
    bad = [*records[:2], records[2].replace(b"sha1:", b"sha1:0", 2), *records[3:]]  # one bad digest of six
    whole = gzip.compress(b"".join(bad))
    assert ids(whole) == names(0, 1, 3, 4, 5) and gaps(whole) == []
    assert inner(whole) == [(ends[2], ends[2] + len(bad[2]))]
    whole = gzip.compress(b"".join(records))
    after = gzip.compress(member(9))
    cut = whole[:len(whole) * 3 // 4]  # the member ends inside record 4: what inflated before is kept
    assert ids(cut) == names(0, 1, 2, 3) and gaps(cut) == [(0, len(cut))]
    assert ids(whole[:-8] + b"\0" * 8 + after) == names(*range(6), 9)  # the member's own check fails
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 0xFF
    found = ids(bytes(hurt) + after)
    assert found[:2] == names(0, 1) and found[-1:] == names(9) and len(found) == len(set(found)) >= 4
    plain = b"".join(records) + b"junk" + after
    assert ids(gzip.compress(plain[:-len(after)]) + after) == names(*range(6), 9)
    assert inner(gzip.compress(b"junk" + records[0])) == [(0, 4)]


def test_a_damaged_member_gives_no_record_twice_or_unproven():
    stored = gzip.compress(member(1, b"y" * 300) + member(2, b"z" * 300), compresslevel=0)  # records are visible in the bytes
    damaged = stored[:-6] + b"\0" * 6
    assert ids(damaged + gzip.compress(member(3))) == names(1, 2, 3)
    open_record = member(4).replace(b"WARC-Block-Digest", b"X-Block-Digest")
    assert ids(gzip.compress(open_record)) == names(4)
    assert ids(gzip.compress(open_record)[:-5] + b"\0" * 5) == []


def expected(rows):
    best = {}
    for r in rows:
        if len((r.html or "").encode()) >= 1000 and r.page_id is not None:
            best[r.html] = max(best.get(r.html, r.page_id), r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        top = best.get(r.html) if len(data) >= 1000 else None
        ref = top if top is not None and top != r.page_id else None
        out.append((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


def test_query(spark, sf):
    rows = queries.op1_warc_salvage(spark, sf)
    assert sorted(map(tuple, rows.collect()), key=repr) == expected(spark.read.parquet(f"{sf}/pages.parquet").collect())


def test_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_BYTES", 5000)
    monkeypatch.setattr(warc, "RUNS_PER_FILE", 2)
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(1500).hex()) for i in range(60)] + [(99, "u", rng.randbytes(20_000).hex())],
                                  "page_id long, url string, html string").coalesce(1)
    path = scratch_folder(spark, "t-warc")
    warc.write_warc(warc.plan_records(pages), path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(sizes) > 10 and max(sizes) < 2 * 5000 + 30_000
    assert sorted(r.page_id for r in warc.page_captures(warc.read_warc(spark, path)).collect()) == [*range(60), 99]


def test_odd_pages_round_trip_and_damage(spark, tmp_path):
    big = "é<b>" * 400
    rows = [(1, "http://a", big), (5, None, big), (3, "u\r\nrl \x00", big), (5, None, big), (None, "n", big), (7, "s", "tiny"),
            (8, "s", "tiny"), (9, "e", ""), (10, "n", None), (11, "g", "\x1f\x8b WARC/1.1\r\n\r\n" * 200), (12, "q", "y" * 999),
            (13, "q", "y" * 999), (14, "z", "z" * 1000), (15, "z", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch_folder(spark, "t-warc")
    warc.write_warc(warc.plan_records(pages), path)
    archive = warc.read_warc(spark, path)
    assert archive.where("kind = 'gap'").count() == 0
    assert sorted(map(tuple, warc.page_captures(archive).collect()), key=repr) == expected(pages.collect())
    got = {r.record_id: bytes(r.payload).decode() for r in archive.where("record_type = 'response'").collect()}
    assert got["<urn:page:11>"] == rows[9][2] and got["<urn:page:5>"] == big
    for r in spark.read.format("binaryFile").load(path).collect():  # any gzip reader sees plain WARC records
        text, at = gzip.decompress(r.content), 0
        while at < len(text):
            at = warc.parse_record(text, at)[2]
    (tmp_path / "x.warc").write_bytes(member(1) + b"garbage" + zlib.compress(b"q") + member(2))
    kinds = [(r.kind, r.offset) for r in warc.read_warc(spark, f"file://{tmp_path}").orderBy("offset").collect()]
    assert [k for k, _ in kinds] == ["record", "gap", "record"]
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(member(1) + b"oops" + member(2)))
    found = warc.read_warc(spark, f"file://{tmp_path}/y.warc.gz").orderBy("kind", "record_id").collect()
    assert [(r.kind, r.inner_start, r.inner_end) for r in found] == [
        ("inner gap", len(member(1)), len(member(1)) + 4), ("record", None, None), ("record", None, None)]
    empty = scratch_folder(spark, "t-warc")
    warc.write_warc(warc.plan_records(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).collect() == []
