"""Block-gzip FASTA and digests, read by ranges of any size."""

import gzip
import hashlib
import random

import pytest

from seqlake.sources import files, ranges


def records(rng, n):
    wrap = lambda s: "\n".join(s[i:i + 60] for i in range(0, len(s), 60))
    return "".join(f">r{i} é words\n{wrap(''.join(rng.choices('ACGTN', k=rng.choice([0, 3, 500, 9000]))))}\n" for i in range(n))


def rows(df):
    return sorted((r.record_id, r.description, r.sequence) for r in df.collect())


@pytest.mark.parametrize("split", [1000, 20_000, 64 << 20])
def test_block_gzip_equals_the_plain_file(spark, tmp_path, split):
    rng = random.Random(5)
    text = records(rng, 400)
    raw = text.encode()
    at, blocks = 0, []
    while at < len(raw):  # blocks of any size, cut anywhere: also between a line feed and the > after it
        n = rng.choice([1, 700, 5000, ranges.BLOCK_TEXT])
        blocks.append(ranges.block(raw[at:at + n]))
        at += n
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.fa.gz").write_bytes(b"".join(blocks) + ranges.EMPTY_BLOCK)
    assert gzip.decompress((tmp_path / "z" / "a.fa.gz").read_bytes()) == raw  # any gzip reader reads it
    cuts = [i + 1 for i in range(len(raw) - 1) if raw[i:i + 2] == b"\n>"][::3]
    exact = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
    (tmp_path / "z" / "b.fa.gz").write_bytes(b"".join(ranges.block(x[i:i + 60_000]) for x in exact for i in range(0, len(x), 60_000)))
    (tmp_path / "z" / "empty.fa.gz").write_bytes(b"")
    (tmp_path / "plain.fa").write_text(text)
    found = ranges.read_fasta_blocks(spark, str(tmp_path / "z"), split)
    assert rows(found) == sorted(2 * rows(files.read_fasta(spark, str(tmp_path / "plain.fa"))))
    if split == 1000:
        n = ranges.listed_ranges(spark, str(tmp_path / "z"), split)
        assert n.count() > 100


def test_written_blocks_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    lines = [(f">q{i}\n{''.join(rng.choices('ACGT', k=3000))}\n",) for i in range(500)]
    df = spark.createDataFrame(lines, "value string").coalesce(1)
    path = str(tmp_path / "blocks")
    ranges.write_fasta_blocks(df, path)
    one = ranges.read_fasta_blocks(spark, path, 50_000)
    assert rows(one) == sorted((v.split()[0][1:], v.split()[0][1:], v.split()[1]) for v, in lines)
    starts = {r.start for r in ranges.listed_ranges(spark, path, 50_000).collect()}
    assert len(starts) > 5


def test_a_file_that_is_no_block_gzip_raises(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(gzip.compress(b">a\nACGT\n" * 1000))
    with pytest.raises(Exception, match="no block-gzip block"):
        ranges.read_fasta_blocks(spark, str(tmp_path / "x.gz")).collect()


@pytest.mark.parametrize("chunk", [100, 4096, 1 << 20])
def test_digests_in_chunks(spark, tmp_path, chunk):
    rng = random.Random(7)
    contents = {"a": rng.randbytes(10_000), "b": b"x", "c": rng.randbytes(4096), "d": rng.randbytes(3_000_000)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for r in ranges.file_digests(spark, str(tmp_path), chunk).collect():
        data = contents[r.path.rsplit("/", 1)[1]]
        leaves = [hashlib.sha256(data[i:i + chunk]).digest() for i in range(0, len(data), chunk)] or [hashlib.sha256(b"").digest()]
        assert (r.sha256, r.size, r.tree) == (hashlib.sha256(data).hexdigest(), len(data), hashlib.sha256(b"".join(leaves)).hexdigest())
    assert ranges.file_digests(spark, str(tmp_path), chunk).count() == 4  # Spark does not list empty files
