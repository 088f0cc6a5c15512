"""Token ids, packing and token files against the tokenizers library called on whole texts."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from .odd_texts import ODD_TEXTS
from tokenizers import Tokenizer

from seqlake.llm import orcout, packing, queries, tokens
from seqlake.llm.common import scratch_folder
from seqlake.llm.tokens import Encoder, is_spaced

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def whole(path, texts, end):
    tok = Tokenizer.from_file(path)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4") for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_ids_equal_whole_text_ids(spark, sf, path):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["Foo, bar.Baz\nQux! it's 'S x<|endoftext|>. fin.\nÇa?! ſtraße, ŉ ǆ. İx, ĳ"]
    enc = Encoder(path, is_spaced(path))
    flat, bounds = enc.encode_batch(pa.array(texts), 7)
    for i, (text, ids) in enumerate(zip(texts, whole(path, texts, 7))):
        assert np.frombuffer(enc.encode(text or ""), dtype="<u4").tolist() == ids[:-1].tolist(), text[:60]
        assert flat[bounds[i]:bounds[i + 1]].tolist() == ids.tolist(), text[:60]
    sliced, bounds = enc.encode_batch(pa.array(["x", *texts[:9], None, ""]).slice(1), 7)
    assert [len(x) for x in whole(path, [*texts[:9], None, ""], 7)] == np.diff(bounds).tolist()
    assert enc.encode_batch(pa.array([], pa.string()), 7)[1].tolist() == [0]


def test_cache_generations(monkeypatch):
    from seqlake.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 1000)
    enc = Encoder(WORD, False)
    for text in ["a b c d", "c d e f g h i j k l", "a, b. c " * 5, "q " + "z" * 500, "a B! c?! d"]:
        assert enc.encode_batch(pa.array([text]), 9)[0].tolist() == whole(WORD, [text], 9)[0].tolist()
        assert len(enc.known) <= 5 and len(enc.known.old) <= 5 and b"z" * 500 not in enc.known


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_texts_that_collide_in_polynomial_hashes(path, n):
    bits = [bin(i).count("1") & 1 for i in range(n)]  # Thue-Morse and its complement
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    flat, bounds = Encoder(path, is_spaced(path)).encode_batch(pa.array(texts), 7)
    for i, ids in enumerate(whole(path, texts, 7)):
        assert flat[bounds[i]:bounds[i + 1]].tolist() == ids.tolist()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_random_strings_of_awkward_characters(path):
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "İ", "ß", "'", "'s", "'T", ".", ",", "!", "<|", "|>", "<|endoftext|>", "7", "12", " ", "  ", "\n", "\n\n",
                " \n", "\t", "\u00a0", "×", "̈", "-", "_", "(", "\"", "don't", "x"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 14))) for _ in range(6000)]
    flat, bounds = Encoder(path, is_spaced(path)).encode_batch(pa.array(texts), 5)
    for i, (text, ids) in enumerate(zip(texts, whole(path, texts, 5))):
        assert flat[bounds[i]:bounds[i + 1]].tolist() == ids.tolist(), repr(text)


def test_text_slices(monkeypatch):
    from seqlake.llm import tokens

    monkeypatch.setattr(tokens, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aaaa", "bbbb", None, "c" * 50, "", "dd"])], ["i", "t"])
    assert [p.column(0).to_pylist() for p in tokens.text_slices(batch, 1)] == [[0, 1, 2], [3], [4, 5]]


def check_pieces(rows, docs, capacity, end):
    ids = dict(zip([d for d, _ in docs], whole(BYTE, [t for _, t in docs], end)))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert zlib.crc32(ids[doc][at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc])
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and all(r.sequence_tokens == at for r in seq)
        assert all(r.padded_length == (at if at & (at - 1) == 0 else capacity) for r in seq)
    return by_seq


def test_packing_query(spark, sf):
    rows = queries.op3_packing(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seqs = check_pieces(rows, docs, 2048, 1)
    total = sum(r.length for r in rows)
    assert sum(s[0].padded_length for s in seqs.values()) <= total + 2048 * 2


def test_packing_odd_rows_and_groups(spark, odd_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = packing.pack_documents(docs, BYTE, 1, True, capacity=64, docs_per_group=3)
    rows = out.withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 64, 1)
    assert len({r.sequence_id >> 32 for r in rows}) > 2
    again = packing.pack_documents(odd_docs, BYTE, 1, True).collect()
    assert sum(r.length for r in again) == sum(len(x) for x in whole(BYTE, [r.text for r in odd_docs.collect()], 1))
    assert len({(r.sequence_id, r.offset) for r in again}) == len(again)
    assert packing.pack_documents(odd_docs.limit(0), BYTE, 1, True).collect() == []


def test_groups_of_long_texts_and_repeated_rows_are_bounded(spark):
    from pyspark.sql import functions as F

    books = spark.range(20, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("! ab"), 1 << 19).alias("text"))
    groups = {r.g: r.n for r in packing.pack_documents(books, BYTE, 1, True).groupBy(
        F.shiftright("sequence_id", 32).alias("g")).agg(F.sum("length").alias("n")).collect()}
    assert len(groups) > 1 and max(groups.values()) < 0.8 * sum(groups.values())
    for split in (1, 30):  # copies in one task, and about two in each of many
        same = spark.range(60, numPartitions=split).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
        rows = packing.pack_documents(same, BYTE, 1, True, docs_per_group=6).collect()
        held = defaultdict(int)
        for r in rows:
            held[r.sequence_id >> 32] += 1
        assert len(rows) == 60 and len(held) > 5 and max(held.values()) < 30


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        spot = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if spot == len(free):
            free.append(100)
        want[i] = (spot, 100 - free[spot])
        free[spot] -= lengths[i]
    assert [want[i] for i in range(500)] == list(zip(bins.tolist(), offsets.tolist()))
    assert bins.max() + 1 <= math.ceil(lengths.sum() / 100 * 11 / 9) + 1


def test_orc_query(spark, sf):
    rows = sorted(queries.op10_token_orc(spark, sf).collect())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at = 0
    for r, (doc, _), ids in zip(rows, docs, whole(WORD, [t for _, t in docs], 2), strict=True):
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_orc_odd_rows_and_pruning(spark, odd_docs):
    path = scratch_folder(spark, "t-orc")
    orcout.write_token_orc(odd_docs.repartition(3), path, WORD, 2, False)
    tokens = orcout.read_token_orc(spark, path)
    rows = orcout.token_digests(tokens).collect()
    docs = sorted(((r.doc_id, r.text) for r in odd_docs.collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    ids = whole(WORD, [t for _, t in docs], 2)
    want, at = [], 0
    for (doc, _), x in zip(docs, ids):
        want.append((doc, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    found = tokens.where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in found._jdf.queryExecution().toString()
    assert [r.ids for r in found.collect()] == [ids[[d for d, _ in docs].index(7)].tolist()]
    empty = scratch_folder(spark, "t-orc")
    orcout.write_token_orc(odd_docs.limit(0), empty, WORD, 2, False)
    assert orcout.token_digests(orcout.read_token_orc(spark, empty)).collect() == []


def test_pieces_differ_by_letters_only_where_blanks_and_case_do_not_count(monkeypatch):
    texts = ["Word word  word\nWORD \n word", " \n ", "", None, "  WORD", "It'S  A1b, É Éa ÉA", "word 中 Word <|endoftext|> ", "İ Word"]
    seen, find = [], tokens.distinct_pieces

    def watched(*cut):
        seen.append(find(*cut))
        return seen[-1]

    monkeypatch.setattr(tokens, "distinct_pieces", watched)
    with tokens.encoder(WORD, False) as enc:
        for batch in ([t] for t in texts):
            ids, bounds = enc.encode_batch(pa.array(batch, pa.string()), 2)
            assert [*enc.tok.encode(batch[0] or "", add_special_tokens=False).ids, 2] == ids.tolist()
        assert seen[0][1].to_pylist() == [b"word"] and len(seen[0][0]) == 5
        ids, bounds = enc.encode_batch(pa.array(texts, pa.string()).slice(1), 2)
        want = whole(WORD, texts[1:], 2)
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [w.tolist() for w in want]
    assert tokens.byte_strings(pa.array([b"x", b"", b"\xff\x00y"], pa.large_binary()).slice(1)) == [b"", b"\xff\x00y"]
    assert tokens.byte_strings(pa.array([], pa.large_binary())) == []
