"""Transducer lexicon, encoding and decoding against the tokenizers library called on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from .odd_texts import ODD_TEXTS
from tokenizers import Tokenizer

from seqlake.llm import bpe, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def compiled(tmp_path, words, ids=None):
    path = tmp_path / f"{random.random()}.bin"
    path.write_bytes(bpe.compile_words(words, ids or [b""] * len(words)))
    return bpe.Lexicon(str(path))


def places(lexicon, probes):
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in probes])]).astype(np.int64)
    return lexicon.find(np.frombuffer(b"".join(probes), dtype=np.uint8), bounds[:-1], np.diff(bounds)).tolist()


def test_automaton_is_exact_and_minimal(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lexicon")

    @settings(max_examples=60, deadline=None)
    @given(st.sets(st.binary(max_size=6) | st.text("ab", max_size=7).map(str.encode), max_size=40), st.lists(st.text("abc", max_size=7).map(str.encode), max_size=20))
    def check(words, probes):
        words = sorted(words)
        lexicon = compiled(folder, words)
        assert places(lexicon, words + probes) == [*range(len(words)), *[words.index(p) if p in words else -1 for p in probes]]
        # one state for each distinct set of endings that follow a prefix
        prefixes = {w[:i] for w in words for i in range(len(w) + 1)} | {b""}
        assert len(lexicon.final) == len({frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes})

    check()


def test_ids_come_from_the_file_and_suffixes_are_shared(tmp_path):
    words = sorted(a + b for a in (b"walk", b"talk", b"look") for b in (b"", b"ed", b"ing", b"s"))
    ids = [np.array(range(i, 2 * i), dtype="<u4").tobytes() for i in range(len(words))]
    lexicon = compiled(tmp_path, words, ids)
    assert isinstance(lexicon.raw, np.memmap) and len(lexicon.keys) < 20 < sum(map(len, words))
    for i in places(lexicon, words):
        assert lexicon.ids[lexicon.bounds[i]:lexicon.bounds[i + 1]].tolist() == list(range(i, 2 * i))


@pytest.mark.parametrize("most", [0, 40, bpe.LEXICON_WORDS])
def test_encode_and_decode_equal_the_library(spark, sf, most):
    rng = random.Random(6)
    pieces = ["a", "B", "é", "İ", "ß", "'", "'s", ".", "<|", "|>", "<|endoftext|>", "7", " ", "  ", "\n", " \n", "\t", " ", "̈", "x" * 70, "日本"]
    texts = ODD_TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(500)]
    bits = [bin(i).count("1") & 1 for i in range(64)]
    texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    name = bpe.build_lexicon(docs, BYTE, most)
    found = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, BYTE, name), BYTE).collect()}
    tok = Tokenizer.from_file(BYTE)
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert list(found[i].ids) == ids, repr(text)[:80]
        assert found[i].text == tok.decode(ids, skip_special_tokens=False)


def test_lexicon_takes_the_most_frequent_within_its_bound(spark):
    docs = spark.createDataFrame([("bb " * 50 + "cc " * 20 + "dd dd ee",), (None,), ("",), ("bb",)], "text string")
    counts = bpe.word_counts(docs, BYTE)
    assert {bytes(r.word): r.n for r in counts.collect()} == {b"bb": 2, b" bb": 49, b" cc": 20, b" dd": 2}
    for most, words in ((0, set()), (1, {b" bb"}), (2, {b" bb", b" cc"}), (3, {b" bb", b" cc"}), (9, {b"bb", b" bb", b" cc", b" dd"})):
        assert {bytes(r.word) for r in bpe.frequent_words(counts, most).collect()} == words


def test_decode_any_ids(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(40))] for _ in range(300)] + [[], [50256, 50256], [60000, -1, 5]]
    rows = spark.createDataFrame([*enumerate(lists), (None, None), (7, [None, 64])], "doc_id long, ids array<int>")
    tok = Tokenizer.from_file(BYTE)
    found = [r.text for r in bpe.decode(rows, BYTE).collect()]
    known = [[i for i in ids if 0 <= i < 50257] for ids in lists] + [[], [64]]
    assert found == [tok.decode(ids, skip_special_tokens=False) for ids in known]


def test_odd_rows_and_empty_table(spark, odd_docs):
    name = bpe.build_lexicon(odd_docs, BYTE)
    tok = Tokenizer.from_file(BYTE)
    wanted = sorted((r.doc_id is None, r.doc_id or 0, tok.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.collect())
    assert wanted == sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in bpe.encode(odd_docs, BYTE, name).collect())
    empty = odd_docs.limit(0)
    assert bpe.encode(empty, BYTE, bpe.build_lexicon(empty, BYTE)).count() == 0


def test_query(spark, sf):
    tok = Tokenizer.from_file(BYTE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_bpe_transducer(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
