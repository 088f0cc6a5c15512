"""The pipeline's stages against brute force, on the smallest tables and on odd rows."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from .test_decontam import words
from .test_secret_scan import plain as plain_secrets
from .test_simhash import expected as plain_components
from tokenizers import Tokenizer

import corpus_pipeline as cp
from seqlake.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], sf), "t-stage"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_columns_and_drop_only_what_they_should(spark, sf, stages):
    docs, known, unique, clean, redacted, packed = stages
    assert [n for n, _ in cp.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    for df in stages[:-1]:
        assert df.columns == docs.columns and df.schema == docs.schema
    dropped = {d for d, _ in pairs(docs)} - {d for d, _ in pairs(known)}
    assert all(not any(c.isalpha() for c in t or "") for d, t in pairs(docs) if d in dropped)
    component = {d: c for d, _, c in plain_components(pairs(known))}
    assert {d for d, _ in pairs(unique)} == set(component.values()) and unique.count() == len(set(component.values()))
    grams = {tuple(w[i:i + min(10, len(w))]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()
             for w in [words(r.text)] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}
    hit = {d for d, t in pairs(unique) for w in [words(t)] if any(tuple(w[i:i + k]) in grams for k in sizes
                                                                 for i in range(len(w) - k + 1))}
    assert hit and {d for d, _ in pairs(clean)} == {d for d, _ in pairs(unique)} - hit
    texts = dict(pairs(redacted))
    assert set(texts) == {d for d, _ in pairs(clean)}
    for d, t in pairs(clean):
        spans = plain_secrets(t)
        assert bool(spans) == ("[SECRET]" in texts[d]) or not spans
        assert all(t[a:b] not in texts[d] for a, _, b in spans)
    chars = {r.doc_id: (r.n_chars, len(r.text)) for r in redacted.collect()}
    assert all(a == b for a, b in chars.values())


def test_packing_covers_what_the_stages_kept(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, by_doc = stages[-1].collect(), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    texts = dict(pairs(stages[-2]))
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        data = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start))
        assert [int.from_bytes(data[i:i + 4], "little") for i in range(0, len(data), 4)] == [
            *tok.encode(texts[d], add_special_tokens=False).ids, 1]


def test_run_equals_the_stages(spark, sf, stages):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got, want = (sorted(map(tuple, df.select(cols).collect())) for df in (cp.run(spark, sf), stages[-1]))
    assert got == want


def test_odd_rows(spark, sf, odd_docs):
    docs = odd_docs
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "t-odd")
        assert docs.columns == odd_docs.columns
    kept = pairs(docs)
    assert len(kept) == len(set(kept)) and (None, "no id here") in kept
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= len(kept)
    empty = odd_docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).collect() == []
    other = odd_docs.where("text is not null").withColumn("n_chars", F.lit("many"))
    assert cp.secrets(spark, other, sf).where("n_chars = 'many'").count() == other.count()
