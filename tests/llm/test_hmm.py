"""Hidden Markov scoring against step-by-step Python on a small corpus."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqlake.llm import hmm, queries


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_rows(docs, held):
    count = Counter(w for d, t in docs if not held(d) for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in docs:
        w = [*tokens(t), None]
        out.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n,
                    sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def crc_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 == 0


def compare(rows, docs, held):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in base_rows(docs, held)), key=repr)


def forward_by_hand(model, seq):
    """Plain sum over all paths by the unscaled recursion."""
    a = model.start * model.emit[seq[0]]
    for s in seq[1:]:
        a = np.array([sum(a[i] * model.move[i, j] for i in range(len(a))) * model.emit[s, j] for j in range(len(a))])
    return math.log10(a.sum())


def test_forward_and_expected_counts_by_hand():
    rng = np.random.default_rng(5)
    model = hmm.initial_model(7, 3, seed=2)
    seqs = [rng.integers(0, 7, n) for n in (1, 2, 2, 5, 9, 4)]
    assert np.allclose(hmm.log_likelihoods(model, seqs), [forward_by_hand(model, s) for s in seqs])
    want = hmm.Model(np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)))
    for s in seqs:  # posterior of every path of states, one by one
        paths = {}
        for code in range(3 ** len(s)):
            path = [code // 3 ** i % 3 for i in range(len(s))]
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            paths[tuple(path)] = p
        total = sum(paths.values())
        for path, p in paths.items():
            want.start[path[0]] += p / total
            for t, x in enumerate(path):
                want.emit[s[t], x] += p / total
                if t:
                    want.move[path[t - 1], x] += p / total
    got = hmm.expected_counts(model, seqs)
    for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
        assert np.allclose(a, b)


def test_waves_of_any_width_agree(monkeypatch):
    rng = np.random.default_rng(6)
    model = hmm.initial_model(9, 4)
    seqs = [rng.integers(0, 9, rng.integers(1, 60)) for _ in range(80)]
    wide, counts = hmm.log_likelihoods(model, seqs), hmm.expected_counts(model, seqs)
    monkeypatch.setattr(hmm, "_WAVE", 90)
    assert np.allclose(hmm.log_likelihoods(model, seqs), wide)
    assert np.allclose(hmm.expected_counts(model, seqs).emit, counts.emit)
    better = hmm.updated(counts)
    assert hmm.log_likelihoods(better, seqs).sum() > wide.sum()


def test_whole_score_by_hand(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(200 + i, f"the cat {i} sat on the mat the Cat") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    rows = hmm.score(df, hmm.held_out_tenth(F.col("doc_id")), states=2, passes=2, own_classes=5, ending_classes=4).collect()
    compare(rows, docs, crc_held)
    # classes, then training, by hand
    train = [t for d, t in docs if not crc_held(d)]
    count = Counter(w for t in train for w in tokens(t))
    own = sorted(count, key=lambda w: (-count[w], w.encode()))[:5]
    endings = {r.w: r.h for r in spark.createDataFrame([(w,) for d, t in docs for w in set(tokens(t))], "w string").select(
        "w", F.pmod(F.xxhash64(F.substring("w", -3, 3)), F.lit(4)).alias("h")).collect()}
    cls = lambda w: 9 if w is None else own.index(w) if w in own else 5 + endings[w]
    seq = lambda t: np.array([cls(w) for w in [*tokens(t), None]])
    model = hmm.initial_model(10, 2)
    for _ in range(2):
        model = hmm.updated(hmm.expected_counts(model, [seq(t) for t in train]))
    size, kinds = Counter(), Counter()
    for w, c in count.items():
        size[cls(w)] += c
        kinds[cls(w)] += 1
    inside = lambda w: 0.0 if w is None or w in own else math.log10(
        (count[w] + 0.1) / (size[cls(w)] + 0.1 * (kinds[cls(w)] + 1)))
    want = sorted((round(float(hmm.log_likelihoods(model, [seq(t)])[0]) + sum(inside(w) for w in tokens(t)), 6)) for _, t in docs)
    assert np.allclose(sorted(r.score for r in rows), want, atol=1e-5)


def test_training_ends_when_the_likelihood_has_settled(spark):
    rng = np.random.default_rng(7)
    texts = [np.concatenate([rng.integers(0, 4, 20), rng.integers(4, 8, 20)]) for _ in range(60)]
    rows = [(False, zlib.compress(t.astype("<u2").tobytes(), 1)) for t in texts]
    encoded = spark.createDataFrame(rows, "held_out boolean, symbols binary").repartition(3)
    log = []
    model = hmm.train(encoded, 8, states=2, passes=40, settled=1e-3, log=log)
    assert 3 <= len(log) < 40 and log[-1] - log[-2] < 1e-3 and all(b > a - 1e-9 for a, b in zip(log, log[1:]))
    assert all(b - a >= 1e-3 for a, b in zip(log[:-2], log[1:-1]))
    # the last logged fit is that of the model before the last step
    start = hmm.initial_model(8, 2)
    assert math.isclose(log[0], hmm.log_likelihoods(start, texts).sum() / sum(map(len, texts)), rel_tol=1e-9)
    assert hmm.log_likelihoods(model, texts).sum() / sum(map(len, texts)) >= log[-1] - 1e-9
    assert len(hmm.train(encoded, 8, states=2, passes=2).emit) == 8


def test_words_of_a_block(spark):
    texts = pa.array(["The cat\tTHE\x0b dog\r\n", None, "", " x ", "é É\u00a0z cat"]).slice(0)
    words, bounds = hmm.tokens_in(texts)
    got = [[w.decode() for w in words.to_pylist()[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [tokens(t) for t in texts.to_pylist()]


def test_blocks_do_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op9_hmm_scoring(spark, sf).collect()
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    compare(rows, plain, crc_held)
    assert all(r.score < 0 for r in rows)
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    again = {r.doc_id: r.score for r in queries.op9_hmm_scoring(spark, sf).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-9) for r in rows)


def test_empty_tables_and_no_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert hmm.score(df.limit(0), F.lit(False)).collect() == []
    rows = hmm.score(df, F.lit(True), states=2, own_classes=3, ending_classes=2).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(abs(r.base_score) < 1e-9 for r in rows) and all(math.isfinite(r.score) for r in rows)
