"""K-mer operators against brute-force Python on small inputs."""

import itertools
import math
import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from seqlake.operators import kmers as K
from seqlake.operators import search as SR

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def brute_tnf(seq):
    classes = {}
    canon = sorted({min(c, int("".join("0123"["ACGT".index(b)] for b in rc(m)), 4)) for m in
                    ("".join(p) for p in itertools.product("ACGT", repeat=4))
                    for c in [int("".join("0123"["ACGT".index(b)] for b in m), 4)]})
    idx = {c: i for i, c in enumerate(canon)}
    counts = [0] * 136
    n = 0
    for i in range(len(seq) - 3):
        w = seq[i:i + 4]
        if set(w) <= set("ACGT"):
            code = int("".join("0123"["ACGT".index(b)] for b in w), 4)
            rcode = int("".join("0123"["ACGT".index(b)] for b in rc(w)), 4)
            counts[idx[min(code, rcode)]] += 1
            n += 1
    classes = [c / n if n else 0.0 for c in counts]
    return classes


def test_canonical_table():
    rows = K.canonical_classes(4)
    assert len(rows) == 256 and len({r[2] for r in rows}) == 136
    by = {m: i for m, _, i in rows}
    assert all(by[m] == by[rc(m)] for m in by)
    assert by["AAAA"] == 0 and by["TTTT"] == 0


@pytest.mark.parametrize("method", ["arrow", "explode"])
def test_tnf_matches_brute_force(spark, method):
    random.seed(7)
    seqs = [("s1", "".join(random.choice("ACGTN") for _ in range(1000))),
            ("s2", "ACG"), ("s3", "NNNNACGTNNNN"), ("s4", "".join(random.choice("ACGT") for _ in range(700)))]
    df = spark.createDataFrame(seqs, "gid string, sequence string")
    got = {r.gid: r.tnf_136 for r in K.tnf_136(df, chunk=37, method=method).collect()}
    for gid, s in seqs:
        exp = brute_tnf(s)
        assert len(got[gid]) == 136
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[gid], exp)), gid
    assert abs(sum(got["s1"]) - 1.0) < 1e-4 and sum(got["s2"]) == 0.0


def test_tnf_reverse_complement_invariant(spark):
    random.seed(3)
    s = "".join(random.choice("ACGT") for _ in range(500))
    df = spark.createDataFrame([("f", s), ("r", rc(s))], "gid string, sequence string")
    v = {r.gid: r.tnf_136 for r in K.tnf_136(df).collect()}
    assert all(abs(a - b) < 1e-6 for a, b in zip(v["f"], v["r"]))


def test_kmer_counts_chunk_independent(spark):
    random.seed(5)
    s = "".join(random.choice("ACGTN") for _ in range(3000))
    df = spark.createDataFrame([("x", s)], "gid string, sequence string")
    exp = {}
    for i in range(len(s) - 3):
        w = s[i:i + 4]
        if "N" not in w:
            exp[w] = exp.get(w, 0) + 1
    for chunk in (5, 64, 256, 5000):
        got = {r.kmer: r["count"] for r in K.kmer_counts(df, 4, chunk=chunk, method="explode").collect()}
        assert got == exp, chunk
    got = {r.kmer: r["count"] for r in K.kmer_counts(df, 4).collect()}
    assert got == exp


@pytest.mark.parametrize("method", ["arrow", "explode"])
def test_genome_tnf_sums_contigs_without_junction_kmers(spark, method):
    df = spark.createDataFrame([("g", "c1", "AAAA"), ("g", "c2", "CCCC")], "dataset_id string, gid string, sequence string")
    v = K.genome_tnf(df, method=method).collect()[0]
    assert v.windows == 2  # no window spans the contig junction


def _fmix32(x):
    m = 0xFFFFFFFF
    h = (x ^ (x >> 32)) & m
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & m
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & m
    h ^= h >> 16
    return h


def _code(s):
    v = 0
    for ch in s:
        v = v * 4 + "ACGT".index(ch)
    return v


def test_ani_containment_brute_force(spark):
    random.seed(11)
    a = "".join(random.choice("ACGT") for _ in range(4000))
    b = a[:2000] + "".join(random.choice("ACGTN") for _ in range(2000))
    q = spark.createDataFrame([("qa", a)], "query_id string, sequence string")
    r = spark.createDataFrame([("A", a), ("B", b)], "dataset_id string, sequence string")
    got = {x.dataset_id: x for x in SR.ani_estimate(q, r, k=8, c=4, min_ani=None).collect()}

    def sk(s):
        out = set()
        for i in range(len(s) - 7):
            w = s[i:i + 8]
            if "N" in w:
                continue
            cw = min(_code(w), _code(rc(w)))
            if _fmix32(cw) < (1 << 32) // 4:
                out.add(cw)
        return out

    qa, ra, rb = sk(a), sk(a), sk(b)
    assert got["A"].shared == len(qa & ra) and got["A"].ani == 100.0 and got["A"].query_kmers == len(qa)
    assert got["B"].shared == len(qa & rb) and got["B"].ref_kmers == len(rb)
    assert math.isclose(got["B"].ani, 100 * (len(qa & rb) / len(qa)) ** (1 / 8))
    stored = SR.sketch(r, "dataset_id", k=8, c=4)
    again = {x.dataset_id: x.shared for x in SR.ani_estimate(q, None, k=8, c=4, min_ani=None, ref_sketch=stored).collect()}
    assert again == {"A": got["A"].shared, "B": got["B"].shared}


def test_protein_seed_search_brute_force(spark):
    t = [("t1", "MKVLAAGIVLLA"), ("t2", "MKVLAQQQQQ"), ("t3", "WWWWWWW")]
    q = [("q1", "MKVLAAG")]
    qs = spark.createDataFrame(q, "query_id string, sequence string")
    ts = spark.createDataFrame(t, "gid string, sequence string")
    got = [(r.target_id, r.shared, r.hit_rank) for r in SR.protein_seed_search(qs, ts, k=3, max_target_seqs=5)
           .orderBy("hit_rank").collect()]

    def km(s):
        return {s[i:i + 3] for i in range(len(s) - 2)}
    exp = sorted(((g, len(km("MKVLAAG") & km(s))) for g, s in t if km("MKVLAAG") & km(s)), key=lambda x: (-x[1], x[0]))
    assert [(g, n) for g, n, _ in got] == exp and [r for _, _, r in got] == list(range(1, len(exp) + 1))


def test_nearest_brute_force_batches_and_ties(spark):
    from seqlake.operators.similarity import nearest

    random.seed(21)
    cands = [(f"c{i:03d}", [random.random() for _ in range(6)]) for i in range(120)]
    cands += [("dup_a", cands[0][1]), ("dup_b", cands[0][1])]  # exact ties
    qs = [(f"q{i}", [random.random() for _ in range(6)]) for i in range(30)] + [("qz", [0.0] * 6)]
    qdf = spark.createDataFrame(qs, "query_id string, vector array<double>")
    cdf = spark.createDataFrame(cands, "cid string, vector array<double>")

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 1.0 if na == 0 or nb == 0 else 1 - sum(x * y for x, y in zip(a, b)) / (na * nb)

    for metric, fn in (("cosine", cos), ("euclidean", lambda a, b: math.dist(a, b))):
        got = {}
        for r in nearest(qdf, cdf, k=4, metric=metric, order_cols=("cid",), query_rows=8).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.cid, r.distance))
        for qid, qv in qs:
            exp = sorted(((fn(qv, v), c) for c, v in cands), key=lambda x: (round(x[0], 12), x[1]))[:4]
            g = sorted(got[qid])
            assert [c for _, c, _ in g] == [c for _, c in exp], (metric, qid)
            assert all(abs(d - e) < 1e-9 for (_, _, d), (e, _) in zip(g, exp))


def test_decode_kmer_both_paths(spark):
    from pyspark.sql import functions as F
    from seqlake.operators.kmers import decode_kmer

    rows = spark.createDataFrame([(0,), (27,), (255,)], "code long")
    assert [r[0] for r in rows.select(decode_kmer(F.col("code"), 4, "ACGT")).collect()] == ["AAAA", "ACGT", "TTTT"]


def test_searches_with_empty_query_side(spark):
    q = spark.createDataFrame([("q", "ACG")], "query_id string, sequence string")  # shorter than k
    r = spark.createDataFrame([("A", "ACGTACGTACGTACGTACGT")], "dataset_id string, sequence string")
    assert SR.ani_estimate(q, r, k=8, c=1, min_ani=None).count() == 0
    t = spark.createDataFrame([("t1", "MKVLAAG")], "gid string, sequence string")
    qp = spark.createDataFrame([("q1", "MK")], "query_id string, sequence string")
    assert SR.protein_seed_search(qp, t, k=3).count() == 0


def test_seed_search_merges_rows_of_one_target_and_splits_queries(spark):
    from seqlake.operators.search import protein_seed_search

    q = spark.createDataFrame([("q1", "ACDEFGHIKL"), ("q2", "MNPQRSTVWY"), ("q1", "LMNPQRS")], "query_id string, sequence string")
    t = spark.createDataFrame([("t1", "ACDEFGH"), ("t1", "ACDEFGHI"), ("t2", "ACDEF"), ("t3", "MNPQRS"), ("t4", "GGGGGG"),
                               (None, "ACDEFGHIKL")], "gid string, sequence string").repartition(5)
    for rows in (4096, 1):
        got = sorted(tuple(r) for r in protein_seed_search(q, t, query_rows=rows).select(
            "query_id", "target_id", "shared", "query_kmers", "hit_rank").collect())
        assert got == [("q1", "t1", 4, 9, 1), ("q1", "t2", 1, 9, 3), ("q1", "t3", 2, 9, 2), ("q2", "t3", 2, 6, 1)]


def test_seed_search_with_a_hot_query_and_many_targets(spark):
    from seqlake.operators.search import protein_seed_search

    core = "ACDEFGHIKLMNPQRSTVWY"
    q = spark.createDataFrame([("hot", core)] * 50 + [("cold", "YWVTSRQPNM")], "query_id string, sequence string")
    t = spark.createDataFrame([(f"t{i:04d}", core[: 5 + i % 16]) for i in range(2000)], "gid string, sequence string")
    rows = protein_seed_search(q, t, max_target_seqs=7).orderBy("hit_rank").collect()
    best = sorted(range(2000), key=lambda i: (-(i % 16), f"t{i:04d}"))[:7]
    assert [(r.target_id, r.shared) for r in rows] == [(f"t{i:04d}", 1 + i % 16) for i in best]


def test_equal_vectors_rank_alike_for_any_partitioning(spark):
    import random

    from seqlake.operators.similarity import nearest

    rng = random.Random(8)
    base = [[rng.random() for _ in range(136)] for _ in range(5)]
    cands = [(f"c{i:03d}", base[i % 5]) for i in range(300)]
    q = spark.createDataFrame([("q", base[0]), ("r", base[3])], "query_id string, vector array<double>")
    c = spark.createDataFrame(cands, "cid string, vector array<double>")
    seen = set()
    for n in (1, 4, 16):
        for metric in ("cosine", "euclidean"):
            rows = nearest(q, c.repartition(n), k=9, metric=metric, order_cols=("cid",)).orderBy("query_id", "rank").collect()
            seen.add(tuple((r.query_id, r["rank"], r.cid) for r in rows))
    assert len(seen) == 1 and next(iter(seen))[:2] == (("q", 1, "c000"), ("q", 2, "c005"))


def test_nearest_rejects_mixed_lengths(spark):
    import pytest
    from seqlake.operators.kmers import valid_vectors
    from seqlake.operators.similarity import nearest

    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("n", None)], "cid string, vector array<double>")
    with pytest.raises(Exception, match="different lengths"):
        nearest(q, c, order_cols=("cid",)).collect()
    good, bad = valid_vectors(c, "vector", 2)
    assert [r.cid for r in nearest(q, good, order_cols=("cid",)).collect()] == ["a"] and bad.count() == 2


def test_occurrences_at_chunk_borders(spark):
    import random

    from seqlake.operators.kmers import kmer_occurrences

    rng = random.Random(1)
    seqs = [(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((0, 1, 3, 4, 5, 15, 16, 17, 64, 65, 300, 1000))]
    df = spark.createDataFrame(seqs, "gid int, sequence string")
    got = sorted((r.gid, r.kmer) for r in kmer_occurrences(df, 4, ["gid"], chunk=4).collect())
    assert got == sorted((i, s[p:p + 4]) for i, s in seqs for p in range(len(s) - 3))


def test_shared_codes_equal_set_intersections(monkeypatch):
    """Frequent codes (a matrix product), rare ones (lists, a few hits at a time), repeated names and empty sets."""
    import numpy as np

    from seqlake.functions.codes import SharedCodes, most_shared

    rng = np.random.default_rng(2)
    draw = lambda n: [np.unique(np.minimum(rng.geometric(0.02, rng.integers(0, 90)), 400)) for _ in range(n)]
    sets, others = draw(150), draw(70)
    names = np.array([f"s{i % 140:03d}" for i in range(150)], dtype=object)
    own = {}
    for name, codes in zip(names, sets):
        own.setdefault(name, set()).update(codes.tolist())
    monkeypatch.setattr(SharedCodes, "HITS", 500)
    block = SharedCodes(names, sets)
    assert 0 < len(block.dense) < len(block.codes) and block.sizes.tolist() == [len(own[n]) for n in block.names]
    want = [[len(own[n] & set(o.tolist())) for n in block.names] for o in others]
    assert block.counts(others).tolist() == want
    targets = np.array([f"t{i % 60:02d}" for i in range(70)], dtype=object)
    least = np.ones(len(own), dtype=np.int64)
    i, t, c = most_shared(block, targets, others, 3, least, rows=20)
    for j, name in enumerate(block.names):
        best = {}
        for target, row in zip(targets, want):
            best[target] = max(best.get(target, 0), row[j])
        top = sorted((-n, target) for target, n in best.items() if n)[:3]
        found = {(-n, target) for a, target, n in zip(i, t, c) if a == j}
        assert set(top) <= found and (len(top) < 3 or least[j] <= -top[2][0])


def test_a_block_is_prepared_once_for_all_batches_of_a_chunk(spark):
    from seqlake.operators.blocks import score_in_blocks

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        def prepare(q):
            return {"n": len(q), "batches": 0}

        def score(held, c):
            held["batches"] += 1
            return pd.DataFrame({"rows": [len(c)], "asked": [held["n"]], "batch": [held["batches"]]})

        found = score_in_blocks(spark.range(20).withColumnRenamed("id", "q"), spark.range(300), "q", score,
                                "rows long, asked long, batch long", 4096, prepare).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["rows"].sum() == 300 and set(found["asked"]) == {20} and found["batch"].max() > 1


def test_letters_of_other_alphabets_become_x_wherever_they_stand(spark):
    from seqlake.sources.surrogate import _letters

    texts = ["", None, "abc", "жabжжc", "ab ж", "Ünï-çødé 42!", "漢字x漢", "a\U00010400b\U0001F600c", "жжж", "x\n\ty" * 3000 + "ж", "ab" * 50000]
    want = ["", None, "abc", "xabxxc", "abx", "unicodehe", "xxxx", "axbc", "xxx", "xy" * 3000 + "x", "ab" * 50000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", _letters(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in rows] == want
    plan = df.select(_letters(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "\\G([a-z]*+)[^a-z]" in plan  # runs of a-z are passed in one step


def test_chunks_of_a_short_sequence_lie_together(spark):
    from seqlake.operators import chunks as CH
    from seqlake.session import scratch_path

    rng = random.Random(8)
    rows = [(f"g{i}", "".join(rng.choices("ACGTN", k=200))) for i in range(60)] + [("none", None), ("short", "AC")]
    seqs = spark.createDataFrame(rows, "gid string, sequence string").repartition(5)
    path = scratch_path(spark, "chunks")
    CH.write_chunks(seqs, path, ["gid"], core=20)
    stored = spark.read.parquet(path)
    files = stored.select("gid", F.input_file_name().alias("file")).groupBy("gid").agg(F.countDistinct("file").alias("n"), F.count(F.lit(1)).alias("chunks"))
    assert files.agg(F.max("n"), F.max("chunks")).first() == (1, 10)
    assert sorted(map(tuple, CH.kmer_counts(stored, 4).collect())) == sorted(map(tuple, K.kmer_counts(seqs, 4).collect()))
    assert sorted(map(tuple, CH.tnf_136(stored).collect())) == sorted(map(tuple, K.tnf_136(seqs).collect()))


def test_sums_of_chunks_take_more_partitions_for_more_letters(spark, monkeypatch):
    from seqlake.operators import chunks as CH

    seqs = spark.createDataFrame([(f"g{i}", "ACGTTGCAAC" * 9) for i in range(40)], "gid string, sequence string")
    monkeypatch.setattr(CH, "PARTITION_LETTERS", 100)
    got = CH.kmer_counts(CH.cut_chunks(seqs, ["gid"], core=20), 3)
    assert "hashpartitioning(gid#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 36)" in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.kmer_counts(seqs, 3).collect()))


def test_genome_counts_are_one_row_per_genome_and_batch(spark):
    rng = random.Random(6)
    rows = [(None if i % 7 == 0 else f"d{i % 3}", f"g{i}", "".join(rng.choices("ACGTN", k=30)) if i % 5 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "dataset_id string, gid string, sequence string").coalesce(1)
    assert K._summed_class_counts(df, "dataset_id", "sequence").count() == 4
    records = K._arrow_class_counts(df, "gid", "sequence").collect()
    assert len(records) == 1500 and {len(r.class_counts) for r in records} == {136}
    got = {r.dataset_id: r for r in K.genome_tnf(df).collect()}
    for genome in ("d0", "d1", "d2", None):
        whole = K.class_counts_batch([s for d, _, s in rows if d == genome])
        assert got[genome].windows == sum(int(c.sum()) for c in whole)


@pytest.mark.parametrize("k, c", [(16, 1000), (16, 1), (8, 4), (31, 3), (17, 2), (4, 1), (1, 1)])
def test_batch_sketch_equals_that_of_single_sequences(k, c):
    from seqlake.functions import codes

    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGTNé中", [30, 30, 30, 30, 1, .2, .2], k=n)) for n in (0, 1, k - 1, k, 40, 500, 70000, 140000, 3)]
    seqs += [None, "ACGT" * 9, seqs[5]]
    row, code = codes.sketch_batch(seqs, k, c)
    for i, s in enumerate(seqs):
        assert sorted(set(code[row == i].tolist())) == codes.sketch_codes(s or "", k, c).tolist()
    assert len(codes.sketch_batch([], k, c)[0]) == 0


def _counted(df, log):
    """``df``, and in ``log`` one mark per row and time that it is computed."""
    def run(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("x" * len(b))
            yield b

    return df.coalesce(1).mapInPandas(run, df.schema)


def _genome_rows():
    rng = random.Random(4)
    return [(f"g{i % 3}", f"g{i % 3}|{i}", "NT", n, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate([900, 700, 800, 300, 200, 600])]


def test_placement_reads_query_sequences_twice(spark, tmp_path):
    """Once for the TNF and once for the sketch, whatever the plan makes of them."""
    from seqlake.operators.placement import META_COLS, place_genome

    rows = _genome_rows()
    refs = spark.createDataFrame(rows, "dataset_id string, gid string, seq_type string, length int, sequence string")
    refs = refs.select("*", *[F.lit("m").alias(c) for c in META_COLS])
    asked = refs.select(F.col("dataset_id").alias("query_id"), "gid", "sequence")
    got = place_genome(_counted(asked, tmp_path / "q"), _counted(refs, tmp_path / "r"), ani_c=2).collect()
    assert {(r.query_id, r.ani_top_match, r.placement) for r in got} == {(f"g{i}", f"g{i}", "species-level match") for i in range(3)}
    assert len((tmp_path / "q").read_text()) == 2 * len(rows)
    # longest contigs, their letters, the sketch, and the metadata for either part
    assert len((tmp_path / "r").read_text()) <= 5 * len(rows)


def test_comparison_reads_query_sequences_twice(spark, tmp_path):
    from seqlake.operators import placement, similarity

    rows = _genome_rows()
    refs = spark.createDataFrame(rows, "dataset_id string, gid string, seq_type string, length int, sequence string")
    refs = refs.select("*", *[F.lit("m").alias(c) for c in placement.META_COLS])
    asked = _counted(refs.select(F.col("dataset_id").alias("query_id"), "gid", "sequence"), tmp_path / "q")
    found = placement.nearest_by_tnf(K.genome_tnf(asked, genome_col="query_id"), refs, "cosine", 10)
    ani = SR.ani_estimate(asked, _counted(refs.select("dataset_id", "sequence"), tmp_path / "r"), 16, 2, None)
    got = similarity.compare_tnf_ani(found, ani).collect()
    assert len(got) == 9 and {r.dataset_id for r in got if r.ani == 100.0 and r.query_id == "g1"} == {"g1"}
    assert len((tmp_path / "q").read_text()) == 2 * len(rows)
    assert len((tmp_path / "r").read_text()) == len(rows)


@pytest.mark.parametrize("table", [1 << 23, 0])
def test_pruned_block_finds_all_that_reach_the_bound(monkeypatch, table):
    """Spans, rows, hits and held pairs in many small pieces; codes by table and by search; repeated names."""
    import numpy as np

    from seqlake.functions.codes import PrunedBlock

    for name, value in (("SPAN", 16), ("ROWS", 5), ("HITS", 300), ("HELD", 40), ("TABLE", table)):
        monkeypatch.setattr(PrunedBlock, name, value)
    rng = np.random.default_rng(5)
    draw = lambda n: [np.unique(np.minimum(rng.geometric(0.03, rng.integers(0, 120)), 200)) for _ in range(n)]
    sets, others = draw(50), draw(80)
    names = np.array([f"s{i:02d}" for i in range(50)], dtype=object)
    targets = np.array([f"t{i % 70:02d}" for i in range(80)], dtype=object)
    sizes = np.array([len(s) for s in sets])
    for least in (np.ones(50, np.int64), np.maximum(1, (sizes * 0.7).astype(np.int64)), rng.integers(1, 60, 50), np.full(50, 500)):
        block = PrunedBlock(names, sizes, np.concatenate(sets), least.copy())
        i, t, c = block.search(targets, np.array([len(o) for o in others]), np.concatenate(others), 4)
        for j, name in enumerate(names):
            best = {}
            for target, o in zip(targets, others):
                best[target] = max(best.get(target, 0), len(set(sets[j].tolist()) & set(o.tolist())))
            top = sorted((-n, target) for target, n in best.items() if n >= least[j])[:4]
            got = {}
            for a, target, n in zip(i, t, c):
                if block.names[a] == name:
                    got[target] = max(got.get(target, 0), n)  # rows of a target may be found apart
            assert sorted((-n, target) for target, n in got.items())[:4] == top


@pytest.mark.parametrize("probe", [0, 12, 1000])
def test_search_in_two_passes_equals_brute_force(spark, probe):
    from seqlake.operators import search as SR
    from seqlake.operators.packs import Search, write_packs
    from seqlake.session import scratch_path

    rng = random.Random(probe)
    motifs = ["".join(rng.choices(SR.AMINO_ACIDS, k=8)) for _ in range(40)]
    seqs = ["".join(rng.choices(motifs, k=rng.randrange(1, 12))) for _ in range(150)]
    targets = [(f"t{i % 140:03d}", s) for i, s in enumerate(seqs)] + [("none", None)]
    asked = [(f"q{i % 11}", seqs[i * 7]) for i in range(14)] + [("empty", "")]
    packs = write_packs(spark.createDataFrame(targets, "_t string, _s string").repartition(3), scratch_path(spark, "packs"), 5, SR.AMINO_ACIDS)
    codes = SR.protein_codes(spark.createDataFrame(asked, "_q string, _s string"), ["_q"], "_s").withColumnRenamed("codes", "_s")
    search = Search(codes, packs, 6, 2, query_rows=4, probe=probe)
    assert search.asked.blocks == 4
    kmers = lambda s: {s[i:i + 5] for i in range(len(s or "") - 4)}
    sets = {}
    for q, s in asked:
        sets.setdefault(q, set()).update(kmers(s))
    want = []
    for q, own in sets.items():
        best = {}
        for t, s in targets:
            best[t] = max(best.get(t, 0), len(own & kmers(s)))
        want += [(q, t, n, len(own), r + 1) for r, (n, t) in enumerate(sorted((-n, t) for t, n in best.items() if n >= 2)[:6])]
    got = SR.best_shared(search.batches(), 6)
    assert sorted((r._q, r._t, -r.shared, r.query_kmers, r.hit_rank) for r in got.collect()) == sorted(want)
    plan = search.batches()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # no query or target is dealt to many partitions


def test_hits_with_metadata_are_searched_once(spark):
    from seqlake.operators import hits as H
    from seqlake.operators import search as SR

    rows = [(f"g{i}|p{i}", f"g{i}", "AA", 20, "".join(random.Random(i % 5).choices(SR.AMINO_ACIDS, k=20))) for i in range(20)]
    cat = spark.createDataFrame(rows, "gid string, dataset_id string, seq_type string, length int, sequence string")
    for c in H.PROTEIN_META[3:]:
        cat = cat.withColumn(c, F.lit(c))
    found = SR.protein_seed_search(cat.limit(3).select(F.col("gid").alias("query_id"), "sequence"), cat, max_target_seqs=4)
    out = H.seed_search_with_metadata(found, cat)
    assert "MapIn" not in out._jdf.queryExecution().executedPlan().toString()  # the plan reads hits, which are found before
    assert sorted((r.query_id, r.target_id, r.dataset_id, r.target_length) for r in out.collect()) == \
        sorted((r.query_id, r.target_id, r.target_id.split("|")[0], 20) for r in found.collect())
    assert out.count() == 12
