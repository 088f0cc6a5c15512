"""Stored indexes against the plain searches: metric index, inverted k-mer index, co-partitioned sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import metric_index as M
from seqlake.operators import search as SR
from seqlake.operators.seed_index import SeedIndex, build_seed_index
from seqlake.operators.similarity import nearest
from seqlake.session import scratch_path

VECTORS = "cid long, label string, vector array<double>"


def clustered(rng, n, dim, centres=12):
    middle = rng.standard_normal((centres, dim)) * 4
    return (middle[rng.integers(0, centres, n)] + 0.1 * rng.standard_normal((n, dim))).tolist()


def found(df):
    return sorted((r.query_id, r["rank"], r.cid, r.label, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_metric_index_equals_the_plain_search_and_skips(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(i, f"l{i % 3}", v) for i, v in enumerate(clustered(rng, 1500, 12))]
    rows += [(2000 + i, "copy", rows[7][2]) for i in range(300)]  # a hot vector, tied by id
    rows += [(3000, "zero", [0.0] * 12), (3001, "zero", [0.0] * 12), (3002, None, None), (None, "no id", rows[9][2]), (3003, "x", rows[9][2])]
    cands = spark.createDataFrame(rows, VECTORS).repartition(4)
    queries = spark.createDataFrame([(f"q{i}", rows[i][2]) for i in range(0, 1500, 100)] + [("copy", rows[7][2]), ("null", None),
                                    ("tie", rows[9][2]), ("far", (np.array(rows[5][2]) * 1000).tolist())], "query_id string, vector array<double>")
    root = scratch_path(spark, "metric-index")
    M.build_index(cands, root, metric, cells=12, pivots=5, page_rows=40)
    index = M.VectorIndex(spark, root)
    assert index.rows.max() <= 40 and len(index.files) > 40 and index.rows.sum() == len(rows) - 1
    near, work = index.search(queries, 6, order_cols=("cid",))
    wanted = nearest(queries, cands, 6, metric, order_cols=("cid",))
    assert found(near) == found(wanted) and len(found(near)) == 18 * 6
    spent = work.first()
    # vectors of other clusters are never compared; only "far" is out of reach of nothing under euclidean
    assert 0 < spent.compared < 0.45 * spent.pairs


def test_long_vectors_that_differ_a_little(spark):
    """Norms of 1,000 and relative distances of 1e-7: within the noise of a matrix product."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    base *= 1000 / np.linalg.norm(base)
    rows = [(i, "l", (base + rng.standard_normal(16) * 1e-4).tolist()) for i in range(500)]
    cands = spark.createDataFrame(rows, VECTORS).repartition(3)
    queries = spark.createDataFrame([("q", base.tolist())], "query_id string, vector array<double>")
    exact = sorted((float(np.sqrt(((np.array(v) - base) ** 2).sum())), i) for i, _, v in rows)[:9]
    for got in (nearest(queries, cands, 9, "euclidean", order_cols=("cid",)),):
        assert [r.cid for r in got.orderBy("rank").collect()] == [i for _, i in exact]
    root = scratch_path(spark, "metric-index")
    M.build_index(cands, root, "euclidean", page_rows=50)
    assert [r.cid for r in M.nearest_indexed(queries, root, 9, order_cols=("cid",)).orderBy("rank").collect()] == [i for _, i in exact]


def test_metric_index_of_few_or_no_vectors(spark):
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<double>")
    for rows in ([], [(1, "x", None)], [(1, "x", [0.0, 0.0]), (2, "y", [0.0, 0.0])], [(1, "x", [0.5, 1.0])]):
        for metric in ("cosine", "euclidean"):
            cands = spark.createDataFrame(rows, VECTORS)
            root = scratch_path(spark, "metric-index")
            M.build_index(cands, root, metric, page_rows=3)
            near, work = M.VectorIndex(spark, root).search(queries, 3, order_cols=("cid",))
            assert found(near) == found(nearest(queries, cands, 3, metric, order_cols=("cid",)))
            assert work.first().pairs == 2 * sum(v is not None for *_, v in rows)


def test_metric_index_divides_a_hot_page_among_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERY_ROWS", 5)
    rng = np.random.default_rng(4)
    cands = spark.createDataFrame([(i, "l", v) for i, v in enumerate(clustered(rng, 200, 4, 2))], VECTORS)
    queries = cands.select(F.concat(F.lit("q"), "cid").alias("query_id"), "vector")
    root = scratch_path(spark, "metric-index")
    M.build_index(cands, root, "euclidean", page_rows=60)
    near = M.nearest_indexed(queries, root, 4, order_cols=("cid",))
    assert found(near) == found(nearest(queries, cands, 4, "euclidean", order_cols=("cid",)))


def test_metric_index_rejects_mixed_lengths_and_metrics(spark):
    bad = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [1.0, 2.0])], VECTORS).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        M.build_index(bad, scratch_path(spark, "metric-index"))
    with pytest.raises(ValueError, match="metric"):
        M.build_index(bad, "unused", "manhattan")


def proteins(rng, n, hot="WWWWW"):
    """Sequences of motifs: some rare, some common, one (``hot``) in every sequence."""
    motifs = ["".join(rng.choices(SR.AMINO_ACIDS, k=9)) for _ in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [hot + "".join(rng.choices(motifs, weights, k=rng.randrange(1, 9))) for _ in range(n)]


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "target_id", "shared", "query_kmers", "containment", "hit_rank").collect())


@pytest.mark.parametrize("top, least, probe", [(5, 1, 2000), (25, 1, 50), (3, 4, 1), (1000, 1, 2000)])
def test_seed_index_equals_the_plain_search(spark, monkeypatch, top, least, probe):
    from seqlake.operators import seed_index

    monkeypatch.setattr(seed_index, "PROBE_POSTINGS", probe)
    rng = random.Random(top)
    seqs = proteins(rng, 400)
    targets = [(f"t{i:03d}", s) for i, s in enumerate(seqs)] + [("t001", seqs[50] + "X" + seqs[60]), ("t001", None), (None, seqs[3]), ("short", "AC")]
    asked = [(f"q{i}", seqs[i]) for i in range(0, 400, 100)] + [("q0", seqs[1]), ("none", "MMMMMMMM"), ("empty", ""), (None, seqs[2])]
    ts = spark.createDataFrame(targets, "gid string, sequence string").repartition(3)
    qs = spark.createDataFrame(asked, "query_id string, sequence string")
    root = scratch_path(spark, "seed-index")
    build_seed_index(ts, root, buckets=8)
    got, work = SeedIndex(spark, root).search(qs, top, min_shared=least)
    assert hits(got) == hits(SR.protein_seed_search(qs, ts, max_target_seqs=top, min_shared=least))
    spent = {r.figure: r.n for r in work.collect()}
    assert spent["read"] <= spent["postings"]
    if top == 5:
        assert spent["read"] < 0.7 * spent["postings"]  # the list of the motif that all have is not read


def test_seed_search_reads_only_its_folders(spark):
    rng = random.Random(9)
    ts = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(proteins(rng, 200))], "gid string, sequence string")
    root = scratch_path(spark, "seed-index")
    build_seed_index(ts, root, buckets=64)
    index = SeedIndex(spark, root)
    one = spark.createDataFrame([("q", "WWWWWA")], "query_id string, sequence string")  # two codes: two folders at most
    codes = [r.code for r in SR.protein_kmers(one, "query_id").collect()]
    folders = {spark.range(1).select(F.pmod(F.xxhash64(F.lit(c).cast("long")), F.lit(64))).first()[0] for c in codes}
    read = index.table("postings", sorted(folders))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert 0 < read.select(F.input_file_name()).distinct().count() <= 2
    assert len(index.table("postings").inputFiles()) > 16
    assert hits(index.search(one, 5)[0]) == hits(SR.protein_seed_search(one, ts, max_target_seqs=5))


def test_seed_index_counts_targets_and_not_pairs(spark):
    """Every protein asked against all: the candidates kept and counted are targets, however many queries ask for them."""
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACDE", k=60)) for _ in range(60)]  # few letters: every pair shares codes
    ts = spark.createDataFrame([(f"t{i:02d}", s) for i, s in enumerate(seqs)], "gid string, sequence string")
    qs = ts.withColumnRenamed("gid", "query_id")
    root = scratch_path(spark, "seed-index")
    build_seed_index(ts, root, buckets=8)
    got, work = SeedIndex(spark, root).search(qs, 5)
    assert hits(got) == hits(SR.protein_seed_search(qs, ts, max_target_seqs=5))
    assert {r.figure: r.n for r in work.collect()}["counted_in_full"] <= 60


def test_seed_index_of_nothing(spark):
    empty = spark.createDataFrame([], "gid string, sequence string")
    root = scratch_path(spark, "seed-index")
    build_seed_index(empty, root)
    q = spark.createDataFrame([("q", "ACDEFGH")], "query_id string, sequence string")
    assert SeedIndex(spark, root).search(q)[0].collect() == []


def genomes(rng, n):
    shared = "".join(rng.choices("ACGT", k=400))
    return [(f"g{i}", "".join(rng.choices("ACGT", k=600)) + shared + ("ACGTTGCA" * 40 if i % 3 else "")) for i in range(n)]


def anis(df):
    return sorted(tuple(r) for r in df.select("query_id", "dataset_id", "shared", "query_kmers", "ref_kmers", "containment", "ani").collect())


def ancestors(plan, text):
    """Operators above the first one that mentions ``text``, from it up."""
    lines = [x for x in plan.splitlines() if x.strip()]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    at = next(i for i, x in enumerate(lines) if text in x)
    out, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            out.append(x)
            d = depth(x)
    return out


def test_stored_sketch_joins_where_it_lies_and_splits_heavy_codes(spark):
    rng = random.Random(12)
    rows = genomes(rng, 40)
    refs = spark.createDataFrame(rows, "dataset_id string, sequence string")
    q = refs.select(F.col("dataset_id").alias("query_id"), "sequence")
    path = scratch_path(spark, "stored-sketch")
    SR.store_sketch(refs, path, k=11, c=20, buckets=16, code_owners=9)
    stored = SR.StoredSketch(spark, path)
    heavy = {r.code: r.splits for r in stored.splits.collect()}
    assert heavy and max(heavy.values()) == -(-40 // 9)
    per_split = stored.codes.groupBy("code", "split").count().collect()
    assert max(r["count"] for r in per_split) < 30 and len({r["split"] for r in per_split}) > 1
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = SR.ani_estimate(q, None, 11, 20, None, ref_sketch=stored)
        assert anis(joined) == anis(SR.ani_estimate(q, refs, 11, 20, None))
        above = ancestors(joined._jdf.queryExecution().executedPlan().toString(), "Bucketed: true")
        join = next(i for i, x in enumerate(above) if "Join" in x)
        assert not any("Exchange" in x for x in above[:join]), above
        plain = spark.createDataFrame(SR.sketch(refs, "dataset_id", 11, 20).collect(), "dataset_id string, code long")
        shuffled = SR.ani_estimate(q, None, 11, 20, None, ref_sketch=plain)
        above = ancestors(shuffled._jdf.queryExecution().executedPlan().toString(), "Scan ExistingRDD[dataset_id")
        assert any("Exchange" in x for x in above[:next(i for i, x in enumerate(above) if "Join" in x)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    with pytest.raises(ValueError, match="k=11"):
        SR.ani_estimate(q, None, 16, 20, None, ref_sketch=stored)


def test_seed_index_has_two_bytes_a_posting(spark):
    """A row per code and pack with the targets' numbers, not a row of names per posting; the candidates are bits."""
    rng = random.Random(6)
    rows = [(f"t{i:03d}", s) for i, s in enumerate(proteins(rng, 300))]
    ts = spark.createDataFrame(rows, "gid string, sequence string").coalesce(1)
    root = scratch_path(spark, "seed-index")
    build_seed_index(ts, root, buckets=8)
    index = SeedIndex(spark, root)
    kmers = [{s[i:i + 5] for i in range(len(s) - 4)} for _, s in rows]
    postings = index.table("postings").collect()
    assert len(postings) == len(set().union(*kmers)) and sum(len(r.targets) for r in postings) == 2 * sum(map(len, kmers)) == 2 * index.size
    names = index.table("targets").first().names
    number = {c: i for i, c in enumerate(SR.AMINO_ACIDS)}
    held = {r.code: {names[i] for i in np.frombuffer(r.targets, dtype=np.uint16)} for r in postings}
    for code in rng.sample(sorted(held), 20):
        text = "".join(SR.AMINO_ACIDS[code // 20 ** i % 20] for i in (4, 3, 2, 1, 0))
        assert held[code] == {t for (t, _), own in zip(rows, kmers) if text in own} and sum(number[c] * 20 ** (4 - i) for i, c in enumerate(text)) == code
    assert {r.length for r in index.table("lists").collect()} == {len(x) for x in held.values()}
