"""Weighted hash tree against direct descent, growth, shifts of weight, shares and slots."""

import math
import struct
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from seqlake.llm import queries, sharding
from seqlake.llm.sharding import Shard


def draw(key, path, weight):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
    for number in path:
        h = xxhash.xxh64_intdigest(struct.pack("<q", number), h)
    h = xxhash.xxh64_intdigest(b"node-draw", h)
    return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight


def descend(key, tree):
    """Region, then rack, then shard: at each level a draw of the chosen node's children by their whole weight."""
    path, leaves = (), [n for n in tree if n.weight > 0]
    for level in ("region", "rack", "shard"):
        weights = defaultdict(float)
        for n in sorted(leaves, key=lambda n: (n.region, n.rack, n.shard)):
            weights[getattr(n, level)] += n.weight
        best = min(weights, key=lambda x: (draw(key, (*path, x), weights[x]), x))
        path, leaves = (*path, best), [n for n in leaves if getattr(n, level) == best]
    return path


def placed(spark, n, tree):
    return {r.id: (r.region, r.rack, r.shard) for r in sharding.descend(spark.range(n), F.col("id"), tree).collect()}


def test_places_equal_direct_descent(spark):
    tree = [Shard(s, s % 3, s % 2, 0.5 + s) for s in range(9)] + [Shard(9, 0, 1, 0.0)]
    got = placed(spark, 300, tree)
    assert got == {k: descend(k, tree) for k in range(300)}
    assert 9 not in {s for _, _, s in got.values()}
    null = sharding.descend(spark.range(1), F.lit(None).cast("long"), tree).first()
    assert (null.region, null.rack, null.shard) == descend(None, tree)


def test_a_weight_shift_in_a_rack_stays_in_the_rack(spark):
    tree = sharding.regular_tree(40)
    shifted = [Shard(s.shard, s.region, s.rack, {10: 0.5, 11: 1.5}.get(s.shard, 1.0)) for s in tree]
    before, after = placed(spark, 4000, tree), placed(spark, 4000, shifted)
    assert all(before[k][:2] == after[k][:2] for k in before)
    moved = {k for k in before if before[k] != after[k]}
    assert moved and {before[k][:2] for k in moved} == {(1, 0)}
    assert all(before[k][2] == 10 and after[k][2] == 11 or {before[k][2], after[k][2]} & {10, 11} for k in moved)


def test_a_shift_between_racks_stays_in_the_region(spark):
    tree = sharding.regular_tree(40)
    shifted = [Shard(s.shard, s.region, s.rack, {10: 0.25, 15: 1.75}.get(s.shard, 1.0)) for s in tree]
    before, after = placed(spark, 4000, tree), placed(spark, 4000, shifted)
    assert all(before[k][0] == after[k][0] for k in before)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(before[k][0] == 1 for k in moved)
    assert any(before[k][1] != after[k][1] for k in moved)


def test_a_new_region_takes_rows_only_into_itself(spark):
    tree = sharding.regular_tree(12, per_rack=2, racks=2)  # three whole regions
    before = placed(spark, 4000, tree)
    for n in (13, 16):
        after = placed(spark, 4000, sharding.regular_tree(n, 2, 2))
        assert all(after[k] == before[k] or after[k][2] >= 12 for k in before)
        assert any(after[k] != before[k] for k in before)
    gone = placed(spark, 4000, [s for s in sharding.regular_tree(16, 2, 2) if s.region != 3])
    assert gone == before


def test_growth_in_an_old_region_leaves_other_regions_rows_there_or_brings_them_in(spark):
    tree = sharding.regular_tree(12, 2, 2)
    before = placed(spark, 4000, tree)
    after = placed(spark, 4000, [Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else 1.0) for s in tree])
    for k in before:  # shard 5 is in region 1, rack 0
        if before[k][0] != 1:
            assert after[k] == before[k] or after[k][0] == 1
        elif before[k][1] != 0:
            assert after[k] == before[k] or after[k][1] == 0
    share = Counter(s for _, _, s in after.values())
    assert 2.2 < share[5] / (4000 - share[5]) * 11 < 3.8  # weight 3 against eleven of weight 1


def test_slots_have_no_gaps_and_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "slot", "rank", "bucket", F.lit("x").alias("Shard"))
    for per_bucket in (50_000, 1):
        out = sharding.assign_shards(docs, "doc_id", sharding.regular_tree(4), rows_per_bucket=per_bucket)
        assert [c.lower() for c in out.columns].count("shard") == 1 and "rank" in out.columns
        slots = defaultdict(list)
        rows = out.collect()
        for r in rows:
            slots[r.shard].append(r.slot)
        assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"))  # one id everywhere
    out = sharding.assign_shards(hot, "doc_id", sharding.regular_tree(4), rows_per_bucket=50)
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(3000)) and len({r.shard for r in rows}) == 1
    assert sharding.assign_shards(docs.limit(0), "doc_id", sharding.regular_tree(4)).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_sharding(spark, sf).collect()
    tree, grown = sharding.regular_tree(40), sharding.regular_tree(41)
    slots = defaultdict(list)
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 16 and r.law == "key"
        assert r.shard == descend(r.doc_id, tree)[2] and r.grown_shard == descend(r.doc_id, grown)[2]
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
