"""Fingerprints, bit-sliced links and components against direct computation."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import queries, simhash
from seqlake.llm.components import components


def plain_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """{print: frozenset of its component}"""
    groups = {p: {p} for p in prints}
    todo = sorted(groups)
    for i, a in enumerate(todo):
        for b in todo[i + 1:]:
            if (a ^ b).bit_count() <= radius and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[b]:
                    groups[x] = groups[a]
    return groups


def expected(docs, radius=4):
    prints = [(d, plain_print(t)) for d, t in docs]
    groups, ids = plain_components({p for _, p in prints}, radius), {}
    for d, p in prints:
        if d is not None:
            ids[p] = min(ids.get(p, d), d)
    rows = []
    for d, p in prints:
        known = [ids[x] for x in groups[p] if x in ids]
        rows.append((d, f"{p:016x}", min(known) if known else None))
    return sorted(rows, key=repr)


def clustered(rng, n, spread=6):
    out = set()
    while len(out) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            for _ in range(rng.randrange(spread)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return sorted(out)


def test_near_rows_equal_direct_distances():
    rng = random.Random(2)
    for radius in (0, 1, 3, 4, 7):
        prints = np.array(clustered(rng, 300), dtype=np.uint64)
        got = {(q, int(x)) for q, hits in simhash.near_rows(prints, radius, queries=100) for x in hits}
        want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
                if int(prints[i] ^ prints[j]).bit_count() <= radius}
        assert got == want


def test_links_lose_no_component_and_hot_buckets_split(spark):
    rng = random.Random(4)
    prints = clustered(rng, 600, spread=5) + [0xABCD << 40 | i for i in range(300)]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in set(signed)], "fp long")
    groups = plain_components(set(prints), 4)
    want = sorted({tuple(sorted(g)) for g in map(frozenset, groups.values())})
    for block in (simhash.BLOCK, 40):
        edges = simhash.links(df, 4, block)
        root = {r.node: r.root for r in components(edges).collect()}
        found = {}
        for p, s in zip(prints, signed):
            found.setdefault(root.get(s, s), set()).add(p)
        assert sorted(tuple(sorted(g)) for g in found.values()) == want


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, x) for x in range(400, 560) if x != 500] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 400 for i in range(401, 560)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_simhash_dedup(spark, sf).collect()), key=repr) == expected(docs)


def test_odd_rows_and_survivors(spark, odd_docs):
    found = simhash.near_duplicates(odd_docs)
    got = found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    kept = simhash.survivors(found).collect()
    assert len(kept) == found.select("root").distinct().count() == len({r.keep_id for r in kept})
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []
    nobody = odd_docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.component_id for r in simhash.near_duplicates(nobody).collect()} == {None}
