"""Ball-tree search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seqlake.llm import balltree, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [w.translate(LOWER) for w in WORDS.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // length
            score = 0
            for t in terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out += [(item, rank + 1, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def corpus(rng, n):
    vocabulary = ["".join(rng.choices("abcdefgéXY9", k=rng.randrange(1, 6))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda most: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, weights, k=rng.randrange(0, most)))
    docs = [(i, text(80)) for i in range(n)]
    docs += [(i, docs[i % 7][1]) for i in range(n, n + 60)]  # copies: ties by id
    items = [(i, text(30)) for i in range(25)] + [(50, docs[3][1]), (51, "ab " * 400)]
    return docs, items


@pytest.mark.parametrize("tree, leaf, block", [(4096, 32, 32_768), (40, 3, 32_768), (16, 1, 60)])
def test_equals_scoring_every_document(spark, tree, leaf, block):
    docs, items = corpus(random.Random(tree), 400)
    docs += [(None, docs[5][1]), (3, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "..!")]
    items += [(None, docs[5][1]), (7, items[7][1]), (60, None), (61, ""), (62, "?!"), (63, "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = balltree.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), 10, block, tree, leaf)
    assert rows(found) == brute(docs, items)


def tree_of(rng, n, groups=1):
    columns, values, bounds = [], [], [0]
    for i in range(n):
        low = 40 * (i % groups)
        picked = sorted(rng.sample(range(low, low + 40), rng.randrange(0, 20)))
        columns += picked
        values += [rng.randrange(1, 3 * 10 ** 10) for _ in picked]
        bounds.append(len(columns))
    return balltree.BallTree(np.arange(n), np.array(bounds), np.array(columns, dtype=np.int64), np.array(values, dtype=np.int64))


def test_bounds_hold_and_subtrees_are_pruned():
    rng = random.Random(8)
    tree = tree_of(rng, 900, groups=12)
    dense = np.zeros((900, len(tree.columns)), dtype=np.int64)
    for d in range(900):
        s, e = tree.bounds[d], tree.bounds[d + 1]
        dense[d, tree.terms[s:e]] = tree.values[s:e]
    scored = leaves = 0
    for _ in range(60):
        low = 40 * rng.randrange(12)
        wanted = np.array(sorted(rng.sample(range(low, low + 40), 5)))
        times = np.array([rng.randrange(1, 4) for _ in wanted])
        q = np.zeros(len(tree.columns), dtype=np.int64)
        q[np.searchsorted(tree.columns, wanted)] = times
        exact = dense @ q
        norm = math.sqrt(float(times @ times))
        for k, (a, b, left, right) in enumerate(tree.nodes):
            assert q @ tree.centroid[:, k] + norm * tree.radius[k] >= exact[a:b].max()
            assert (q @ tree.most[:, k]) * (1 + balltree._SLACK) >= exact[a:b].max()
            assert left < 0 or (tree.nodes[left][0], tree.nodes[left][1], tree.nodes[right][1]) == (a, tree.nodes[right][0], b)
        kept = balltree.Kept(10, 1)
        a, b = tree.search(wanted, times, kept)
        scored, leaves = scored + a, leaves + b
        best = np.lexsort((tree.ids, -exact))[:10]
        best = best[exact[best] > 0]
        assert kept.scores.tolist() == exact[best].tolist() and kept.ids.tolist() == tree.ids[best].tolist()
    assert scored < 0.5 * leaves


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert rows(balltree.rank_documents(docs.limit(0), items)) == rows(balltree.rank_documents(docs, items.limit(0))) == []
    assert balltree.rank_documents(docs.limit(0), items).dtypes == balltree.rank_documents(docs, items).dtypes
    assert rows(balltree.rank_documents(docs, items)) == brute([(1, "a b")], [(1, "b c")])


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, "word hello 日本語 x", "c"), (2, "ÇA ca é", "c"), (3, "\x00 \x1c", "c")], "item_id long, text string, rank string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(balltree.rank_documents(odd_docs, items)) == brute(docs, [(r.item_id, r.text) for r in items.collect()])


def test_items_in_blocks(spark):
    terms_of = balltree.item_terms(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(50)] + [(99, " ".join(map(str, range(80))))],
                                                         "item_id long, text string"))
    blocks = balltree.item_blocks(terms_of, 30)
    parts = [(b.count(), b.select("item").distinct().count()) for b in blocks]
    assert all(n <= 30 or items == 1 for n, items in parts) and sum(n for n, _ in parts) == terms_of.count()


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(queries.op12_ranked_search(spark, sf)) == brute(docs, items)
