"""Decontamination against a direct search and, on the driver tables, against SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from seqlake.llm import decontam, queries

PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            k = min(n, len(iw))
            wins = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else set()
            for i in range(len(w) - k + 1) if wins else ():
                if tuple(w[i:i + k]) in wins:
                    hit.update(range(i, i + k))
                    found |= {item} - {None}
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def test_against_direct_search(spark, odd_docs):
    rng = random.Random(5)
    vocab = ["a", "B", "c1", "é", "Ünï", "ÇA", "x"]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", ", ", ".\n", " - "]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(12)] + [(None, text(6)), (3, text(4)), (20, None)]
    docs = [(i, text(rng.choice([0, 1, 3, 30, 80]))) for i in range(40)]
    docs += [(r.doc_id, r.text) for r in odd_docs.collect()]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as items", "'c' as n_words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' as windows")
    for block_words in (1_000_000, 4):
        got = decontam.find_hits(d, b, n=4, block_words=block_words)
        rows = sorted(((r.doc_id, r.n_words, r.hit_words, r.items) for r in got.collect()), key=repr)
        assert rows == brute(docs, items, 4)
    for r in decontam.remove_spans(got).collect():
        kept = [w for i, w in enumerate(words(r.text)) if i not in set(r.hit_words)]
        if r.text is None:
            assert r.clean_text is None
        else:
            assert "".join(words(r.clean_text)) == "".join(kept)
    assert decontam.find_hits(d.limit(0), b).collect() == []
    assert all(r.hit_words == [] for r in decontam.find_hits(d, b.limit(0)).collect())


@pytest.mark.parametrize("name", ["op2_decontamination"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == rel.columns
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(rel.fetchall())
    assert any(r[-1] for r in rows) and rows[0][4] in {r[4] for r in rows}
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in rows}
