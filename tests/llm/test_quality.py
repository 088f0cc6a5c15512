"""Quality measures against direct counting, the cascade's order and verdicts."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from seqlake.llm import quality, queries


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    ln = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ln) - len(set(ln)), len(covered), base)


EXTRA = ["a b c a b c a b c", "a b c a b", "x x x x", "one\ntwo\none\n\n \none\ttwo", "# a | b <c> $%&",
         "The quick brown fox. " * 30, "\n".join(f"line{i} number{i} has own{i} words{i}" for i in range(40)),
         "LOUD WORDS " + " ".join(f"SHOUT{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60))]


def test_measures_against_direct_counting(spark, odd_docs):
    docs = odd_docs.union(odd_docs.limit(0)).select("doc_id", "text", "kept", "n_words").union(
        spark.createDataFrame([(100 + i, t, "c", "c") for i, t in enumerate(EXTRA)],
                              "doc_id long, text string, kept string, n_words string"))
    got = quality.judge(docs).collect()
    rows = sorted(((r.doc_id, *r[1:7]) for r in got), key=repr)
    assert rows == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)
    for r in got:
        assert r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed)
    by_id = {r.doc_id: r for r in got}
    assert by_id[105].rejected_by == "repetition" and by_id[106].kept and by_id[107].rejected_by == "shouting"
    assert quality.judge(docs.limit(0)).collect() == []


def test_scripts_with_vowel_signs_or_without_blanks_are_kept(spark):
    hindi = ["नमस्ते", "दुनिया", "किताब", "पढ़ना", "अच्छा", "विद्यालय", "मित्र", "सुंदर"]
    texts = [" ".join(hindi[(i * i + i // 8) % 8] + str(i) for i in range(60)),
             "".join("這是一個很長的句子沒有空格"[i % 13] for i in range(90)) + " " + " ".join("短句%d" % i for i in range(60))]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.rejected_by for r in sorted(rows)] == [None, None]


def test_order_follows_rejections_per_cost():
    e = [quality.Estimate("a", 1.0, 0.1), quality.Estimate("b", 0.1, 0.1), quality.Estimate("c", 5.0, 0.9),
         quality.Estimate("d", 0.2, 0.0), quality.Estimate("e", 0.1, 0.0)]
    rules = [quality.Rule(x.rule, None) for x in e]
    assert [r.name for r in quality.ordered(rules, e)] == ["b", "c", "a", "e", "d"]


def test_verdict_does_not_depend_on_the_order(spark):
    df = spark.range(60).select("id", *[(F.col("id") % k == 0).alias(f"r{k}") for k in (2, 3, 5)])
    rules = [quality.Rule(f"r{k}", F.col(f"r{k}")) for k in (2, 3, 5)]
    for order in (rules, rules[::-1]):
        kept = {r.id for r in df.where(quality.first_rejection(order).isNull()).collect()}
        assert kept == {i for i in range(60) if i % 2 and i % 3 and i % 5}
    estimates = {e.rule: e.rejected for e in quality.estimate(df, rules)}
    assert estimates == {"r2": 0.5, "r3": 20 / 60, "r5": 0.2}


def test_query_matches_sql_and_runs_no_python(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(queries.ORACLE["op8_quality_rules"])
    df = queries.op8_quality_rules(spark, sf)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
