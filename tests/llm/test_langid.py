"""Language identification: held-out accuracy, backoff by hand and odd rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from seqlake.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert 0.2 < len(out) / len(rows) < 0.3
    assert sum(r.lang_pred == r.lang for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_by_hand():
    counts = [("de", 0, "und", 8), ("en", 0, "and", 6), ("de", 2, "^u", 3), ("en", 2, "^a", 3), ("en", 1, "x", 4),
              ("de", 3, "^ux", 2)]
    model = langid.LanguageModel(["de", "en"], counts)
    s = langid._SMOOTH

    def p(n, c, lang, total, kinds):
        return math.log((c + s) / (total + s * (kinds + 1)))

    want = [p(3, 2, "de", 2, 1) + p(1, 0, "de", 0, 1), p(3, 0, "en", 0, 1) + p(1, 4, "en", 4, 1)]
    assert np.allclose(model.backoff("uxx"), want, atol=1e-5)  # ^ux, then x alone; $ is unknown
    scorer = langid.Scorer(model)
    assert scorer.predict("Und UND and")[0] == "de" and scorer.predict("and")[0] == "en"
    lang, score = scorer.predict("Ω")
    assert lang == "de" and score == 0.5
    assert scorer.predict(None) == scorer.predict("12 !") == ("und", 0.0)


def test_cache_bound_changes_nothing(monkeypatch):
    model = langid.LanguageModel(["a", "b"], [("a", 1, "x", 5), ("b", 1, "y", 5), ("a", 0, "xx", 2)])
    text = " ".join("xy"[i % 2] * (i % 37) + "x" for i in range(400))
    want = langid.Scorer(model).predict(text)
    monkeypatch.setattr(langid, "_CACHE", 7)
    monkeypatch.setattr(langid, "_CHUNK", 5)
    assert langid.Scorer(model).predict(text) == want


def test_odd_rows(spark, odd_docs):
    model = langid.fit(odd_docs)
    rows = langid.identify(odd_docs, model, "p", "s").select("text", "p", "s").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.p == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
    kept = langid.keep_identified(odd_docs.withColumn("lang_pred", F.lit("clash")), model)
    assert kept.columns == [*odd_docs.columns, "lang_pred"]
    assert langid.fit(odd_docs.limit(0)).langs == []
    nothing = langid.identify(odd_docs, langid.LanguageModel([], []), "p", "s")
    assert {(r.p, r.s) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.identify(odd_docs.limit(0), model, "p", "s").collect() == []
