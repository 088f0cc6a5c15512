"""Language identification by known words, backing off to character n-grams.

A known word adds its log frequency in every language; an unseen word is covered from left to right by
the longest known character n-grams (word borders are characters too), falling back to shorter ones
position by position, and each n-gram adds its log frequency among n-grams of its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, map_arrow, reserve

#: Labelled rows per language that the model is fitted on at most (about: rows are chosen by hash).
ROWS_PER_LANG = 2000
MAX_GRAM = 5
MIN_COUNT = 2
UNKNOWN = "und"
_SMOOTH = 0.5
_CACHE = 100_000
_CHUNK = 50_000
_HELD_COUNTS = 100_000
_WORDS = re.compile(r"[^\W\d_]+")


def fit(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG, text_col: str = "text",
        lang_col: str = "lang") -> "LanguageModel":
    """Word and n-gram counts of a bounded sample of the rows with a text and a language.

    About ``rows_per_lang`` rows of each language are taken by a hash of their text, so the sample is
    spread over the table and the same whenever it is drawn; counts are aggregated by Spark and
    only counts of ``MIN_COUNT`` and more reach the driver.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [])
    keep = F.lit(False)
    u = F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (u < min(1.0, rows_per_lang / n)))

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                for word, times in Counter(_WORDS.findall(text.as_py().lower())).items():
                    counts[lang, 0, word] += times
                    edged = f"^{word}$"
                    for n in range(1, MAX_GRAM + 1):
                        for i in range(len(edged) - n + 1):
                            counts[lang, n, edged[i:i + n]] += times
                if len(counts) > _HELD_COUNTS:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    counted = map_arrow(rows.where(keep), count, "lang string, n int, gram string, c long")
    totals = counted.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).where(F.col("c") >= MIN_COUNT)
    found = totals.toArrow()  # columns, not row objects: the driver holds each value once
    return LanguageModel(sorted(sizes), zip(*(found[c].to_pylist() for c in ("lang", "n", "gram", "c"))))


def _counted(counts: Counter) -> pa.RecordBatch:
    langs, sizes, grams = zip(*counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string()),
         pa.array(list(counts.values()), pa.int64())], ["lang", "n", "gram", "c"])


class LanguageModel:
    def __init__(self, langs: list[str], counts: Iterable[tuple[str, int, str, int]]):
        self.langs = langs
        self.rows: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        place = {lang: i for i, lang in enumerate(langs)}
        tables: list[list[np.ndarray]] = [[] for _ in self.rows]
        for lang, n, gram, c in counts:
            at = self.rows[n].setdefault(gram, len(self.rows[n]))
            if at == len(tables[n]):
                tables[n].append(np.zeros(len(langs)))
            tables[n][at][place[lang]] += c
        self.scores = []
        for table in tables:
            m = np.array(table).reshape(len(table), len(langs))
            self.scores.append(np.log((m + _SMOOTH) / (m.sum(axis=0) + _SMOOTH * (len(m) + 1))).astype(np.float32))

    def backoff(self, word: str) -> np.ndarray:
        """Score of a word that is not in the word table."""
        edged, at, total = f"^{word}$", 0, np.zeros(len(self.langs), dtype=np.float32)
        while at < len(edged):
            step = 1
            for n in range(min(MAX_GRAM, len(edged) - at), 0, -1):
                row = self.rows[n].get(edged[at:at + n])
                if row is not None:
                    total += self.scores[n][row]
                    step = n
                    break
            at += step
        return total


class Scorer(dict):
    """Word -> row of ``matrix``; unseen words are scored once and remembered up to a bound."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.rows[0])
        self.model, self.known = model, len(model.rows[0])
        self.matrix = np.zeros((self.known + _CACHE, len(model.langs)), dtype=np.float32)
        self.matrix[:self.known] = model.scores[0]
        self.used = self.known

    def __missing__(self, word: str) -> int:
        at = self.used
        self.matrix[at] = self.model.backoff(word)
        self.used += 1
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORDS.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.langs))
        for i in range(0, len(words), _CHUNK):
            part = words[i:i + _CHUNK]
            if self.used + len(part) > len(self.matrix):
                self.clear()
                self.update(self.model.rows[0])
                self.used = self.known
            rows = np.fromiter(map(self.__getitem__, part), dtype=np.int32, count=len(part))
            total += self.matrix[rows].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        # the likelihood ratio of an average word, to the power of at most eight words
        gaps = np.exp((total - total[best]) / len(words) * min(8, len(words)))
        return self.model.langs[best], float(1 / gaps.sum())


def identify(docs: DataFrame, model: LanguageModel, pred_col: str, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) as columns of the given names.

    ``und`` with score 0: null, empty or letterless texts, and every text if nothing was learned.  Ties go
    to the alphabetically first language.  Each row is judged by its own whole text.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [scorer.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([p for p, _ in found], pa.string()),
                     pa.array([s for _, s in found], pa.float64())], [*part.schema.names, pred_col, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, predict, f"{fields}, `{pred_col}` string, `{score_col}` double")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that training never sees; a null id is a training id."""
    return F.coalesce(id_remainder(doc_id, 4) == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose language is known with ``min_score`` at least."""
    pred, score = reserve(docs, "lang_pred"), reserve(docs, "lang_score")
    found = identify(docs, model, pred, score, text_col)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
