"""Quality rules as a short-circuit cascade of column expressions.

Measures and rules are DataFrame expressions only.  The cost of every rule (time on a sample) and its
selectivity (share of the sample that it rejects) order the rules by rejections per cost; the cascade
is one CASE expression, so a row pays for a rule only if all earlier ones let it pass.
The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reserve, written

#: Rows of the sample on which costs and selectivities are estimated (about: chosen by hash).
SAMPLE_ROWS = 2000
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_NO_BLANKS = "[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]"
#: Evaluations of a rule per sample row, so that its cost stands out from that of starting a job.
_REPEATS = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(text, _BLANKS, "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more (the first one included).

    Windows are compared by 64-bit hashes: sorted with their places, repeated ones are neighbours; the
    words they cover are counted from the sorted places.  n log n in the number of words.
    """
    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width),
                             lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes, repeated))

    def repeated(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered_by))

    def covered_by(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        places = F.transform(F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"])
        return let(F.sort_array(places), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(tokens, count).cast("long")


def with_measures(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with the measures ``names`` maps: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words -> column name.  A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = reserve(docs, "__words")
    split = docs.withColumn(w, words(text))
    return split.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.size(w).cast("long").alias(names["n_words"]),
        word_chars(text).alias(names["word_chars"]), symbols(text).alias(names["n_symbols"]),
        duplicate_lines(text).alias(names["n_dup_lines"]), repeated_words(F.col(w)).alias(names["n_repeat_words"]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_rules(n: dict[str, str]) -> list[Rule]:
    return [Rule("few_words", F.col(n["n_words"]) < 50),
            Rule("repetition", 100 * F.col(n["n_repeat_words"]) > 50 * F.col(n["n_words"]))]


def more_rules(text: Column, n: dict[str, str]) -> list[Rule]:
    """Loose limits that ordinary prose of any language passes: vowel signs count as letters, and words are not
    measured in texts of scripts that put no blanks between them."""
    n_words, chars = F.col(n["n_words"]), F.col(n["word_chars"])
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    upper = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    share = lambda pattern, percent: let(lines(text), lambda x: 100 * F.size(
        F.filter(x, lambda y: y.rlike(pattern))) > percent * F.size(x))
    return [Rule("word_length", ((chars < 2 * n_words) | (chars > 15 * n_words)) & ~text.rlike(_NO_BLANKS)),
            Rule("symbols", 10 * F.col(n["n_symbols"]) > n_words),
            Rule("duplicate_lines", let(F.size(lines(text)), lambda k: 100 * F.col(n["n_dup_lines"]) > 60 * k)),
            Rule("few_letters", 100 * letters < 60 * chars),
            Rule("shouting", 100 * upper > 60 * letters),
            Rule("bullets", share(r"^\s*[-*•]", 90)),
            Rule("ellipses", share(r"(\.\.\.|…)\s*$", 30))]


@dataclass(frozen=True)
class Estimate:
    rule: str
    cost: float
    rejected: float


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Seconds (above those of a bare scan) and rejected share of every rule on ``sample``; seconds are the least
    of two runs over every row ``_REPEATS`` times."""
    again = sample.withColumn(reserve(sample, "again"), F.explode(F.sequence(F.lit(1), F.lit(_REPEATS))))

    def seconds(value: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            again.agg(F.sum(value)).first()
            best = min(best, time.perf_counter() - began)
        return best

    hits = [F.avg(F.coalesce(r.rejects, F.lit(False)).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]
    shares = sample.agg(*hits).first()
    scan = seconds(F.lit(1))
    return [Estimate(r.name, max(1e-3, seconds(F.coalesce(r.rejects, F.lit(False)).cast("int")) - scan),
                     float(shares[i] or 0.0)) for i, r in enumerate(rules)]


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Most rejections per cost first; ties by lower cost, then by name."""
    rank = {e.rule: (-e.rejected / e.cost, e.cost, e.rule) for e in estimates}
    return sorted(rules, key=lambda r: rank[r.name])


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, null if none does; a rule that gives null passes."""
    chain = F.when(rules[0].rejects, F.lit(rules[0].name))
    for r in rules[1:]:
        chain = chain.when(r.rejects, F.lit(r.name))
    return chain


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, the five measures, base_failed, rejected_by (a rule of the cascade) and kept.

    The base rules come first by definition; the others follow in the order of the sample's rejections per
    cost.  Null texts are empty (rejected: no words); repeated rows are each judged; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    names = {m: m for m in MEASURES}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base, more = base_rules(names), more_rules(text, names)
    measured = with_measures(rows, "text", names)
    n = rows.count()
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    sample = written(with_measures(rows.where(u < min(1.0, sample_rows / max(1, n))), "text", names), "quality-sample")
    cascade = ordered(more, estimate(sample, more))
    failed = base[0].rejects | base[1].rejects
    judged = measured.withColumn("base_failed", failed).withColumn(
        "rejected_by", F.coalesce(first_rejection(base), F.when(~F.col("base_failed"), first_rejection(cascade))))
    return judged.select("doc_id", *MEASURES, "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"))
