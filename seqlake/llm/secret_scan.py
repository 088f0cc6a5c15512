"""Secret scans with DataFrame expressions only: fixed patterns and a randomness test battery.

Patterns give the base spans.  For the rest, every run of token characters is a candidate: its encoding is
inferred, and under the hypothesis that it is uniformly random over that encoding's alphabet it is tested
for symbol uniformity (chi-squared), for the shares of digits, lower and upper case and signs (chi-squared),
for runs above and below the alphabet's middle, and for lag-one serial correlation.  The tests' smallest
p-value, corrected for their number, is the candidate's p-value.  Benjamini-Hochberg, run in each
length class by itself because short runs have little power, rejects randomness at a false-discovery rate
``q`` (the share of random strings among those taken for ordinary text); what is not rejected, and long
enough to have power, is a secret.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reserve
from .quality import let

# Fixed patterns: kind, pattern, group whose length counts, least length.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
KINDS = [kind for kind, *_ in PATTERNS] + ["random"]

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the smallest alphabet on; a run belongs to the first that has all its characters.
ENCODINGS = [
    ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Candidates are runs of at least MIN_LENGTH token characters that can carry MIN_BITS bits: a key of 16 letters and
#: digits (95.3 bits) is one, a word of 16 lower-case letters (82.7) is not.  Lower bounds are a parameter.
MIN_LENGTH = 16
MIN_BITS = 95.0
LENGTH_CLASSES = [16, 20, 24, 32, 48, 64, 128]
FDR = 0.10
_CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH
_PARTS = [r"[^+/]{%d,}" % MIN_LENGTH, r"[^_-]{%d,}" % MIN_LENGTH]
_BINS_PER_DECADE, _MAX_BIN = 32, 1600


def prefix_fold(items: Column, start: Column, step: Callable[[Column, Column], Column],
                value: Callable[[Column, Column], Column], empty: Column, chunk: int = 256) -> Column:
    """Array of ``value(state, item)`` while ``state`` runs through ``step``; built chunk by chunk, since
    appending to one long array would copy it for every item."""
    def inner(state: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("state"), empty.alias("out")), lambda a, x: F.struct(
            step(a["state"], x).alias("state"), F.concat(a["out"], F.array(value(a["state"], x))).alias("out")))

    def outer(a: Column, first: Column) -> Column:
        return let(inner(a["state"], F.slice(items, first, chunk)), lambda r: F.struct(
            r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(start.alias("state"), F.slice(F.array(empty), 1, 0).alias("out"))
    chunks = F.sequence(F.lit(1), F.size(items), F.lit(chunk))
    return F.when(F.size(items) == 0, empty).otherwise(F.flatten(F.aggregate(chunks, zero, outer)["out"]))


_SPAN = "array<struct<start:int,end:int,rank:int,text:string>>"


def matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, rank, text) in code points, end exclusive;
    matches whose ``group`` is shorter than ``least`` are dropped after matching."""
    empty = F.array().cast(_SPAN)
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        items = F.arrays_zip(found.alias("m"), gaps.alias("g"), sized.alias("k"))
        # there is one gap more than there are matches; the last zipped item has no match
        return let(F.filter(items, lambda x: x["m"].isNotNull()), lambda rows: F.filter(prefix_fold(
            rows, F.lit(0), lambda s, x: s + F.char_length(x["g"]) + F.char_length(x["m"]),
            lambda s, x: let(s + F.char_length(x["g"]), lambda b: F.struct(
                b.alias("start"), (b + F.char_length(x["m"])).alias("end"), F.lit(rank).alias("rank"),
                F.when(F.char_length(x["k"]) >= least, x["m"]).alias("text"))),
            empty), lambda x: x["text"].isNotNull()))

    return let(wanted, lambda found: F.when(F.size(found) == 0, empty).otherwise(located(found)))


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), relative error below 0.3 % (Borjesson and Sundberg 1979)."""
    def tail(x: Column) -> Column:
        return F.exp(-x * x / 2) / (2.5066282746 * (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)))

    return F.when(z >= 0, tail(z)).otherwise(1 - tail(-z))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def chi_squared_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution (Wilson and Hilferty)."""
    v = 2 / (9 * df)
    return upper_tail((F.cbrt(x / df) - (1 - v)) / F.sqrt(v))


def _of_encoding(code: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), code)


def battery(token: Column, min_bits: float = 0.0) -> Column:
    """Struct (code, bits, chi, classes, runs, serial, p) of a token of at least two characters; code is the
    number of its encoding from 1 on.  Null if no encoding fits or it carries less than ``min_bits`` bits."""
    fits = [("^[" + "".join(sorted(a)).replace("-", "\\-") + "]+$") for _, a in ENCODINGS]
    code = reduce(lambda rest, k: F.when(token.rlike(fits[k]), F.lit(k + 1)).otherwise(rest),
                  reversed(range(len(fits))), F.lit(None).cast("int"))
    low_high = ["0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for _, a in ENCODINGS]
    shares = {name: [sum(c in kind for c in a) / len(a) for _, a in ENCODINGS]
              for name, kind in (("digit", _DIGITS), ("lower", _LOWER), ("upper", _UPPER), ("sign", "+/-_"))}

    def tests(code: Column) -> Column:
        n = F.char_length(token).cast("double")
        alphabet = _of_encoding(code, [a for _, a in ENCODINGS])
        size = _of_encoding(code, [float(len(a)) for _, a in ENCODINGS])
        count = lambda chars: n - F.char_length(F.regexp_replace(token, chars, "")).cast("double")
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, c: s + let(
            n - F.char_length(F.replace(token, c, F.lit(""))), lambda k: k * k))
        chi = chi_squared_tail(size / n * squares - n, size - 1)
        parts, kinds = [], []
        for name, chars in (("digit", "[0-9]"), ("lower", "[a-z]"), ("upper", "[A-Z]"), ("sign", r"[+/_\-]")):
            share = _of_encoding(code, shares[name])
            parts.append(F.when(share > 0, F.pow(count(chars) - n * share, F.lit(2.0)) / (n * share)).otherwise(0.0))
            kinds.append(F.when(share > 0, 1.0).otherwise(0.0))
        classes = chi_squared_tail(reduce(lambda a, b: a + b, parts), reduce(lambda a, b: a + b, kinds) - 1)
        halves = [F.translate(token, a, z) for (_, a), z in zip(ENCODINGS, low_high)]
        half = F.element_at(F.array(*halves), code)
        runs = F.char_length(F.regexp_replace(half, r"(.)\1+", "$1"))
        z_runs = (runs - (1 + (n - 1) / 2)) / F.sqrt((n - 1) / 4)
        places = F.transform(F.split(token, ""), lambda c: F.position(c, alphabet) - 1 - (size - 1) / 2)
        serial = let(places, lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0),
                                                   lambda s, i: s + F.get(x, i - 1) * F.get(x, i)))
        z_serial = serial / ((size * size - 1) / 12 * F.sqrt(n - 1))
        row = F.struct(code.alias("code"), (n * F.log2(size)).alias("bits"), chi.alias("chi"), classes.alias("classes"),
                       two_sided(z_runs).alias("runs"), two_sided(z_serial).alias("serial"))
        tests_of = ("chi", "classes", "runs", "serial")
        return let(row, lambda r: F.struct(
            *[r[c].alias(c) for c in ("code", "bits", *tests_of)],
            F.least(F.lit(1.0), len(tests_of) * F.least(*[r[c] for c in tests_of])).alias("p")))

    bits = lambda c: F.char_length(token) * F.log2(_of_encoding(c, [float(len(a)) for _, a in ENCODINGS]))
    return let(code, lambda c: F.when(c.isNotNull() & (bits(c) >= min_bits), tests(c)))


def length_class(token: Column) -> Column:
    n = F.char_length(token)
    return reduce(lambda a, b: a + b, [F.when(n >= k, 1).otherwise(0) for k in LENGTH_CLASSES]) - 1


def p_bin(p: Column) -> Column:
    """Bin of a p-value: larger is smaller p; a bin's largest p is 10 ** (-bin / 32).  Null without a p-value."""
    found = F.least(F.lit(_MAX_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-60))) * _BINS_PER_DECADE)).cast("int")
    return F.when(p.isNotNull(), found)  # greatest and least skip nulls


def candidates(text: Column) -> Column:
    """Runs of token characters of MIN_LENGTH and more as structs (start, end, rank, text)."""
    return matches(text, _CANDIDATE, KINDS.index("random"))


def parts(runs: Column) -> Column:
    """The runs; one that mixes the signs of base64 and base64url, so that no encoding has all its characters, is
    replaced by its parts of MIN_LENGTH and more between + and /, and those between - and _.  Both are
    needed, since a key may hold the rarer signs itself; parts of the two kinds may overlap."""
    def cut(x: Column) -> Column:
        found = F.concat(*[matches(x["text"], p, KINDS.index("random")) for p in _PARTS])
        return F.transform(found, lambda m: F.struct((m["start"] + x["start"]).alias("start"), (m["end"] + x["start"]).alias("end"),
                                                     m["rank"].alias("rank"), m["text"].alias("text")))

    return F.flatten(F.transform(runs, lambda x: F.when(
        x["text"].rlike("[+/]") & x["text"].rlike("[_-]"), cut(x)).otherwise(F.array(x))))


def tested(runs: Column, min_bits: float = MIN_BITS) -> Column:
    """Runs that fit an encoding and carry ``min_bits`` bits, as structs (start, end, rank, class, bin)."""
    rows = F.transform(runs, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"),
        length_class(x["text"]).alias("class"), p_bin(battery(x["text"], min_bits)["p"]).alias("bin")))
    return F.filter(rows, lambda r: r["bin"].isNotNull())


def apart_from(runs: Column, spans: Column) -> Column:
    """What ``spans`` leave of the runs: pieces of MIN_LENGTH and more, in the same form."""
    def gaps(x: Column, inside: Column) -> Column:
        ends = F.concat(F.sort_array(F.transform(inside, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))),
                        F.array(F.struct(x["end"].alias("start"), x["end"].alias("end"))))
        found = prefix_fold(ends, x["start"], lambda at, b: F.greatest(at, b["end"]), lambda at, b: F.struct(
            at.alias("start"), b["start"].alias("end"), x["rank"].alias("rank"),
            F.substring(x["text"], at - x["start"] + 1, b["start"] - at).alias("text")), F.array().cast(_SPAN))
        return F.filter(found, lambda g: g["end"] - g["start"] >= MIN_LENGTH)

    def left(x: Column, spans: Column) -> Column:
        inside = F.filter(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return let(inside, lambda s: F.when(F.size(s) == 0, F.array(x)).otherwise(gaps(x, s)))

    return let(spans, lambda s: F.flatten(F.transform(runs, lambda x: left(x, s))))


def hypotheses(text: Column, base: Column, min_bits: float = MIN_BITS) -> Column:
    """What the battery tests in ``text``: the runs of token characters apart from the base spans."""
    return tested(parts(apart_from(candidates(text), base)), min_bits)


def thresholds(runs: DataFrame, q: float) -> dict[int, int]:
    """Benjamini-Hochberg per length class over all candidates: class -> least bin that is rejected.

    The p-values of all documents are counted in a fixed number of bins, and a bin's largest p-value stands for
    all of it, so no p-value has to be sorted or gathered and the rate is kept.
    """
    counts = runs.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for k in {r["class"] for r in counts}:
        bins = sorted(((r["bin"], r["n"]) for r in counts if r["class"] == k), reverse=True)
        total, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if 10 ** (-b / _BINS_PER_DECADE) <= q * seen / total:
                out[k] = b
    return out


def base_spans(text: Column) -> Column:
    return F.flatten(F.array(*[matches(text, pattern, rank, group, least)
                               for rank, (_, pattern, group, least) in enumerate(PATTERNS)]))


def with_spans(docs: DataFrame, text_col: str, base_col: str, all_col: str, q: float = FDR,
               min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with the base spans and all spans: arrays of structs (start, end, rank), sorted, where rank
    counts the kinds assign, access, hex and random; offsets are code points, end exclusive.

    Null and empty texts have no spans; every row is scanned in full by itself, so ids may be null or repeat;
    the thresholds of the battery come from all rows; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, more = reserve(docs, base_col + "__"), reserve(docs, all_col + "__")
    least = thresholds(docs.select(F.explode(hypotheses(text, base_spans(text), min_bits)).alias("c")).select("c.class", "c.bin"), q)
    rows = docs.withColumn(base, base_spans(text))
    rows = rows.withColumn(more, hypotheses(text, F.col(base), min_bits))
    def random(r: Column) -> Column:
        limit = reduce(lambda rest, kv: F.when(r["class"] == kv[0], kv[1]).otherwise(rest), least.items(),
                       F.lit(_MAX_BIN + 1))
        return r["bin"] < limit

    plain = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))
    kept = F.transform(F.col(base), plain)
    found = F.transform(F.filter(F.col(more), random), plain)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.sort_array(kept).alias(base_col),
                       F.sort_array(F.concat(kept, found)).alias(all_col))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal stretch of overlapping or touching spans replaced by ``mark``."""
    def cut(end: Column, x: Column) -> Column:
        gap = F.when(x["start"] > end, F.concat(F.substring(text, end + 1, x["start"] - end), F.lit(mark)))
        return F.coalesce(gap, F.when((end == 0) & (x["start"] == 0), F.lit(mark)).otherwise(F.lit("")))

    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    pieces = prefix_fold(spans, F.lit(0), lambda s, x: F.greatest(s, x["end"]), cut, F.array().cast("array<string>"))
    rest = F.substring(text, last + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FDR, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, text, base, spans) of every document; other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows, "text", "base", "spans", q, min_bits)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", q: float = FDR) -> DataFrame:
    """``docs``, rows and columns unchanged, with every secret in ``text_col`` replaced by a mark; a number
    of characters in ``chars_col``, if there is such a column, changes by as much as the text."""
    base, spans, old = (reserve(docs, c) for c in ("__base", "__spans", "__text"))
    found = with_spans(docs, text_col, base, spans, q).withColumn(old, F.col(text_col))
    out = found.withColumn(text_col, redacted(F.col(old), F.col(spans)))
    kinds = dict(docs.dtypes)
    if kinds.get(chars_col) in ("int", "bigint"):
        shorter = F.char_length(F.col(text_col)) - F.char_length(F.col(old))
        out = out.withColumn(chars_col, (F.col(chars_col) + F.coalesce(shorter, F.lit(0))).cast(kinds[chars_col]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
