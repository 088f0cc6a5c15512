"""Benchmark decontamination with a broadcast hash set of test n-grams.

Test items become windows of ``n`` consecutive normalised words (an item of fewer words is one
window).  Their 64-bit hashes are broadcast as sorted arrays; every document's words are hashed in
numpy straight from the Arrow buffer, rolling window hashes are looked up, and each hit is verified
word by word.  Test sets larger than ``block_words`` words are scanned in blocks, each broadcast
within that bound and scanned in a pass of its own, whose hits add up in the documents' own rows: a task
never holds more than one block's index.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, reserve, written
from .tokens import text_slices

#: Words: letters and digits of ASCII and everything beyond it, A-Z in lower case.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Most test words that are broadcast at once; their windows take about 100 bytes each.
BLOCK_WORDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 16


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64))


def word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word in a buffer of UTF-8 bytes; ``firsts`` are the offsets at which
    texts begin (a word never runs from one text into the next)."""
    low = _LOWER[data]
    inside = _IS_WORD[low]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = firsts[firsts < len(data)]
    opens[firsts] = inside[firsts]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    closes = np.zeros(len(data) + 1, dtype=bool)
    closes[1:] = inside
    closes[1:-1] &= ~inside[1:] | opens[1:]
    ends = np.flatnonzero(closes)
    where = np.flatnonzero(inside)
    begin = np.searchsorted(where, starts)
    place = np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where))))
    codes = low[where].astype(np.uint64) + np.uint64(1)
    codes *= _powers(int(place.max()) + 1)[place]
    return starts, ends, _mixed(np.add.reduceat(codes, begin))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (the last n - 1 positions have none)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j, factor in enumerate(_powers(n)):
        out += words[j:len(words) - n + 1 + j] * factor
    return _mixed(out)


class NgramIndex:
    """The windows of one block of test items: hashes by window length, and items by window."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.items: dict[bytes, set] = defaultdict(set)
        lengths: dict[int, set[bytes]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            size = min(n, len(words))
            for i in range(len(words) - size + 1) if words else ():
                window = b" ".join(words[i:i + size])
                self.items[window].add(item)
                lengths[size].add(window)
        self.hashes = []
        for size, windows in sorted(lengths.items()):
            text = np.frombuffer(b"\n".join(sorted(windows)), dtype=np.uint8)
            _, _, words = word_hashes(text, np.zeros(1, dtype=np.int64))
            known = np.unique(window_hashes(words, size)[::size])
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[known >> np.uint64(64 - _TABLE_BITS)] = True
            self.hashes.append((size, known, table))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, doc: np.ndarray):
        """Verified hits as (first word, size, window); ``doc`` is each word's text number."""
        for size, known, table in self.hashes:
            h = window_hashes(words, size)
            at = np.flatnonzero(table[h >> np.uint64(64 - _TABLE_BITS)])
            at = at[doc[at] == doc[at + size - 1]]
            spot = np.searchsorted(known, h[at])
            at = at[known[np.minimum(spot, len(known) - 1)] == h[at]]
            for i in at.tolist():
                text = data[starts[i]:ends[i + size - 1]].tobytes().lower()
                window = b" ".join(WORDS.findall(text))
                if window in self.items:
                    yield i, size, window


def item_blocks(benchmark: DataFrame, block_words: int, item_col: str, text_col: str):
    """The test set in blocks of at most ``block_words`` words (or one item), read one block at a time.

    Items are dealt to as many hash buckets as their total size needs, so no block is unbounded.
    """
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    # a word has at least one byte and a separator
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_blocks = max(1, -(-size // (2 * block_words)))
    for k in range(n_blocks):
        part = rows if n_blocks == 1 else rows.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        held, held_words = [], 0
        for r in part.toLocalIterator():
            n = len(r.text.encode()) // 2 + 1
            if held and held_words + n > block_words:
                yield held
                held, held_words = [], 0
            held.append((r.item_id, r.text))
            held_words += n
        if held:
            yield held


HIT_TYPES = {"n_words": "bigint", "hit_words": "array<int>", "hit_spans": "array<struct<first:int,last:int>>",
             "items": "array<bigint>"}


def scan(docs: DataFrame, benchmark: DataFrame, names: dict[str, str], n: int = 10, block_words: int = BLOCK_WORDS,
         text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with four columns named by ``names``: n_words, hit_words (ascending numbers of hit words),
    hit_spans (first and last byte of every maximal run of hit words) and items (ids with occurring windows).

    Null texts have no words; test items of null or wordless text have no windows; items with a null id
    count as hits but are not listed; repeated documents are each reported; other columns of the test
    set are ignored; an empty table gives no rows or no hits.
    """
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[
        (F.lit(0) if c == "n_words" else F.array()).cast(t).alias(names[c]) for c, t in HIT_TYPES.items()])
    fields = [(f.name, f.dataType.simpleString()) for f in found.schema.fields]
    schema = ", ".join(f"`{c}` {t}" for c, t in fields)
    text, width = docs.columns.index(text_col), len(docs.columns)
    blocks = item_blocks(benchmark, block_words, item_col, item_text_col)
    items = next(blocks, [])
    while True:
        found = map_arrow(found, _scanner(docs.sparkSession, items, n, text, width), schema)
        items = next(blocks, None)
        if items is None:
            return found
        found = written(found, "decontam-block")  # one pass and one index in a task at a time


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS,
              id_col: str = "doc_id", text_col: str = "text", **of_items) -> DataFrame:
    """(doc_id, text, n_words, hit_words, hit_spans, items) per document, as :func:`scan` finds them; other
    columns of ``docs`` are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scan(rows, benchmark, {c: c for c in HIT_TYPES}, n, block_words, **of_items)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, without a hit."""
    names = {c: reserve(docs, f"__{c}") for c in HIT_TYPES}
    found = scan(docs, benchmark, names, n, **options)
    return found.where(F.size(names["hit_words"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _scanner(spark, items: list, n: int, text: int, width: int):
    """Scan for one block of test items; earlier blocks' hits are in the columns from ``width`` on."""
    index = spark.sparkContext.broadcast(NgramIndex(items, n))

    def scan(batches):
        for batch in batches:
            for part in text_slices(batch, text, 500):
                yield _scan(index.value, part, text, width)
    return scan


def _scan(index: NgramIndex, batch: pa.RecordBatch, text: int, width: int) -> pa.RecordBatch:
    texts = pa.concat_arrays([batch.column(text).fill_null("").cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    starts, ends, words = word_hashes(data, offsets[:-1])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    hits, items = defaultdict(set), defaultdict(set)
    for i, size, window in index.find(data, starts, ends, words, doc):
        hits[int(doc[i])].update(range(i, i + size))
        items[int(doc[i])] |= index.items[window]
    hit_words, spans, found = [], [], []
    for d, (old, old_items) in enumerate(zip(batch.column(width + 1), batch.column(width + 3))):
        first, base = int(bounds[d]), int(offsets[d])
        numbers = sorted({w - first for w in hits[d]} | set(old.as_py())) if d in hits or len(old) else []
        runs: list[list[int]] = []
        for w in numbers:
            if runs and runs[-1][1] == w - 1:
                runs[-1][1] = w
            else:
                runs.append([w, w])
        hit_words.append(numbers)
        spans.append([{"first": int(starts[first + a]) - base, "last": int(ends[first + b]) - base} for a, b in runs])
        ids = items[d] | set(old_items.as_py()) if d in items or len(old_items) else set()
        found.append(sorted(x for x in ids if x is not None))
    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:width], pa.array(np.diff(bounds).astype(np.int64)), pa.array(hit_words, pa.list_(pa.int32())),
         pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(pa.int64()))], batch.schema.names)


def remove_spans(hits: DataFrame) -> DataFrame:
    """``hits`` with ``clean_text``: the text without the bytes of hit spans (null stays null)."""
    def cut(batches):
        for batch in batches:
            clean = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                data, at, out = (text or "").encode(), 0, []
                for s in spans:
                    out.append(data[at:s["first"]])
                    at = s["last"]
                clean.append(None if text is None else b"".join([*out, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.string())],
                                             [*batch.schema.names, "clean_text"])

    names = ["doc_id", "text", *HIT_TYPES]
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    return map_arrow(hits.select(names), cut, ", ".join(f"{c} {kinds[c]}" for c in names) + ", clean_text string")
