"""Byte-pair encoding through a minimal acyclic transducer of frequent words, and decoding.

Words are counted over all texts.  The frequent ones are compiled into one automaton in which words share
their prefixes and their suffixes: every transition carries the number of words it passes over, so the
numbers along a word's path add up to the word's place, and that place names its ids.  The automaton is a
file of flat arrays in the shared folder; Spark hands it to every executor, whose workers memory-map
the one copy.  The distinct words of a batch walk it together, one letter at a time; words that it does not hold are
merged by the tokenizer's own rules, so ids never depend on what the automaton holds.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch_folder, written
from .tokens import _BYTE_LETTERS, Encoder, distinct_pieces, encoder, text_slices

#: Most words in the automaton, the longest one's bytes and the least occurrences of any.
LEXICON_WORDS = 1 << 18
WORD_BYTES = 64
MIN_COUNT = 2
#: Counts fall into this many classes per doubling; whole classes are taken, the most frequent first.
_CLASSES = 16
_HEADER = 4
#: Tokens that are decoded at a time (or one longer list).
_DECODED = 1 << 18


def compile_words(words: list[bytes], ids: list[bytes]) -> bytes:
    """File image of the automaton of sorted, distinct ``words`` with their ids (little-endian unsigned 32-bit).

    States are registered from the last letter back, so a state's number is above its targets' numbers and
    equal suffixes end in the same states.
    """
    register: dict[tuple, int] = {}
    path: list[tuple[list, list]] = [([False], [])]  # states along the last word, not registered yet

    def close(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            number = register.setdefault((final[0], *edges), len(register))
            path[-1][1].append((word[len(path) - 1], number))

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        close(shared, last)
        path.extend(([False], []) for _ in word[shared:])
        path[-1][0][0] = True
        last = word
    close(0, last)
    register.setdefault((path[0][0][0], *path[0][1]), len(register))

    below = np.zeros(len(register), dtype=np.int64)
    final = np.zeros(len(register), dtype=np.uint8)
    keys, targets, passed = [], [], []
    for state, (ends, *edges) in enumerate(register):
        before = final[state] = int(ends)
        for letter, target in edges:
            keys.append(state << 8 | letter)
            targets.append(target)
            passed.append(before)
            before += int(below[target])
        below[state] = before
    bounds = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids], dtype=np.int64)])
    parts = [np.array([len(register), len(keys), len(words), bounds[-1]], dtype=np.int64), np.array(keys, dtype=np.int64),
             np.array(targets, dtype=np.int32), np.array(passed, dtype=np.int32), final, bounds.astype(np.int64),
             np.frombuffer(b"".join(ids), dtype="<u4")]
    return b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """The memory-mapped automaton of :func:`compile_words`."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, dtype=np.uint8, mode="r")
        states, edges, words, n_ids = np.frombuffer(self.raw[:8 * _HEADER], dtype=np.int64).tolist()
        at, views = 8 * _HEADER, []
        for n, kind in ((edges, "<i8"), (edges, "<i4"), (edges, "<i4"), (states, "u1"), (words + 1, "<i8"), (n_ids, "<u4")):
            size = n * np.dtype(kind).itemsize
            views.append(self.raw[at:at + size].view(kind))
            at += size + -size % 8
        self.keys, self.targets, self.passed, self.final, self.bounds, self.ids = views
        self.root = states - 1

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Place of each word ``data[start:start + size]`` among the words, or -1."""
        out = np.full(len(starts), -1, dtype=np.int64)
        state = np.full(len(starts), self.root, dtype=np.int64)
        place = np.zeros(len(starts), dtype=np.int64)
        live = np.flatnonzero(sizes <= WORD_BYTES)
        for depth in range(WORD_BYTES + 1):
            ended = sizes[live] == depth
            done, live = live[ended], live[~ended]
            done = done[self.final[state[done]] == 1]
            out[done] = place[done]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | data[starts[live] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            live, edge = live[found], edge[found]
            state[live] = self.targets[edge]
            place[live] += self.passed[edge]
        return out


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large string or binary array."""
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    body = array.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data


def _gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``table[start:start + size]`` of every pair, one after another."""
    ends = np.cumsum(sizes)
    return table[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _cut(enc: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text offsets, piece starts, each piece's place among the distinct ones, distinct pieces)."""
    offsets, data = _buffers(pa.concat_arrays([texts.fill_null("").cast(pa.large_binary())]))
    starts, _ = enc.piece_starts(data, offsets)
    return (offsets, starts, *distinct_pieces(data, starts))


def encode_texts(enc: Encoder, lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; a null text has none."""
    offsets, starts, which, distinct = _cut(enc, texts)
    begin, data = _buffers(distinct)
    place = lexicon.find(data, begin[:-1], np.diff(begin))
    known = place >= 0
    merged = [enc.known[p] if len(p) <= WORD_BYTES else enc.encode(p.decode()) for p in distinct.filter(pa.array(~known)).to_pylist()]
    first, size = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    first[known], size[known] = lexicon.bounds[place[known]], np.diff(lexicon.bounds)[place[known]]
    size[~known] = [len(m) >> 2 for m in merged]
    table = np.empty(size.sum(), dtype="<u4")
    own = np.repeat(known, size)
    table[own] = _gather(lexicon.ids, first[known], size[known])
    table[~own] = np.frombuffer(b"".join(merged), dtype="<u4")
    before = np.concatenate([[0], np.cumsum(size[which])])
    return _gather(table, (np.cumsum(size) - size)[which], size[which]), before[np.searchsorted(starts, offsets)]


def word_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often every word of at most ``WORD_BYTES`` bytes occurs, ``MIN_COUNT`` times at least."""
    def count(batches):
        with encoder(tokenizer_path, True) as enc:
            for batch in batches:
                for part in text_slices(batch, 0):
                    _, _, which, distinct = _cut(enc, part.column(0))
                    n = np.bincount(which, minlength=len(distinct))
                    short = np.diff(_buffers(distinct)[0]) <= WORD_BYTES
                    yield pa.RecordBatch.from_arrays(
                        [distinct.filter(pa.array(short)).cast(pa.binary()), pa.array(n[short])], ["word", "n"])

    rows = map_arrow(docs.select(F.col(text_col).alias("text")), count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The words of the highest count classes that together hold ``most`` words at most."""
    counts = counts.withColumn("class", F.floor(F.log2("n") * _CLASSES))
    room, least = most, None
    for row in sorted(counts.groupBy("class").count().collect(), reverse=True):  # 64 * _CLASSES rows at most
        if row["count"] > room:
            break
        room, least = room - row["count"], row["class"]
    return counts.where(F.col("class") >= least if least is not None else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the frequent words of ``docs``; returns the name under which executors find the file.

    Executors add the words' ids; what reaches the driver is at most ``most`` words of ``WORD_BYTES`` bytes.
    """
    spark = docs.sparkSession

    def add_ids(batches):
        with encoder(tokenizer_path, True) as enc:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([enc.encode(w.decode()) for w in batch.column(0).to_pylist()], pa.binary())],
                    ["word", "ids"])

    counts = written(word_counts(docs, tokenizer_path, text_col), "word-counts")
    found = map_arrow(frequent_words(counts, most), add_ids, "word binary, ids binary").toArrow().sort_by("word")
    image = compile_words(found["word"].to_pylist(), found["ids"].to_pylist())
    name = f"lexicon-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(put_file(spark, f"{scratch_folder(spark, 'lexicon')}/{name}", image))
    return name


def put_file(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one file through Spark's file systems; returns its full address."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(place)
    out.write(data)
    out.close()
    return fs.makeQualified(place).toString()


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the tokenizers library gives without special tokens added.

    A null or empty text has an empty list; null and repeated ids and repeated rows are kept as they are;
    other columns are ignored, whatever their names; an empty table gives no rows.  The strings of
    special tokens in a text become those tokens, as in the library.
    """
    def run(batches):
        words = Lexicon(SparkFiles.get(lexicon))
        with encoder(tokenizer_path, True) as enc:
            for batch in batches:
                for part in text_slices(batch, 1):
                    ids, bounds = encode_texts(enc, words, part.column(1))
                    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, ids array<int>")


def token_bytes(tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of every id of a byte-level vocabulary; ids without a token have no bytes."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {letter: bytes([b]) for b, letter in _BYTE_LETTERS.items()}
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    raw = [b""] * (max(tokens) + 1)
    for i, token in tokens.items():
        raw[i] = b"".join([byte_of[c] for c in token]) if byte_of.keys() >= set(token) else token.encode()
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), dtype=np.uint8)


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, text): the text of every list of ids, special tokens included, as the library decodes.

    Ids outside the vocabulary are left out; bytes that are no UTF-8 become U+FFFD; a null list gives an empty text.
    """
    def run(batches):
        bounds, raw = token_bytes(tokenizer_path)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(counts[at:at + 5000]), _DECODED, side="right")))
                part = batch.slice(at, n)
                ids = pc.fill_null(part.column(1).flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = (ids >= 0) & (ids < len(bounds) - 1)
                ids[~known] = 0
                size = np.where(known, np.diff(bounds)[ids], 0)
                data = _gather(raw, bounds[ids], size).tobytes()
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts[at:at + n])])].tolist()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                at += n

    return map_arrow(tokens.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")
