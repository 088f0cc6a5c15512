"""Hidden Markov language model.

Tokens are words and one end per text.  Every token belongs to a class: each of the most frequent words is a
class of its own, other words share classes by their ending, the end is the last class.  Latent states
emit classes, and P(token) = P(class | states) * P(word | class), the latter from counts of the whole
corpus.  Baum-Welch runs over all training texts: tasks sum expected counts, Spark adds them up by
(state, class), and the driver sees tables of a fixed size only; training ends when the likelihood has settled.  The likelihood of a text is exact:
a forward recursion over the whole text, scaled at every step.

The vocabulary grows with the corpus and is never broadcast.  A task numbers the words of a block of texts
once; the block's distinct words are joined with the corpus counts and come back to the block's
texts, so what is shuffled is words per block, not tokens.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, map_arrow, scratch_folder
from .tokens import text_slices

#: Model size: latent states, words with classes of their own, classes of word endings; most training passes.
STATES = 6
OWN_CLASSES = 4096
ENDING_CLASSES = 1024
PASSES = 5
#: Training ends before that when a pass raises the mean log10 likelihood of a token by less than this.
SETTLED = 5e-3
#: A block of texts ends after so many bytes (or one longer text); its distinct words are fewer than half as many.
BLOCK_BYTES = 16 << 20
#: Tokens that are run through the model side by side, and the segments in which longer texts are trained on.
_WAVE = 400_000
SEGMENT = 65_536
_SMOOTH = 0.1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


_BLOCK_SCHEMA = "blk long, word string, local int, n long, doc_id long, held_out boolean, ids binary"
_BLOCK_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK_SCHEMA.split(", ")]


def _block_rows(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (blk, word, local, n) with a word's training count in its block, and
    (blk, doc_id, held_out, ids) with a text's words as numbers of its block."""

    def number(batches):
        blk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, 2):
                held.append(part)
                size += part.column(2).nbytes + 64 * part.num_rows
                if size > BLOCK_BYTES:
                    yield from _block(blk, pa.Table.from_batches(held))
                    held, size, blk = [], 0, blk + 1
        if held:
            yield from _block(blk, pa.Table.from_batches(held))

    return map_arrow(docs, number, _BLOCK_SCHEMA)


def tokens_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, bounds): text i has words[bounds[i]:bounds[i + 1]]: what is between blanks, A-Z in lower case."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_BLANK[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    opens[firsts] = inside[firsts]
    starts = np.flatnonzero(opens)
    letters = _LOWER[data[inside]]
    bounds = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words, np.searchsorted(starts, offsets)


def _block(blk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The words and the texts of one block."""
    one = lambda i: pa.concat_arrays(rows.column(i).chunks)
    words, bounds = tokens_in(one(2))
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).cast(pa.string())
    held = one(1).to_numpy(zero_copy_only=False).astype(bool)
    trained = np.repeat(~held, np.diff(bounds))
    counts = np.bincount(ids[trained], minlength=len(known))
    for i in range(0, len(known), 100_000):
        part = known.slice(i, 100_000)
        m = len(part)
        yield _rows(m, {"blk": np.full(m, blk), "word": part, "local": np.arange(i, i + m, dtype=np.int32), "n": counts[i:i + m]})
    packed = [zlib.compress(ids[a:b].tobytes(), 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    yield _rows(len(held), {"blk": np.full(len(held), blk), "doc_id": one(0), "held_out": one(1), "ids": packed})


def _rows(rows: int, columns: dict) -> pa.RecordBatch:
    """A batch of the block schema; absent columns are null."""
    arrays = [(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(rows, t)
              for c, t in zip(_BLOCK_NAMES, _BLOCK_TYPES)]
    return pa.RecordBatch.from_arrays(arrays, _BLOCK_NAMES)


@dataclass
class Corpus:
    """Corpus counts of fixed size (class sizes) and numbers; the vocabulary itself stays a table."""

    train_tokens: int
    train_docs: int
    vocabulary: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def end_class(self) -> int:
        return len(self.class_tokens) - 1

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.train_tokens + 0.1 * (self.vocabulary + 1)))

    def within_class(self, c: np.ndarray, cls: np.ndarray, own: int) -> np.ndarray:
        """log10 P(word | class); a class of one frequent word gives it probability 1."""
        shared = np.log10((c + 0.1) / (self.class_tokens[cls] + 0.1 * (self.class_words[cls] + 1)))
        return np.where(cls < own, 0.0, shared)


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K
    fit: float = 0.0  # of expected counts: log10 likelihood of the sequences under the model that they come from


def initial_model(classes: int, states: int, seed: int = 1) -> Model:
    """A fixed pseudo-random start: states that last and emit differently, so that a few passes part them."""
    rng = np.random.default_rng(seed)
    start = np.full(states, 1 / states)
    move = rng.uniform(0.8, 1.2, (states, states)) + 100 * np.eye(states)
    emit = np.exp(1.5 * rng.standard_normal((classes, states)))
    return Model(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def updated(counts: Model) -> Model:
    """Maximum-likelihood step with a little smoothing: nothing gets probability 0."""
    start, move = counts.start + 1.0, counts.move + 1.0
    emit = counts.emit + _SMOOTH
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def waves(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, symbols): sequences of similar length side by side, longest first; symbols is
    (steps, sequences), and at step t the sequences that still run are the first ones."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        width = max(1, min(1024, _WAVE // max(1, longest)))
        places = order[at:at + width]
        symbols = np.zeros((longest, len(places)), dtype=np.int64)
        for j, p in enumerate(places):
            symbols[:lengths[p], j] = sequences[p]
        yield places, lengths[places], symbols
        at += width


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 P of each sequence of classes (at least one), by the forward recursion scaled at every step."""
    out = np.zeros(len(sequences))
    for places, lengths, symbols in waves(sequences):
        running = np.searchsorted(-lengths, -np.arange(len(symbols)), side="left")
        total = np.zeros(len(places))
        alpha = None
        for t, n in enumerate(running.tolist()):
            alpha = (model.start if alpha is None else alpha[:n] @ model.move) * model.emit[symbols[t, :n]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[places] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray]) -> Model:
    """Baum-Welch: expected numbers of starts, moves and emissions over the sequences."""
    k, classes = len(model.start), len(model.emit)
    counts = Model(np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)))
    for _, lengths, symbols in waves(sequences):
        running = np.searchsorted(-lengths, -np.arange(len(symbols)), side="left").tolist()
        alphas, scales = np.zeros((*symbols.shape, k)), np.ones(symbols.shape)
        for t, n in enumerate(running):
            alpha = (model.start if t == 0 else alphas[t - 1, :n] @ model.move) * model.emit[symbols[t, :n]]
            scales[t, :n] = alpha.sum(axis=1)
            np.divide(alpha, scales[t, :n, None], out=alphas[t, :n])
        counts.fit += float(np.log10(scales).sum())
        beta = np.ones((symbols.shape[1], k))
        moves = np.zeros((k, k))
        for t in range(len(symbols) - 1, 0, -1):
            n = running[t]
            ahead = beta[:n] * model.emit[symbols[t, :n]] / scales[t, :n, None]
            alphas[t, :n] *= beta[:n]  # now the posterior of the states at step t
            moves += alphas[t - 1, :n].T @ ahead
            beta[:n] = ahead @ model.move.T
        alphas[0] *= beta
        counts.start += alphas[0].sum(axis=0)
        counts.move += moves * model.move
        runs = np.arange(symbols.shape[1])[None, :] < np.array(running)[:, None]
        where = symbols[runs]
        for s in range(k):
            counts.emit[:, s] += np.bincount(where, weights=alphas[..., s][runs], minlength=classes)
    return counts


def _sequences(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x.as_py()), dtype="<u2") for x in batch.column(column)]


def _slices(batch: pa.RecordBatch, rows: int = 4000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def train(encoded: DataFrame, classes: int, states: int = STATES, passes: int = PASSES, settled: float = SETTLED,
          log: list[float] | None = None) -> Model:
    """Baum-Welch over all rows of ``encoded`` that are not held out (column ``symbols``), ``passes`` times at most
    or until the likelihood has ``settled``; ``log`` gets each pass's mean log10 likelihood of a token."""
    spark = encoded.sparkSession
    model, before = initial_model(classes, states), -math.inf
    texts = encoded.where(~F.col("held_out")).select("symbols")
    end = 1 + states + classes
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def count(batches, shared=shared):
            model, total = shared.value, None
            for batch in batches:
                for part in _slices(batch):
                    pieces = [s[i:i + SEGMENT] for s in _sequences(part, 0) for i in range(0, len(s), SEGMENT)]
                    found = expected_counts(model, pieces)
                    total = found if total is None else Model(
                        total.start + found.start, total.move + found.move, total.emit + found.emit, total.fit + found.fit)
            if total is not None:
                table = np.concatenate([total.start[None], total.move, total.emit, np.full((1, states), total.fit)])
                for s in range(table.shape[1]):
                    rows = np.flatnonzero(table[:, s])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), s, dtype=np.int32)), pa.array(rows.astype(np.int32)),
                         pa.array(table[rows, s])], ["state", "place", "v"])

        sums = map_arrow(texts, count, "state int, place int, v double").groupBy("state", "place").agg(
            F.sum("v").alias("v"))
        table = np.zeros((1 + end, states))
        for r in sums.collect():  # at most states * (2 + states + classes) rows
            table[r["place"], r["state"]] = r["v"]
        model = updated(Model(table[0], table[1:1 + states], table[1 + states:end]))
        fit = table[end, 0] / max(1.0, table[1 + states:end].sum())  # a token's emission counts add up to 1
        if log is not None:
            log.append(fit)
        if fit - before < settled:
            break
        before = fit
    return model


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def encode_corpus(docs: DataFrame, own_classes: int = OWN_CLASSES, ending_classes: int = ENDING_CLASSES):
    """(encoded, corpus): per document doc_id, held_out, n_tokens, n_known, base_score, word_score (log10 of
    the P(word | class)) and its classes; and the corpus counts."""
    blocks = _stored(_block_rows(docs.select("doc_id", "held_out", "text")), "lm-blocks")
    in_blocks = blocks.where("word is not null").select("blk", "word", "local", "n")
    counted = _stored(in_blocks.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    own = [r["word"] for r in counted.where("c > 0").orderBy(F.desc("c"), "word").limit(own_classes).collect()]
    shared = own_classes + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ending_classes)).cast("int")
    spark = docs.sparkSession
    ranks = spark.createDataFrame([(w, i) for i, w in enumerate(own)], "own_word string, own_class int")
    words = counted.join(F.broadcast(ranks), F.col("word") == F.col("own_word"), "left").select(
        "word", "c", F.coalesce("own_class", shared).alias("cls"))
    classes = own_classes + ending_classes + 1
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for r in words.where("c > 0").groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_tokens[r["cls"]], class_words[r["cls"]] = r["c"], r["n"]
    train_docs = blocks.where("word is null and not held_out").count()
    corpus = Corpus(int(class_tokens.sum()) + train_docs, train_docs, int(class_words.sum()) + (train_docs > 0),
                    class_tokens, class_words)
    known = in_blocks.select("blk", "word", "local").join(words.withColumnRenamed("word", "w"), F.col("word") == F.col("w"))
    facts = spark.sparkContext.broadcast(corpus)

    def lookup(texts: pa.Table, words: pa.Table) -> pa.Table:
        corpus = facts.value
        n = words.num_rows
        c, cls = np.zeros(n), np.zeros(n, dtype=np.int64)
        local = words["local"].to_numpy()
        c[local], cls[local] = words["c"].to_numpy(), words["cls"].to_numpy()
        base, inside = corpus.base(c), corpus.within_class(c, cls, own_classes)
        end_base = float(corpus.base(np.array([corpus.train_docs]))[0])
        small = cls.astype("<u2")
        out: dict[str, list] = {x: [] for x in ("n_tokens", "n_known", "base_score", "word_score", "symbols")}
        tail = np.array([corpus.end_class], dtype="<u2")
        for data in texts["ids"]:
            ids = np.frombuffer(zlib.decompress(data.as_py()), dtype="<i4")
            out["n_tokens"].append(len(ids) + 1)
            out["n_known"].append(int((c[ids] > 0).sum()) + (corpus.train_docs > 0))
            out["base_score"].append(float(base[ids].sum()) + end_base)
            out["word_score"].append(float(inside[ids].sum()))
            out["symbols"].append(zlib.compress(np.concatenate([small[ids], tail]).tobytes(), 1))
        types = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "word_score": pa.float64(),
                 "symbols": pa.binary()}
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"]}
                        | {k: pa.array(v, types[k]) for k, v in out.items()})

    texts = blocks.where("word is null").select(F.col("blk").alias("of_blk"), "doc_id", "held_out", "ids")
    encoded = texts.groupBy("of_blk").cogroup(known.select("blk", "local", "c", "cls").groupBy("blk")).applyInArrow(
        lookup, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double,"
                " symbols binary")
    return _stored(encoded, "lm-encoded"), corpus


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
          passes: int = PASSES, own_classes: int = OWN_CLASSES, ending_classes: int = ENDING_CLASSES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 P).

    ``held_out`` is a boolean column of ``docs``' ids; null counts as training.  A null text is empty (its end
    alone); repeated rows are each trained on and scored; other columns are ignored, whatever their names;
    an empty table gives no rows; without training rows every probability comes from smoothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text"))
    encoded, corpus = encode_corpus(rows, own_classes, ending_classes)
    model = docs.sparkSession.sparkContext.broadcast(train(encoded, len(corpus.class_tokens), states, passes))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "word_score", "symbols"]

    def forward(batches):
        for batch in batches:
            for part in _slices(batch):
                total = part.column(5).to_numpy() + log_likelihoods(model.value, _sequences(part, 6))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(total)], [*names[:5], "score"])

    scored = map_arrow(encoded.select(names), forward, "doc_id long, held_out boolean, n_tokens long, n_known long,"
                                                       " base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(corpus.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_tenth(doc_id):
    """True for ids whose crc32 leaves remainder 0 by 10; null for a null id."""
    return id_remainder(doc_id, 10) == 0
