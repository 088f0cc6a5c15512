"""Exact cached encoding with public tokenizer files.

A byte-pair tokenizer works on pre-tokens, so the ids of a text are those of its pieces, one after another,
if it is cut between pre-tokens only.  A batch of texts is cut in its Arrow buffer -- at blanks and
between Latin letters and punctuation -- the distinct pieces are looked up once each, and the texts'
ids are gathered from theirs.  Pieces are told apart by their bytes.  Distinct pieces are encoded once and
remembered; a word of Latin letters goes straight to the library's merge model, anything else through the whole
tokenizer.  Texts with other characters are cut at blanks only.  A task's memory is bounded by two generations of
``CACHE_BYTES`` of remembered pieces and by ``BATCH_BYTES`` of text (or one longer text), and is let go at its end.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CACHE_BYTES = 24 << 20
#: What an entry takes in a dictionary beside its key's and its ids' own bytes.
ENTRY_BYTES = 200
BATCH_BYTES = 3 << 20
_LONG_PIECE = 200

# A cut is safe between a visible character (never white space, never a combining mark) and a blank.
_SAFE = re.compile(r"(?<=[!-~\w])(?=[ \n])")
_ODD = re.compile(r"[^ \n!-~\w]")
# Precomposed Latin letters whose lower case is one letter.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others for the characters from 256 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()

# Bytes that a plain text may have: blank, line feed, visible ASCII, and the two-byte letters from U+00C0 to U+024F.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
# Punctuation without the apostrophe, which may open a contraction.
_MARK = np.zeros(256, dtype=bool)
_MARK[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'"]] = True


class Remembered(dict):
    """UTF-8 text -> ids as bytes, computed on first use; the older of two generations is dropped when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old, self.held = compute, {}, 0

    def __missing__(self, key: bytes) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.compute(key)
            if len(key) > _LONG_PIECE:
                return ids
        if self.held >= CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = ids
        self.held += len(key) + len(ids) + ENTRY_BYTES
        return ids


class Encoder:
    """``spaced``: the tokenizer attaches a blank to the word after it (byte-level vocabulary);
    otherwise white space is dropped by the tokenizer (vocabulary with word ends)."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced = spaced
        self.merge = self.tok.model.tokenize
        self.known = Remembered(self.piece_ids)

    def piece_ids(self, key: bytes) -> bytes:
        word = key[1:] if key.startswith(b" ") else key
        if word.isalpha():  # ASCII letters only, which stand for themselves
            letters = word.decode() if self.spaced else word.lower().decode()
            if self.spaced and word is not key:
                letters = _BYTE_LETTERS[0x20] + letters
            return array("I", [t.id for t in self.merge(letters)]).tobytes()
        piece = key.decode()
        if not _WORD.fullmatch(piece):
            return array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()
        if not self.spaced:
            piece = piece.lower().lstrip()
        letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of any text, cut at blanks, as little-endian unsigned 32-bit integers."""
        return b"".join([self.known[p.encode()] for p in _SAFE.split(text)])

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]], its last id is ``end_id``; null is empty."""
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_binary())])
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        starts, odd = self.piece_starts(data, offsets)
        which, distinct = distinct_pieces(*((data, starts) if self.spaced else bare_pieces(data, starts, odd)))
        pieces = byte_strings(distinct)
        found = list(map(self.known.get, pieces))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            # a long piece is most likely a text that is not plain
            found[i] = self.known[pieces[i]] if len(pieces[i]) <= _LONG_PIECE else self.encode(pieces[i].decode())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        table = np.frombuffer(b"".join(found), dtype="<u4")
        size = sizes[which]
        ids_before = np.concatenate([[0], np.cumsum(size)])
        if ids_before[-1] >= 1 << 31:
            raise ValueError("a text of more than 2 ** 31 tokens")
        shift = ((np.cumsum(sizes) - sizes)[which] - ids_before[:-1]).astype(np.int32)
        at = np.repeat(shift, size)
        at += np.arange(ids_before[-1], dtype=np.int32)
        bounds = ids_before[np.searchsorted(starts, offsets)] + np.arange(len(offsets))
        out = np.full(int(bounds[-1]), end_id, dtype="<u4")
        inner = np.ones(len(out), dtype=bool)
        inner[bounds[1:] - 1] = False
        out[inner] = table[at]
        return out, bounds

    def piece_starts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(starts, odd).  Starts of the pieces: of texts, and in plain texts the first blank of a run (the first other
        character after it, if the tokenizer drops blanks) and every change between letters and marks.  ``odd`` marks
        the bytes of the texts that are not plain, each a piece of its own (None: there is none)."""
        begin = offsets[:-1][np.diff(offsets) > 0]
        blank = (data == 0x20) | (data == 0x0A)
        letter, mark = _LETTER[data], _MARK[data]
        opens = np.zeros(len(data), dtype=bool)
        opens[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        if self.spaced:
            opens[1:] |= blank[1:] & ~blank[:-1]
            # a line feed that is a run of its own is a pre-token, and the word after it has no blank
            single = data == 0x0A
            single[1:] &= ~blank[:-1]
            opens[1:] |= single[:-1] & letter[1:]
        else:
            opens[1:] |= ~blank[1:] & blank[:-1]
        odd = ~_PLAIN[data]
        # signs among the letters, a letter whose lower case is two characters, and what may be a special token
        for first, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0x3C, 0x7C)):
            odd[:-1] |= (data[:-1] == first) & (data[1:] == second)
        if len(begin) and odd.any():
            sizes = np.diff(np.append(begin, len(data)))
            odd = np.repeat(np.logical_or.reduceat(odd, begin), sizes)
            opens &= ~odd
        else:
            odd = None
        opens[begin] = True
        return np.flatnonzero(opens), odd


def bare_pieces(data: np.ndarray, starts: np.ndarray, odd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(data, starts) without the blanks and with A-Z in lower case, for a tokenizer that makes no
    difference; texts that are not plain stay as they are."""
    keep = (data != 0x20) & (data != 0x0A)
    if odd is not None:
        keep |= odd
    bare = data[keep]
    upper = (bare - np.uint8(0x41)) < 26
    if odd is not None:
        upper &= ~odd[keep]
    bare |= upper.view(np.uint8) << np.uint8(5)
    return bare, (np.cumsum(keep) - keep)[starts]  # the kept bytes before each start


def distinct_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(place of each piece among the distinct ones, distinct pieces) of a buffer cut at ``starts``."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                   [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def byte_strings(pieces: pa.Array) -> list[bytes]:
    """The values of a large-binary array without nulls, from its buffers: a tenth of the cost of ``to_pylist``."""
    if not len(pieces):
        return []
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    body = pieces.buffers()[2]
    data, at = body.to_pybytes() if body else b"", offsets.tolist()
    return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def text_slices(batch: pa.RecordBatch, column: int, most_rows: int = 2000):
    """``batch`` in slices of at most ``most_rows`` rows and about BATCH_BYTES of text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        room = np.cumsum(sizes[at:at + most_rows])
        n = max(1, int(np.searchsorted(room, BATCH_BYTES, side="right")))
        yield batch.slice(at, n)
        at += n


@contextmanager
def encoder(path: str, spaced: bool) -> Iterator[Encoder]:
    """An encoder for one task; what it remembers goes with it."""
    yield (enc := Encoder(path, spaced))
    enc.known.clear()
    enc.known.old = {}


def is_spaced(path: str) -> bool:
    """True for byte-level vocabularies that keep white space."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["normalizer"] is None
