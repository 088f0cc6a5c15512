"""Integer k-mer codes for Arrow-batched tasks (small numpy helpers).

A k-mer over an alphabet of size ``b`` is the base-``b`` number of its symbol
indices (first symbol most significant).  For DNA (A,C,G,T = 0..3) that is
2 bits per base, and the reverse complement's code is computed alongside so
the canonical (strand independent) code is ``min(code, rc_code)``.

Sampling for FracMinHash uses a 32-bit mixer: the 64-bit code is folded to 32
bits (``code ^ (code >> 32)``) and passed through the murmur3 finalizer;
a k-mer is kept when the result is below ``2^32 / c``.
"""

from __future__ import annotations

import numpy as np

DNA = "ACGT"
MASK32 = np.uint64(0xFFFFFFFF)
# murmur3 32-bit finalizer constants.
FMIX_C1 = np.uint64(0x85EBCA6B)
FMIX_C2 = np.uint64(0xC2B2AE35)


def _lut(alphabet: str) -> np.ndarray:
    lut = np.full(256, -1, dtype=np.int64)
    for i, ch in enumerate(alphabet):
        lut[ord(ch)] = i
    return lut


def symbols(seq: str, alphabet: str) -> np.ndarray:
    """Symbol index per position, -1 outside the alphabet."""
    return _lut(alphabet)[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]


def window_codes(v: np.ndarray, k: int, base: int, reverse_complement: bool = False):
    """Codes of every window of ``k`` valid symbols (windows touching an
    invalid symbol are dropped).  Returns (codes, rc_codes or None) as uint64."""
    n = len(v) - k + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.uint64)
        return empty, (empty if reverse_complement else None)
    bad = np.concatenate([[0], np.cumsum(v < 0)])
    ok = (bad[k:] - bad[:-k]) == 0
    vv = np.where(v < 0, 0, v).astype(np.uint64)
    b = np.uint64(base)
    code = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        code = code * b + vv[j:j + n]
    rc = None
    if reverse_complement:
        comp = np.uint64(base - 1) - vv
        rc = np.zeros(n, dtype=np.uint64)
        for j in range(k - 1, -1, -1):
            rc = rc * b + comp[j:j + n]
        rc = rc[ok]
    return code[ok], rc


def fmix32(code: np.ndarray) -> np.ndarray:
    h = (code ^ (code >> np.uint64(32))) & MASK32
    h ^= h >> np.uint64(16)
    h = (h * FMIX_C1) & MASK32
    h ^= h >> np.uint64(13)
    h = (h * FMIX_C2) & MASK32
    h ^= h >> np.uint64(16)
    return h


def sketch_codes(seq: str, k: int, c: int) -> np.ndarray:
    """Distinct canonical DNA k-mer codes kept by the 1/c hash sample (k <= 31)."""
    code, rc = window_codes(symbols(seq, DNA), k, 4, reverse_complement=True)
    canon = np.minimum(code, rc)
    keep = fmix32(canon) < np.uint64((1 << 32) // c)
    return np.unique(canon[keep])


#: Windows that the batch kernels hold at a time: their arrays stay in the processor's cache.
PIECE = 1 << 16
_DNA_SYMBOL = np.full(256, 4, dtype=np.uint8)
_DNA_SYMBOL[[ord(x) for x in DNA]] = range(4)


def joined(seqs) -> tuple[np.ndarray, np.ndarray]:
    """(letters, ends): the sequences' letters one after the other, each sequence followed by a letter that
    is no base; ``ends[i]`` is the place after the one that follows sequence i.  A null sequence is empty."""
    texts = [s or "" for s in seqs]
    data = np.frombuffer(("\n".join(texts) + "\n").encode("latin-1", "replace"), dtype=np.uint8)
    return data, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)


def dna_windows(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, reverse complements' codes, valid) of every window of ``k`` letters (k <= 31); longer windows are
    put together from shorter ones, in as many steps as ``k`` has binary digits."""
    kind = np.uint8 if k <= 4 else np.uint32 if k <= 16 else np.uint64
    symbol = _DNA_SYMBOL[letters]
    ok = symbol < 4
    fwd = (symbol & np.uint8(3)).astype(kind)
    rev = kind(3) - fwd
    n = len(letters) - k + 1
    if n <= 0:
        return fwd[:0], rev[:0], ok[:0]
    code = back = valid = None
    size, have, rest = 1, 0, k
    while True:
        if rest & 1:
            part = slice(have, have + n)
            if code is None:
                code, back, valid = fwd[part], rev[part], ok[part]
            else:
                code = (code << kind(2 * size)) | fwd[part]
                back = back | (rev[part] << kind(2 * have))
                valid = valid & ok[part]
            have += size
        rest >>= 1
        if not rest:
            return code, back, valid
        shift = kind(2 * size)
        fwd, rev, ok = (fwd[:-size] << shift) | fwd[size:], rev[:-size] | (rev[size:] << shift), ok[:-size] & ok[size:]
        size *= 2


def sketch_batch(seqs, k: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, code) of every window that the 1/c hash sample keeps, repeats included; a
    sequence's distinct codes are its :func:`sketch_codes`."""
    data, ends = joined(seqs)
    limit = (1 << 32) // c
    places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data) - k + 1, PIECE):
        code, back, valid = dna_windows(data[at:at + PIECE + k - 1], k)
        canon = np.minimum(code, back)
        h = canon.astype(np.uint32) if k <= 16 else (canon ^ (canon >> np.uint64(32))).astype(np.uint32)
        h ^= h >> np.uint32(16)
        h *= np.uint32(FMIX_C1)
        h ^= h >> np.uint32(13)
        h *= np.uint32(FMIX_C2)
        h ^= h >> np.uint32(16)
        kept = np.flatnonzero((h < limit) & valid)
        places.append(kept + at)
        codes.append(canon[kept].astype(np.int64))
    return np.searchsorted(ends, np.concatenate(places), side="right"), np.concatenate(codes)


def distinct_codes(seq: str, k: int, alphabet: str) -> np.ndarray:
    code, _ = window_codes(symbols(seq, alphabet), k, len(alphabet))
    return np.unique(code)


def code_counts(seq: str, k: int, alphabet: str):
    code, _ = window_codes(symbols(seq, alphabet), k, len(alphabet))
    return np.unique(code, return_counts=True)


class SharedCodes:
    """A block of code sets, indexed to count what each shares with other code sets.

    The codes that many sets have are columns of a dense matrix, so that a batch is counted by one product; of the
    others the owners are listed, and a batch's hits are counted by one ``bincount`` per few million.
    """

    #: Codes of the dense part at most, and hits expanded at a time (few enough to stay in the processor's cache).
    DENSE, HITS = 4096, 1 << 17

    def __init__(self, names: np.ndarray, codes: list[np.ndarray]):
        """``codes[i]`` belongs to ``names[i]``; the rows of one name are one set."""
        self.names, owner = np.unique(names, return_inverse=True)
        n = len(self.names)
        self.codes, code = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]).astype(np.int64), return_inverse=True)
        pairs = np.sort(code * n + np.repeat(owner, [len(c) for c in codes]))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[:len(pairs)]]
        code, self.owners = np.divmod(pairs, max(1, n))
        self.sizes = np.bincount(self.owners, minlength=n)
        self.lengths = np.bincount(code, minlength=len(self.codes))
        self.starts = np.cumsum(self.lengths) - self.lengths
        often = np.argsort(-self.lengths, kind="stable")[:self.DENSE]
        often = often[(self.lengths[often] * 16 > n) & (self.lengths[often] > 16)]
        self.column = np.full(len(self.codes), -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), dtype=np.float32)
        for j, i in enumerate(often):
            self.dense[j, self.owners[self.starts[i]:self.starts[i] + self.lengths[i]]] = 1

    def counts(self, codes: list[np.ndarray]) -> np.ndarray:
        """(rows of ``codes``, names): the number of distinct codes that a row shares with each set."""
        n = len(self.names)
        if not len(self.codes) or not codes:
            return np.zeros((len(codes), n), dtype=np.int64)
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code = np.concatenate(codes).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code
        row, at = row[known], at[known]
        column = self.column[at]
        have = np.zeros((len(codes), len(self.dense)), dtype=np.float32)
        have[row[column >= 0], column[column >= 0]] = 1
        out = np.rint(have @ self.dense).astype(np.int64)
        row, at = row[column < 0], at[column < 0]
        length = self.lengths[at]
        ends = np.cumsum(length)
        cut = 0
        while cut < len(at):
            upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + self.HITS, side="right")))
            r, ls = row[cut:upto], length[cut:upto]
            # the owners of every matched code, one after the other
            first = self.starts[at[cut:upto]] - np.concatenate([[0], np.cumsum(ls)[:-1]])
            hit = self.owners[np.repeat(first, ls) + np.arange(ls.sum())]
            low, high = int(r[0]), int(r[-1]) + 1
            out[low:high] += np.bincount(np.repeat((r - low) * n, ls) + hit, minlength=(high - low) * n).reshape(high - low, n)
            cut = upto
        return out


def most_shared(block: SharedCodes, names: np.ndarray, codes: list[np.ndarray], k: int, least: np.ndarray, rows: int = 512):
    """Per set of ``block``, the ``k`` of ``names`` that share most codes, ties to the smaller name: arrays
    (set number, name, shared).  A name with several rows counts with its best one.  A set's entry of ``least`` is
    the count to reach; it is raised, in place, to the ``k``-th best count found so far."""
    order = np.argsort(names, kind="stable")
    names = names[order]
    out = []
    for at in range(0, len(names), rows):
        part = names[at:at + rows]
        count = block.counts([codes[i] for i in order[at:at + rows]])
        first = np.concatenate([[True], part[1:] != part[:-1]]).nonzero()[0]
        part, count = part[first], np.maximum.reduceat(count, first, axis=0)
        if len(part) > k:
            np.maximum(least, np.partition(count, len(part) - k, axis=0)[len(part) - k], out=least)
        i, t = np.nonzero((count >= least[None, :]).T)
        c = count[t, i]
        best = np.lexsort((t, -c, i))
        i, t, c = i[best], t[best], c[best]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[place < k], part[t[place < k]], c[place < k]))
    return [np.concatenate(x) for x in zip(*out)]


class PrunedBlock:
    """A block of code sets, indexed to find the few other sets that share at least ``least[i]`` codes with set i.

    A set of ``size`` codes that shares ``least`` of them with another has at most ``size - least`` codes that the other
    lacks.  So a part of every set, its rarest codes and one more than it may lack at least, is listed by code; a hit list
    counts it, and the rest, of fewer than ``least`` codes, is counted for those alone that can still reach ``least``.
    Sets smaller than ``least`` are left out before.  ``least`` rises with what is found.
    """

    #: Sets and others counted at a time (the counts stay in the processor's cache), hits expanded and pairs held at a time.
    SPAN, ROWS, HITS, HELD = 1024, 16, 1 << 17, 1 << 20
    #: The share of a set that is listed at least, and the codes up to which they are looked up in a table.
    LISTED, TABLE = 0.4, 1 << 23

    def __init__(self, names: np.ndarray, sizes: np.ndarray, codes: np.ndarray, least: np.ndarray):
        """``codes`` holds the sets' distinct codes, one set after the other; a name comes once."""
        n, order = len(names), np.argsort(least, kind="stable")
        self.names, self.least, self.sizes = names[order], least[order].astype(np.int64), sizes[order].astype(np.int64)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        owner = np.repeat(place, sizes)
        # codes are numbered from the rarest in the block to the most frequent
        if len(codes) and codes.max() < self.TABLE:
            seen = np.zeros(codes.max() + 1, dtype=bool)
            seen[codes] = True
            self.values = np.flatnonzero(seen)
        else:
            self.values = np.unique(codes)
        self.number = None
        self.table = None
        if len(self.values) and self.values[-1] < self.TABLE:
            self.table = np.full(self.values[-1] + 2, -1, dtype=np.int64)
            self.table[self.values] = np.arange(len(self.values))
        at = self._numbers(codes)
        v = max(1, len(self.values))
        self.number = np.empty(len(self.values), dtype=np.int64)
        self.number[np.argsort(np.bincount(at, minlength=len(self.values)), kind="stable")] = np.arange(len(self.values))
        owner, code = np.divmod(np.sort(owner * v + self.number[at]), v)
        if self.table is not None:
            self.table[self.values] = self.number
        listed = np.minimum(self.sizes, np.maximum(self.sizes - self.least + 1, np.ceil(self.LISTED * self.sizes).astype(np.int64)))
        starts = np.cumsum(self.sizes) - self.sizes
        is_listed = np.arange(len(code)) < np.repeat(starts + listed, self.sizes)
        self.rest = self.sizes - listed
        self.rest_codes, self.rest_ends = code[~is_listed], np.cumsum(self.rest)
        self.spans = []
        for a in range(0, n, self.SPAN):
            b = min(n, a + self.SPAN)
            part = slice(starts[a], starts[b - 1] + self.sizes[b - 1])
            c, o = np.divmod(np.sort((code[part] * self.SPAN + owner[part] - a)[is_listed[part]]), self.SPAN)
            length = np.bincount(c, minlength=v)
            self.spans.append((a, b, o.astype(np.int32), (np.cumsum(length) - length).astype(np.int32), length.astype(np.int32)))
        self.steps = np.arange(self.HITS, dtype=np.int32)

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        """The codes' numbers, -1 for those that no set has."""
        if self.table is not None:
            return self.table[np.minimum(codes, len(self.table) - 1)]
        if not len(self.values):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.values, codes), len(self.values) - 1)
        return np.where(self.values[at] == codes, at if self.number is None else self.number[at], -1)

    def search(self, names: np.ndarray, sizes: np.ndarray, codes: np.ndarray, k: int):
        """Per set, the ``k`` of ``names`` that share most codes, ties to the smaller name, as far as they reach the set's
        ``least``: arrays (set number, name, shared).  A name with several rows counts with its best one."""
        order = np.argsort(-sizes, kind="stable")
        code = self._numbers(codes)
        known = code >= 0
        have = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes)).astype(np.int64)
        code, starts = code[known], np.cumsum(have) - have
        sizes, have, starts = sizes[order].astype(np.int64), have[order], starts[order]
        ends = np.cumsum(have)
        code = code[np.repeat(starts - (ends - have), have) + np.arange(len(code))]  # in the order of the rows
        starts = ends - have
        row = np.repeat(np.arange(len(sizes)), have)
        unique, name = np.unique(names[order], return_inverse=True)
        held, pairs, out = [], 0, []
        for a in range(0, len(sizes), self.ROWS):
            b = min(len(sizes), a + self.ROWS)
            part = slice(starts[a], ends[b - 1])
            for low, high, owners, first, length in self.spans:
                if sizes[a] < self.least[low:high].min():
                    continue
                r, q, shared = self._listed(code[part], row[part] - a, b - a, low, high, owners, first, length)
                fits = (sizes[a + r] >= self.least[q]) & (shared + np.minimum(self.rest[q], sizes[a + r] - shared) >= self.least[q])
                if fits.any():
                    held.append((a + r[fits], q[fits], shared[fits]))
                    pairs += len(held[-1][0])
                if pairs > self.HELD:
                    out.append(self._best(held, code, starts, ends, name, k))
                    held, pairs = [], 0
        if held:
            out.append(self._best(held, code, starts, ends, name, k))
        if not out:
            return np.zeros(0, np.int64), unique[:0], np.zeros(0, np.int64)
        q, t, shared = map(np.concatenate, zip(*out))
        return q, unique[t], shared

    def _listed(self, code, row, rows, low, high, owners, first, length):
        """(row, set, count) of the pairs whose listed parts alone have as many hits as they need."""
        size = length[code]
        some = np.flatnonzero(size)
        size, begin, row = size[some], first[code[some]], (row[some] * self.SPAN).astype(np.int32)
        ends, cut, count = np.cumsum(size), 0, None
        while cut < len(size):
            before = int(ends[cut - 1]) if cut else 0
            upto = max(cut + 1, int(np.searchsorted(ends, before + self.HITS, side="right")))
            s, total = size[cut:upto], int(ends[upto - 1]) - before
            at = np.repeat(begin[cut:upto] - (ends[cut:upto] - before - s).astype(np.int32), s)
            at += self.steps[:total] if total <= self.HITS else np.arange(total, dtype=np.int32)
            cell = owners[at]
            cell += np.repeat(row[cut:upto], s)
            found = np.bincount(cell, minlength=rows * self.SPAN)
            count = found if count is None else count + found
            cut = upto
        if count is None:
            return (np.zeros(0, np.int64),) * 3
        count = count.reshape(rows, self.SPAN)[:, :high - low]
        r, q = np.nonzero(count >= (self.least[low:high] - self.rest[low:high])[None, :])
        return r, q + low, count[r, q]

    def _best(self, held, code, starts, ends, name, k):
        """Counts the pairs' other parts, keeps every set's ``k`` best names and raises its ``least``."""
        r, q, shared = map(np.concatenate, zip(*held))
        order = np.argsort(q, kind="stable")
        r, q, shared = r[order], q[order], shared[order]
        cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])).tolist() + [len(q)]
        in_rest = np.zeros(max(1, len(self.values)), dtype=np.uint8)
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = q[a]
            if not self.rest[i]:
                continue
            rest = self.rest_codes[self.rest_ends[i] - self.rest[i]:self.rest_ends[i]]
            in_rest[rest] = 1
            for c in range(a, b, 4096):
                d = min(b, c + 4096)
                s, e = starts[r[c:d]], ends[r[c:d]]
                theirs = np.concatenate([code[x:y] for x, y in zip(s.tolist(), e.tolist())])
                shared[c:d] += np.add.reduceat(in_rest[theirs], np.cumsum(e - s) - (e - s), dtype=np.int64)
            in_rest[rest] = 0
        fits = shared >= self.least[q]
        q, t, shared = q[fits], name[r[fits]], shared[fits]
        order = np.lexsort((-shared, t, q))
        q, t, shared = q[order], t[order], shared[order]
        first = np.ones(len(q), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (t[1:] != t[:-1])
        q, t, shared = q[first], t[first], shared[first]
        order = np.lexsort((t, -shared, q))
        q, t, shared = q[order], t[order], shared[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], shared[last])
        return q[place < k], t[place < k], shared[place < k]


def distance_block(C: np.ndarray, Q: np.ndarray, metric: str) -> np.ndarray:
    """Distances (candidates x queries) in float64.

    cosine: 1 - c.q / (|c| |q|), 1.0 when a norm is zero; euclidean via
    |c|^2 + |q|^2 - 2 c.q clipped at 0 (absolute error ~1e-9 near 0).
    """
    dots = C @ Q.T
    nc = np.sqrt((C * C).sum(axis=1))[:, None]
    nq = np.sqrt((Q * Q).sum(axis=1))[None, :]
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1.0 - dots / (nc * nq)
        return np.where((nc == 0) | (nq == 0), 1.0, d)
    if metric == "euclidean":
        return np.sqrt(np.maximum(nc ** 2 + nq ** 2 - 2.0 * dots, 0.0))
    raise ValueError(f"Unknown distance metric: {metric}")


def distance_rows(C: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every row of ``C`` to one vector, each from its own two vectors only: equal pairs
    have equal distances wherever they are computed."""
    if metric == "euclidean":
        return np.sqrt(((C - q) ** 2).sum(axis=1))
    nc, nq = np.sqrt((C * C).sum(axis=1)), np.sqrt((q * q).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 1.0 - (C * q).sum(axis=1) / (nc * nq)
    return np.where((nc == 0) | (nq == 0), 1.0, d)


def topk_with_ties(d: np.ndarray, k: int, tolerance: float = 1e-7) -> list[np.ndarray]:
    """Per column, the row indices whose value is within the k smallest, or above the k-th
    by no more than ``tolerance`` (matrix products carry noise), so that a
    later exact ranking with tie-breakers sees all contenders."""
    n = d.shape[0]
    if n <= k:
        return [np.arange(n)] * d.shape[1]
    kth = np.partition(d, k - 1, axis=0)[k - 1]
    return [np.nonzero(d[:, j] <= kth[j] + tolerance)[0] for j in range(d.shape[1])]
