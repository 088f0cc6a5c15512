"""Exact ranked search by inner product over ball trees of sparse integer vectors.

Documents become vectors over the terms of a block of items: a term's weight times its saturated
frequency, in 64-bit integers, so an item's score is the inner product with its term counts.  Every
few thousand vectors of a task form a ball tree: a node has the centroid of its documents, their largest distance from it and,
per term, their largest value.  No document below a node scores above ``<q, centroid> + |q| * radius``, nor above
the item's counts times the largest values; both are rounded up by more than the doubles can err.  Items descend a tree
best bound first and stop when no bound reaches their worst kept score.  Leaves are scored in
integers, so results do not depend on trees, tasks or rounding.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, written
from .decontam import _IS_WORD, _LOWER
from .tokens import text_slices

#: Distinct (item, term) pairs of a block of items, which is broadcast; one item is never divided.
BLOCK_TERMS = 32_768
#: Documents and vector entries of one tree, and documents of a leaf.
TREE_DOCS = 4096
TREE_ENTRIES = 1 << 20
LEAF_DOCS = 32
#: One document in so many is scored first; an item's worst kept score among them bounds its whole result from below.
PROBE = 64
#: Above the relative error of any bound's sums.
_SLACK = 1e-9


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, text number of each): the runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in
    lower case; a null text has none."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body else np.zeros(0, dtype=np.uint8)
    low = _LOWER[data]
    inside = _IS_WORD[low]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = (offsets - offsets[0])[:-1]
    firsts = firsts[firsts < len(data)]
    opens[firsts] = inside[firsts]
    starts = np.flatnonzero(opens)
    letters = low[inside]
    bounds = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words, np.searchsorted(offsets - offsets[0], starts, side="right") - 1


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times), written: one row per row of ``items`` (numbered by ``item``) and distinct term."""
    def split(batches):
        for batch in batches:
            for part in text_slices(batch, 2):
                words, at = words_in(part.column(2))
                rows = pa.table({"at": pa.array(at), "term": words}).group_by(["at", "term"]).aggregate([([], "count_all")])
                rows = rows.combine_chunks()
                yield from pa.table({
                    "item": part.column(0).take(rows["at"].combine_chunks()), "item_id": part.column(1).take(rows["at"].combine_chunks()),
                    "term": rows["term"].cast(pa.binary()), "times": rows["count_all"]}).to_batches()

    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"),
                                    F.col(text_col).alias("text")), "items")
    return written(map_arrow(numbered, split, "item long, item_id long, term binary, times long"), "item-terms")


def item_blocks(terms: DataFrame, block_terms: int = BLOCK_TERMS) -> list[DataFrame]:
    """``terms`` in blocks of whole items, each of ``block_terms`` rows at most or of one item."""
    sizes = terms.groupBy("item").count()
    total = sizes.agg(F.sum("count").alias("n")).first()["n"] or 0
    blocks = -(-total // block_terms)
    while blocks:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        over = sizes.groupBy(block.alias("block")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("items")) \
                    .where((F.col("n") > block_terms) & (F.col("items") > 1))
        if over.isEmpty():
            return [terms.where(block == i) for i in range(blocks)]
        blocks *= 2
    return []


class Items:
    """The terms and counts of one block of items."""

    def __init__(self, block: DataFrame):
        rows = block.toArrow()  # at most BLOCK_TERMS rows, or one item
        self.vocabulary = pc.unique(rows["term"].combine_chunks()).sort()
        self.items, which = np.unique(rows["item"].to_numpy(), return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.bounds = np.searchsorted(which[order], np.arange(len(self.items) + 1))
        self.terms = pc.index_in(rows["term"], value_set=self.vocabulary).to_numpy()[order]
        self.times = rows["times"].to_numpy()[order]

    def __iter__(self):
        for i, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            yield i, self.terms[a:b], self.times[a:b]


def document_terms(docs: DataFrame, vocabulary: pa.Array, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, times) of the documents with a word: all their words counted, and how often each
    word of ``vocabulary`` occurs, by its place there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value.cast(pa.large_binary())
        for batch in batches:
            for part in text_slices(batch, 1):
                words, at = words_in(part.column(1))
                n = np.bincount(at, minlength=part.num_rows)
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                width = max(1, len(known))
                pairs, times = np.unique((at * width + place)[place >= 0], return_counts=True)
                bounds = np.searchsorted(pairs // width, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (pairs % width, times)]
                full = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([c.filter(full) for c in (part.column(0), pa.array(n), *lists)],
                                                 ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, count, "doc_id long, n long, terms array<int>, times array<int>")


def term_weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64)


class BallTree:
    """Documents as rows of a sparse matrix (bounds, terms, values) in leaf order, and the tree's nodes."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf_docs: int = LEAF_DOCS):
        self.leaf_docs = leaf_docs
        self.columns, place = np.unique(terms, return_inverse=True)
        self.ids, self.bounds, self.terms, self.values = ids, bounds, place.astype(np.int64), values
        self.square = self._sums(values.astype(np.float64) ** 2, 0, len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # first and last document, children (or -1)
        self._split(0, len(ids))
        m = len(self.nodes)
        self.centroid, self.most = np.zeros((len(self.columns), m)), np.zeros((len(self.columns), m))
        self.radius = np.zeros(m)
        for k, (a, b, _, _) in enumerate(self.nodes):
            s, e = self.bounds[a], self.bounds[b]
            c = np.bincount(self.terms[s:e], weights=self.values[s:e], minlength=len(self.columns)) / (b - a)
            far = self.square[a:b] - 2 * self._sums(self.values[s:e] * c[self.terms[s:e]], a, b) + (c @ c)
            # the terms of this sum are far larger than the distance may be: widen by their size
            self.radius[k] = math.sqrt(max(0.0, far.max()) + _SLACK * (self.square[a:b].max() + c @ c))
            self.centroid[:, k] = c
            np.maximum.at(self.most[:, k], self.terms[s:e], self.values[s:e])

    def _sums(self, entries: np.ndarray, a: int, b: int) -> np.ndarray:
        """Sums of the entries of each of the documents a..b-1 (a document may have none)."""
        sums = np.concatenate([[0], np.cumsum(entries)])
        cuts = self.bounds[a:b + 1] - self.bounds[a]
        return sums[cuts[1:]] - sums[cuts[:-1]]

    def _split(self, a: int, b: int) -> int:
        """Node of the documents a..b-1; halves go to the nearer of two far documents."""
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        if b - a > self.leaf_docs:
            s, e = self.bounds[a], self.bounds[b]
            one = a + int(np.argmax(self.square[a:b]))
            dots = self._dots(a, b, one)
            two = a + int(np.argmax(self.square[a:b] - 2 * dots))
            order = np.argsort(dots - self._dots(a, b, two) - (self.square[one] - self.square[two]) / 2, kind="stable")
            sizes = np.diff(self.bounds[a:b + 1])[order]
            take = np.repeat(self.bounds[a:b][order] - np.cumsum(sizes) + sizes, sizes) + np.arange(e - s)
            self.terms[s:e], self.values[s:e] = self.terms[take], self.values[take]
            self.bounds[a + 1:b + 1] = s + np.cumsum(sizes)
            self.ids[a:b], self.square[a:b] = self.ids[a:b][order], self.square[a:b][order]
            middle = (a + b) // 2
            self.nodes[me] = (a, b, self._split(a, middle), self._split(middle, b))
        return me

    def _dots(self, a: int, b: int, with_doc: int) -> np.ndarray:
        s, e = self.bounds[a], self.bounds[b]
        x, y = self.bounds[with_doc], self.bounds[with_doc + 1]
        dense = np.zeros(len(self.columns))
        dense[self.terms[x:y]] = self.values[x:y]
        return self._sums(self.values[s:e] * dense[self.terms[s:e]], a, b)

    def search(self, terms: np.ndarray, times: np.ndarray, kept: "Kept") -> tuple[int, int]:
        """Offer every document that can be among the best to ``kept``; returns (leaves scored, all leaves)."""
        spot = np.minimum(np.searchsorted(self.columns, terms), len(self.columns) - 1) if len(self.columns) else terms[:0]
        held = self.columns[spot] == terms[:len(spot)]
        spot, q = spot[held], times[:len(spot)][held]
        leaves = (len(self.nodes) + 1) // 2
        if not len(spot):
            return 0, leaves
        ball = q @ self.centroid[spot] + math.sqrt(float(q @ q)) * self.radius
        bound = np.minimum(ball, q @ self.most[spot]) * (1 + _SLACK)
        counts = np.zeros(len(self.columns), dtype=np.int64)
        counts[spot] = q
        queue, scored = [(-bound[0], 0)], 0
        while queue and -queue[0][0] >= kept.least:
            _, node = heapq.heappop(queue)
            a, b, left, right = self.nodes[node]
            if left < 0:
                s, e = self.bounds[a], self.bounds[b]
                kept.offer(self._sums(self.values[s:e] * counts[self.terms[s:e]], a, b), self.ids[a:b])
                scored += 1
            else:
                for child in (left, right):
                    if bound[child] >= kept.least:
                        heapq.heappush(queue, (-bound[child], child))
        return scored, leaves


class Kept:
    """The ``k`` best of the offered (score, id) pairs, equal scores by ascending id; scores below ``least`` are of no use."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores >= self.least
        if use.any():
            scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
            best = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[best], ids[best]
            if len(best) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def _trees(batches, weights: np.ndarray, n_docs: int, length: int, tree_docs: int, leaf_docs: int):
    """Ball trees of the batches' documents, of ``tree_docs`` documents and ``TREE_ENTRIES`` entries at most."""
    for batch in batches:
        ids = pc.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            rows = max(1, int(np.searchsorted(np.cumsum(sizes[at:at + tree_docs]), TREE_ENTRIES, side="right")))
            part = batch.slice(at, rows)
            terms, times = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            m = 100 - 75 + (75 * part.column(1).to_numpy() * n_docs) // length
            m = np.repeat(m, sizes[at:at + rows])
            values = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m))
            yield BallTree(ids[at:at + rows].copy(), np.concatenate([[0], np.cumsum(sizes[at:at + rows])]), terms, values, leaf_docs)
            at += rows


def search(vectors: DataFrame, items: Items, weights: np.ndarray, n_docs: int, length: int, k: int,
           least: np.ndarray | None = None, tree_docs: int = TREE_DOCS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """(item, doc_id, score, scored, leaves): per task and item the ``k`` best documents of score above 0 and ``least``;
    one more row a task, without an item, says how many of the leaves were scored for all items."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, least))

    def run(batches):
        items, weights, least = shared.value
        kept = [Kept(k, 1 if least is None else int(least[i])) for i, _, _ in items]
        scored = leaves = 0
        for tree in _trees(batches, weights, n_docs, length, tree_docs, leaf_docs):
            for i, terms, times in items:
                a, b = tree.search(terms, times, kept[i])
                scored, leaves = scored + a, leaves + b
        found = np.concatenate([[0], *[x.ids for x in kept]]).astype(np.int64)[1:]
        no_id = found == np.iinfo(np.int64).min
        n = len(found)
        of = np.repeat(items.items, [len(x.ids) for x in kept])
        first = lambda x: pa.array([None] * n + [x], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(of, pa.int64()), pa.nulls(1, pa.int64())]),
             pa.concat_arrays([pa.array(found, pa.int64(), mask=no_id), pa.nulls(1, pa.int64())]),
             pa.concat_arrays([pa.array(np.concatenate([[0], *[x.scores for x in kept]])[1:], pa.int64()), pa.nulls(1, pa.int64())]),
             first(scored), first(leaves)], ["item", "doc_id", "score", "scored", "leaves"])

    return map_arrow(vectors, run, "item long, doc_id long, score long, scored long, leaves long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per item, with their rank."""
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.where("item is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, tree_docs: int = TREE_DOCS,
                   leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for every row of ``items``.

    Equal scores are ranked by ascending doc_id, null first.  Null, empty and wordless texts have no terms and
    no result; repeated rows of either table count and rank as rows of their own; other columns are ignored; an
    empty table on either side gives no rows.  Items are searched in blocks, each with a scan of its own.
    """
    terms = item_terms(items)
    found = None
    for block in item_blocks(terms, block_terms):
        ranked, _ = rank_block(docs, Items(block), k, tree_docs, leaf_docs)
        if ranked is not None:
            ranked = ranked.join(block.select("item", "item_id").distinct(), "item")
            found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.select("item_id", "rank", "doc_id", "score")


def rank_block(docs: DataFrame, items: Items, k: int, tree_docs: int = TREE_DOCS,
               leaf_docs: int = LEAF_DOCS) -> tuple[DataFrame | None, DataFrame | None]:
    """(item, rank, doc_id, score) of one block of items, and the leaves scored by each task."""
    vectors = written(document_terms(docs, items.vocabulary), "document-terms")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
    if not size["n"]:
        return None, None
    holding = np.zeros(len(items.vocabulary), dtype=np.int64)
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row per term of the block
    holding[counts["term"].to_numpy()] = counts["count"].to_numpy()
    args = (items, term_weights(size["n"], holding), size["n"], size["length"], k)
    probe = _best(search(vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(PROBE)) == 0), *args), k)
    sure = probe.where(F.col("rank") == k).select("item", "score").toArrow()  # a row per item of the block
    least = np.ones(len(items.items), dtype=np.int64)
    least[np.searchsorted(items.items, sure["item"].to_numpy())] = sure["score"].to_numpy()
    found = written(search(vectors, *args, least, tree_docs, leaf_docs), "found")
    return _best(found, k).select("item", "rank", "doc_id", "score"), found.where("item is null").select("scored", "leaves")
