"""Prefix trie of conversations in double arrays.

Conversations become sequences of turn keys (SHA-256 of role and text).  Equal sequences are merged first; the
distinct ones are range-partitioned in lexicographic order, so a shard holds the sequences between two
prefixes however many share a first turn.  A shard packs chunks of its sequences into double-array tries:
turns get dense ids, a child of the node in slot ``s`` by turn ``t`` sits in slot ``BASE[s] + t``, and ``CHECK`` of
that slot names ``s``.  All sequences of a chunk walk the arrays together, leaving their aggregates in the nodes.

Only nodes on a chunk's first or last path can occur in other chunks.  These leave the shard with partial
aggregates under a key of their path and are merged by joins over the paths alone, linear in their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, written

#: Turns of one double array (or one longer conversation), and of one shard.
CHUNK_TURNS = 200_000
SHARD_TURNS = 2_000_000
NO_MEMBER = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, chars): each conversation's turns in order, one row per conversation.

    Turns are ordered by ``turn``, null first; turns of equal number by the hash of role and text, and
    repeated rows are turns of their own.  Null role or text is empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), key.alias("key"),
                 F.length(text).cast("long").alias("chars")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.col("t.key").alias("keys"), F.col("t.chars").alias("chars"))


def spliced(sequences: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Every sequence with its first ``taken`` turns replaced by those of conversation ``base`` (all that
    it has, if fewer; none if there is no such conversation)."""
    lists = ("keys", "chars")
    parts = [f"{side}_{c}" for side in ("head", "tail") for c in lists]
    own = sequences.select("conv_id", base.alias("base"), taken.alias("taken"), *[
        F.slice(c, taken + 1, F.size(c)).alias(f"tail_{c}") for c in lists])
    wanted = own.groupBy(F.col("base").alias("of")).agg(F.max("taken").alias("most"))
    heads = sequences.join(wanted, F.col("conv_id") == F.col("of")).select(
        "of", *[F.slice(c, F.lit(1), F.col("most")).alias(f"head_{c}") for c in lists])
    joined = own.join(heads, F.col("base") == F.col("of"), "left")
    return joined.select("conv_id", "taken", *parts).select("conv_id", *[
        F.concat(F.coalesce(F.slice(f"head_{c}", 1, F.col("taken")), F.expr(f"slice(tail_{c}, 1, 0)")), f"tail_{c}").alias(c)
        for c in lists])


def _listed(batches):
    """Runs of equal sequences as one row per Arrow batch: (seq, first conv_id, members, their ids joined)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        seqs, ids = batch.column(0), batch.column(1).to_numpy()
        coded = seqs.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], coded[1:] != coded[:-1]]))
        runs = np.split(ids, starts[1:])
        yield pa.RecordBatch.from_arrays(
            [seqs.take(pa.array(starts)), pa.array(ids[starts]), pa.array([len(r) for r in runs], pa.int64()),
             pa.array([",".join(map(str, r.tolist())) for r in runs], pa.string())], ["seq", "first", "n", "ids"])


def _digested(batches):
    """One row per sequence of sorted runs: (seq, smallest conv_id, members, SHA-256 of all their ids)."""
    seq = first = n = digest = None
    for batch in batches:
        out = []
        for s, f, k, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if s != seq:
                if seq is not None:
                    out.append((seq, first, n, digest.hexdigest()))
                seq, first, n, digest = s, f, 0, hashlib.sha256()
            digest.update(("," if n else "").encode() + ids.encode())
            n += k
        yield _rows(out)
    if seq is not None:
        yield _rows([(seq, first, n, digest.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*out)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["seq", "conv_id", "n", "ends"])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(conv_id, n, ends, keys, chars): one row per distinct sequence with its smallest member, the number of
    members and the SHA-256 of their ids, ascending and comma-joined.

    Members of one sequence may fill several tasks, where their ids are joined; only the joined
    runs of a sequence meet, one after another, in the task that hashes them.
    """
    named = written(sequences.withColumn("seq", F.unhex(F.sha2(F.array_join(F.transform("keys", F.hex), ""), 256))), "sequences")
    dealt = named.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    runs = map_arrow(dealt, _listed, "seq binary, first long, n long, ids string")
    ends = map_arrow(runs.repartition("seq").sortWithinPartitions("seq", "first"), _digested,
                     "seq binary, conv_id long, n long, ends string")
    return ends.drop("seq").join(named.drop("seq"), "conv_id")


class DoubleArray:
    """BASE and CHECK over the dense ids (1 and up) of sequences in lexicographic order; the root is slot 0."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        parents, labels, path = [-1], [0], [0]
        last: list[int] = []
        flat, cuts = ids.tolist(), bounds.tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            word = flat[a:b]
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del path[shared + 1:]
            for label in word[shared:]:
                parents.append(path[-1])
                labels.append(label)
                path.append(len(parents) - 1)
            last = word
        self._pack(np.array(parents), np.array(labels))

    def _pack(self, parents: np.ndarray, labels: np.ndarray) -> None:
        n = len(parents)
        order = np.lexsort((labels, parents))[1:]  # children by parent; the root is nobody's child
        begin = np.searchsorted(parents[order], np.arange(n + 1)).tolist()
        used = bytearray(2 * n + int(labels.max(initial=0)) + 2)
        used[0] = 1
        slot, base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        free = 1
        for node in range(n):  # a parent comes before its children
            mine = order[begin[node]:begin[node + 1]]
            if not len(mine):
                continue
            free = used.find(0, free)
            wants = labels[mine]
            first, offsets = int(wants[0]), wants - wants[0]
            at = used.find(0, max(free, first))
            while at < 0 or at + int(offsets[-1]) >= len(used) or (
                    len(mine) > 1 and np.frombuffer(used, dtype=np.uint8)[at + offsets].any()):
                if at < 0 or at + int(offsets[-1]) >= len(used):
                    at = max(first, len(used) if at < 0 else at)
                    used = used + bytearray(at + int(offsets[-1]) + 1 - len(used))
                else:
                    at = used.find(0, at + 1)
            base[node] = at - first
            slot[mine] = at + offsets
            for s in (at + offsets).tolist():
                used[s] = 1
        self.base = np.zeros(len(used), dtype=np.int64)
        self.check = np.full(len(used), -1, dtype=np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parents[1:]]

    def step(self, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of the children by ``ids``, -1 where there is none."""
        at = self.base[slots] + ids
        return np.where((at < len(self.check)) & (self.check[np.minimum(at, len(self.check) - 1)] == slots), at, -1)


_SHARD = ("chunk long, side int, shared boolean, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary,"
          " n_convs long, n_children long, n_leaves long, saved long, chars long, ends string")


def chunk_nodes(chunk: int, keys: pa.ListArray, chars: np.ndarray, firsts: np.ndarray, members: np.ndarray,
                ends: list[str]) -> pa.RecordBatch:
    """Nodes of one chunk of sorted, distinct sequences (columns of ``_SHARD``)."""
    bounds = np.concatenate([[0], np.cumsum(np.diff(keys.offsets.to_numpy()))])
    turns = keys.flatten()
    ids = turns.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    trie = DoubleArray(ids, bounds)
    sizes, size = np.diff(bounds), len(trie.check)
    at = np.zeros(len(firsts), dtype=np.int64)
    n, depth, last_chars, ending = (np.zeros(size, dtype=np.int64) for _ in range(4))
    least = np.full(size, np.iinfo(np.int64).max)
    ending -= 1
    n[0], least[0] = members.sum(), firsts.min()
    border = [[0], [0]]
    live = np.arange(len(firsts))
    for d in range(int(sizes.max()) + 1):
        done = live[sizes[live] == d]
        ending[at[done]] = done
        live = live[sizes[live] > d]
        if not len(live):
            break
        place = bounds[live] + d
        at[live] = trie.step(at[live], ids[place])
        np.add.at(n, at[live], members[live])
        np.minimum.at(least, at[live], firsts[live])
        depth[at[live]], last_chars[at[live]] = d + 1, chars[place]
        for side, who in enumerate((0, len(firsts) - 1)):
            if sizes[who] > d:
                border[side].append(int(at[who]))

    shared = np.zeros(size, dtype=bool)
    shared[border[0] + border[1]] = True
    nodes = np.flatnonzero(trie.check >= 0)
    inner = nodes[~shared[nodes]]
    parent = trie.check
    n_children = np.bincount(parent[inner], minlength=size)  # shared children are counted when shards meet
    leaves, saved = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    leaves[inner] = n_children[inner] == 0
    saved[inner] = (n[inner] - 1) * last_chars[inner]
    for level in np.split(inner[np.argsort(-depth[inner], kind="stable")],
                          np.flatnonzero(np.diff(np.sort(-depth[inner]))) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])

    names: dict[int, bytes] = {0: b""}
    for who, path in ((0, border[0]), (len(firsts) - 1, border[1])):
        for d, s in enumerate(path[1:]):
            names.setdefault(s, hashlib.sha256(names[path[d]] + turns[int(bounds[who]) + d].as_py()).digest())
    out = np.concatenate([border[0], border[1], inner]).astype(np.int64)
    blank = np.zeros(len(out), dtype=bool)  # a node on both paths: its second row has no share of its own
    blank[len(border[0]):len(border[0]) + len(border[1])] = np.isin(border[1], border[0])
    up = np.maximum(parent[out], 0)
    side = np.repeat([0, 1, 0], [len(border[0]), len(border[1]), len(inner)]).astype(np.int32)
    share = lambda values: pa.array(np.where(blank, 0, values[out]), pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(out), chunk), pa.int64()), pa.array(side), pa.array(shared[out]), pa.array(least[out]),
        pa.array(depth[out]), pa.array(least[up], pa.int64(), mask=shared[up]),
        pa.array([names.get(s) for s in out.tolist()], pa.binary()),
        pa.array([names.get(p) if p >= 0 else None for p in parent[out].tolist()], pa.binary()),
        share(n), share(n_children), share(leaves), share(saved), pa.array(last_chars[out]),
        pa.array([ends[e] if e >= 0 else None for e in ending[out].tolist()], pa.string())],
        [f.strip().split(" ")[0] for f in _SHARD.split(",")])


def shard_nodes(distinct: DataFrame) -> DataFrame:
    """Nodes of every shard, those on the border of a chunk with their share of the aggregates."""
    distinct = written(distinct, "distinct-sequences")
    turns = distinct.agg(F.sum(F.size("keys")).alias("turns")).first()["turns"] or 0
    shards = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    dealt = distinct.select("keys", "chars", "conv_id", "n", "ends").repartitionByRange(shards, "keys").sortWithinPartitions("keys")

    def build(batches):
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, turns = [], 0
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            at = 0
            while at < batch.num_rows:
                fits = max(1 - bool(held), int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_TURNS - turns, side="right")))
                held.append(batch.slice(at, fits))
                turns += int(sizes[at:at + fits].sum())
                at += fits
                if at < batch.num_rows:
                    yield chunk_of(chunk, held)
                    chunk, held, turns = chunk + 1, [], 0
        if sum(b.num_rows for b in held):
            yield chunk_of(chunk, held)

    def chunk_of(chunk, held):
        keys, chars, firsts, members, ends = pa.Table.from_batches(held).combine_chunks().columns
        one = lambda c: pa.concat_arrays(c.chunks)
        return chunk_nodes(chunk, one(keys), one(chars).flatten().to_numpy(), one(firsts).to_numpy(), one(members).to_numpy(),
                           ends.to_pylist())

    return map_arrow(dealt, build, _SHARD)


def _merged(shared: DataFrame) -> DataFrame:
    """Shared nodes with whole aggregates; every row of ``shared`` is a node on a path (chunk, side).

    A node belongs to the least path that holds it.  The nodes that a path owns are its lowest ones, so the sum
    over a subtree is the sum over the owned nodes below on the same path and the totals of
    all paths that hold the node without owning it.
    """
    nodes = shared.groupBy("key").agg(
        F.min(F.struct("chunk", "side")).alias("path"), F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    nodes = written(nodes, "shared-nodes")
    known = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more")).where("key is not null")
    nodes = nodes.join(known, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")) \
                 .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).drop("more")
    nodes = written(nodes, "shared-nodes")
    totals = nodes.groupBy("path").agg(F.sum("n_leaves").alias("path_leaves"), F.sum("saved").alias("path_saved"))
    rows = shared.select("key", F.struct("chunk", "side").alias("on"))
    hanging = (rows.join(nodes.select("key", "path"), "key").where("on != path").drop("path")
               .join(totals, F.col("on") == F.col("path")).groupBy("key")
               .agg(F.sum("path_leaves").alias("more_leaves"), F.sum("path_saved").alias("more_saved")))
    below = W.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    summed = nodes.withColumn("n_leaves", F.sum("n_leaves").over(below)).withColumn("saved", F.sum("saved").over(below))
    whole = summed.join(hanging, "key", "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))) \
                  .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return written(whole.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends")
                   .join(parents, "parent_key", "left"), "shared-nodes")


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    The root has depth 0 and no parent and holds all conversations, even those without turns.  An empty
    table has no nodes.  A conversation is one row (40 bytes a turn) and has to fit into a task; any number of
    conversations may be equal or share turns.
    """
    rows = written(shard_nodes(distinct_sequences(sequences)), "shard-nodes")
    shared, inner = rows.where("shared"), rows.where("not shared")
    merged = _merged(shared)
    found = shared.select("chunk", "key").distinct().join(merged.select("key", F.col("conv_id").alias("found")), "key") \
                  .select(F.col("chunk").alias("of"), F.col("key").alias("at"), "found")
    # a hot parent's children meet it chunk by chunk
    below = inner.where("parent_key is not null").join(
        found, (F.col("chunk") == F.col("of")) & (F.col("parent_key") == F.col("at"))).withColumn("parent_conv_id", F.col("found"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
               F.coalesce("ends", F.lit(NO_MEMBER)).alias("ends_sha256")]
    return inner.where("parent_key is null").select(*columns).unionByName(below.select(*columns)).unionByName(merged.select(*columns))
