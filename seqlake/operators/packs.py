"""Targets' code sets against blocks of queries, without an exchange of either.

The code sets of a few thousand targets make one row, a *pack*, and those of a few thousand queries one row, a *block*;
both are stored once.  Every pack meets every block in a cartesian product that reads the stored rows again, so the disk
taken is the packs and the blocks, however many pairs of them there are.

A first pass counts the targets with the most codes in full.  Its ``k``-th best count of a query is a lower bound on
the query's last kept count, and the second pass, over all other targets, skips what cannot reach it
(:class:`..functions.codes.PrunedBlock`).  The bound changes the work and never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, stored

#: Codes and rows of a pack at most (a row's number has 16 bits); codes of a block of queries.
PACK_CODES, PACK_ROWS = 1 << 22, 1 << 15
BLOCK_CODES = 1 << 22
#: The share of all targets, and their number at least, that the first pass counts in full.
PROBE_SHARE, PROBE_TARGETS = 0.01, 2000
PACK = "pack long, names array<string>, sizes array<int>, codes binary"
BLOCK = "_block int, _q array<string>, _sizes array<int>, _codes binary, _least array<long>"
SHARED = "_q string, _t string, shared long, query_kmers long"
#: Rows are megabytes each: the writer looks at their size after every one, and a reader holds one row group.
WRITING = {"compression": "zstd", "parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def _bytes(codes) -> bytes:
    import numpy as np

    return codes.astype(np.int32 if not len(codes) or codes.max() < 1 << 31 else np.int64).tobytes()


def _codes(data, sizes):
    import numpy as np

    n = int(sizes.sum())
    return np.frombuffer(data, dtype=np.int32 if len(data) == 4 * n else np.int64)


def _list(values, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _pack(number: int, names: list, sizes, codes):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), _list(names, pa.string()), _list(sizes, pa.int32()),
                                       pa.array([_bytes(codes)], pa.binary())], ["pack", "names", "sizes", "codes"])


def _packs(pieces):
    """Pack rows out of (names, sizes, codes) pieces, which a task's packs take in their order."""
    import numpy as np
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held, rows, total = [], 0, 0
    for piece in pieces:
        if held and (rows + len(piece[0]) > PACK_ROWS or total + len(piece[2]) > PACK_CODES):
            yield _pack(number, [x for p in held for x in p[0]], np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held]))
            held, rows, total, number = [], 0, 0, number + 1
        held.append(piece)
        rows, total = rows + len(piece[0]), total + len(piece[2])
    if held:
        yield _pack(number, [x for p in held for x in p[0]], np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held]))


def write_packs(targets: DataFrame, path: str, k: int, alphabet: str) -> DataFrame:
    """The packs of (name, sequence) rows, stored at ``path``; a name with several rows has several sets."""
    import numpy as np

    from ..functions.codes import distinct_codes

    def run(batches):
        def pieces():
            for b in batches:
                for name, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    c = distinct_codes(s or "", k, alphabet).astype(np.int64)
                    yield [name], np.array([len(c)]), c

        yield from _packs(pieces())

    return _stored_packs(map_in_arrow(targets, run, PACK), path)


def _stored_packs(packs: DataFrame, path: str) -> DataFrame:
    packs.write.options(**WRITING).parquet(path)
    return packs.sparkSession.read.schema(PACK).parquet(path)


class Largest:
    """The targets that the first pass counts: those with the most codes; of as many codes as the least of them,
    a part drawn by place, so that equal sizes do not make all of them first."""

    def __init__(self, packs: DataFrame, targets: int):
        sizes = packs.select(F.explode("sizes").alias("n"))
        total = sizes.count()
        wanted = max(targets, math.ceil(total * PROBE_SHARE))
        self.cutoff, self.share = -1, 1.0
        if wanted < total:
            self.cutoff = sizes.agg(F.percentile_approx("n", 1 - wanted / total, 10000)).first()[0]
            above, at = sizes.agg(F.count_if(F.col("n") > self.cutoff), F.count_if(F.col("n") == self.cutoff)).first()
            self.share = min(1.0, max(0.0, (wanted - above) / at))

    def __call__(self, pack: int, sizes):
        import numpy as np

        drawn = (np.arange(len(sizes), dtype=np.uint64) + np.uint64(pack % 65521)) * np.uint64(2654435761) % np.uint64(1 << 32)
        return (sizes > self.cutoff) | ((sizes == self.cutoff) & (drawn < self.share * (1 << 32)))


def pack_rows(batch, columns):
    """The pack rows of a batch: (pack, names, sizes, codes, further columns)."""
    for i in range(batch.num_rows):
        sizes = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
        yield (batch.column(0)[i].as_py(), batch.column(1)[i].values, sizes, _codes(batch.column(3)[i].as_buffer(), sizes),
               {c: batch.column(c)[i] for c in columns})


def write_part(packs: DataFrame, path: str, chosen) -> DataFrame:
    """Packs of the targets that ``chosen(pack, sizes)`` names, stored at ``path``."""
    import numpy as np

    def run(batches):
        def pieces():
            for b in batches:
                for pack, names, sizes, codes, _ in pack_rows(b, ()):
                    keep = chosen(pack, sizes)
                    if keep.any():
                        yield names.filter(keep).to_pylist(), sizes[keep], codes[np.repeat(keep, sizes)]

        yield from _packs(pieces())

    return _stored_packs(map_in_arrow(packs, run, PACK), path)


class Asked:
    """Queries' code sets, (_q, _s) rows stored when this is made; the rows of one query are one set."""

    def __init__(self, codes: DataFrame, query_rows: int = 4096):
        self.rows = stored(codes, "asked")
        n, total = self.rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_s")), F.lit(0))).first()
        self.blocks = max(1, -(-n // query_rows), -(-total // BLOCK_CODES))

    def stored_blocks(self, least: DataFrame | None, min_shared: int) -> DataFrame:
        """One row per block, stored; ``least`` gives (_q, least), the count that a query's targets have to reach."""
        import numpy as np
        import pyarrow as pa

        rows = self.rows.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(self.blocks)).cast("int"))
        rows = rows.withColumn("least", F.lit(None).cast("long")) if least is None else rows.join(least, "_q", "left")
        rows = rows.select("_block", "_q", "_s", F.greatest(F.coalesce("least", F.lit(1)), F.lit(max(1, min_shared))).cast("long"))

        def run(batches):
            held = {}
            for b in batches:
                block = b.column(0).to_numpy()
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                names, least = b.column(1), b.column(3).to_numpy()
                owner = np.repeat(block, sizes)
                codes = b.column(2).flatten().to_numpy(zero_copy_only=False)
                for x in np.unique(block):
                    held.setdefault(int(x), []).append((names.filter(block == x).to_numpy(zero_copy_only=False), sizes[block == x], codes[owner == x], least[block == x]))
            for x, parts in held.items():
                names, sizes, codes, least = map(np.concatenate, zip(*parts))
                names, first, at = np.unique(names, return_index=True, return_inverse=True)
                order = np.lexsort((codes, np.repeat(at, sizes)))
                codes, owner = codes[order], np.repeat(at, sizes)[order]
                new = np.ones(len(codes), dtype=bool)
                new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([x], pa.int32()), _list(names, pa.string()), _list(np.bincount(owner[new], minlength=len(names)), pa.int32()),
                    pa.array([_bytes(codes[new])], pa.binary()), _list(least[first], pa.int64())], ["_block", "_q", "_sizes", "_codes", "_least"])

        packed = map_in_arrow(rows.repartitionByRange(self.blocks, "_block"), run, BLOCK)
        spark, path = packed.sparkSession, _scratch(packed, "query-blocks")
        packed.write.options(**WRITING).parquet(path)
        return spark.read.schema(BLOCK).parquet(path).repartitionByRange(self.blocks, "_block")


def _scratch(df: DataFrame, name: str) -> str:
    from ..session import scratch_path

    return scratch_path(df.sparkSession, name)


def _meet(packs: DataFrame, blocks: DataFrame, prepare, score) -> DataFrame:
    """Rows of ``score(prepare(block), pack)`` over every pack and block; a task holds its last prepared blocks."""
    import numpy as np
    import pyarrow as pa

    further = [c for c in packs.columns if c not in ("pack", "names", "sizes", "codes")]

    def run(batches):
        held = {}
        for b in batches:
            for i, row in enumerate(pack_rows(b, [*further, "_block", "_q", "_sizes", "_codes", "_least"])):
                at = row[4]["_block"].as_py()
                if at not in held:
                    while len(held) > 1:
                        del held[next(iter(held))]
                    get = lambda c: row[4][c].values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
                    sizes = get("_sizes")
                    held[at] = prepare(get("_q"), sizes, _codes(row[4]["_codes"].as_buffer(), sizes), get("_least"))
                q, t, shared, sizes = score(held[at], *row)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(t, pa.string()), pa.array(shared.astype(np.int64)),
                                                      pa.array(sizes.astype(np.int64))], ["_q", "_t", "shared", "query_kmers"])

    return map_in_arrow(packs.hint("shuffle_replicate_nl").crossJoin(blocks), run, SHARED)


def count_in_full(packs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(_q, _t, shared, query_kmers) of the best targets per query of every pack, each counted in full."""
    import numpy as np

    from ..functions.codes import SharedCodes, most_shared

    def prepare(names, sizes, codes, least):
        block = SharedCodes(names, np.split(codes, np.cumsum(sizes)[:-1]))  # names are sorted and come once
        return block, least.copy()

    def score(prepared, pack, names, sizes, codes, further):
        block, least = prepared
        i, t, shared = most_shared(block, names.to_numpy(zero_copy_only=False), np.split(codes, np.cumsum(sizes)[:-1]), k, least)
        return block.names[i], t, shared, block.sizes[i]

    return _meet(packs, blocks, prepare, score)


def count_pruned(packs: DataFrame, blocks: DataFrame, k: int, skip) -> DataFrame:
    """The same of the targets that ``skip`` does not name and that may reach their query's ``_least``; a ``wanted``
    column of ``packs`` has a bit per target, set for those to count."""
    import numpy as np

    from ..functions.codes import PrunedBlock

    def score(block, pack, names, sizes, codes, further):
        keep = ~skip(pack, sizes)
        if "wanted" in further:
            keep &= np.unpackbits(np.frombuffer(further["wanted"].as_buffer(), dtype=np.uint8), count=len(sizes), bitorder="little").astype(bool)
        names = names.filter(keep).to_numpy(zero_copy_only=False)
        q, t, shared = block.search(names, sizes[keep], codes[np.repeat(keep, sizes)], k)
        return block.names[q], t, shared, block.sizes[q]

    return _meet(packs, blocks, PrunedBlock, score)


class Search:
    """Both passes of a search; the first is run and stored when this is made."""

    def __init__(self, asked: DataFrame, packs: DataFrame, k: int, min_shared: int = 1, query_rows: int = 4096, probe: int | None = None):
        from .search import best_shared

        self.packs, self.k, self.min_shared = packs, k, min_shared
        self.asked = Asked(asked, query_rows)
        self.largest = Largest(packs, PROBE_TARGETS if probe is None else probe)
        first = count_in_full(write_part(packs, _scratch(packs, "largest-packs"), self.largest), self.asked.stored_blocks(None, min_shared), k)
        self.first = stored(best_shared(first, k), "first-hits")
        # the ``k``-th best count so far: no lower count can be kept in the end
        self.least = self.first.where(F.col("hit_rank") == k).select("_q", F.col("shared").alias("least"))

    def batches(self, wanted: DataFrame | None = None) -> DataFrame:
        """(_q, _t, shared, query_kmers), every query's best targets among them; ``wanted`` gives (pack, wanted), the
        packs and the bits of the targets that the second pass has to look at."""
        packs = self.packs if wanted is None else self.packs.join(F.broadcast(wanted), "pack")
        blocks = self.asked.stored_blocks(self.least, self.min_shared)
        return self.first.drop("hit_rank").unionByName(count_pruned(packs, blocks, self.k, self.largest))
