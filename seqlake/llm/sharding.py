"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; a node weighs what the shards below it weigh together.  A row
descends level by level: among the children of its node each draws -ln(u) / weight, with u hashed from (key,
child), and the least draw wins, which is a draw by weight.  Only children of the chosen node are drawn, so a
change of weights moves rows only at the nodes whose own weight or whose children's weights changed, and
only inside them: a weight shifted between two shards of a rack moves rows inside that rack alone, a shard that
grows takes rows from its rack, its region by its rack's gain and the rest by its region's gain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import reserve, written


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def regular_tree(n_shards: int, per_rack: int = 5, racks: int = 2) -> list[Shard]:
    """Shards 0..n-1 of weight 1 filling racks of ``per_rack`` and regions of ``racks`` racks in order.

    A shard's place depends on its number alone, so a longer tree extends a shorter one.
    """
    return [Shard(s, s // (per_rack * racks), s // per_rack % racks) for s in range(n_shards)]


LEVELS = ("region", "rack", "shard")


def draw(key: Column, path: tuple[int, ...], weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the upper 52 bits of a hash of (key, node)."""
    h = F.shiftrightunsigned(F.xxhash64(key, *[F.lit(x).cast("long") for x in path], F.lit("node-draw")), 12)
    u = (h.cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def children(tree: list[Shard]) -> dict[tuple[int, ...], dict[int, float]]:
    """Weights of every inner node's children; a node is the tuple of its region, rack and shard numbers.

    Shards of weight 0 or less, and nodes without others, are not in the tree.
    """
    found: dict[tuple[int, ...], dict[int, float]] = {}
    for leaf in sorted((s for s in tree if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard)):
        path = (leaf.region, leaf.rack, leaf.shard)
        for level in range(len(path)):
            below = found.setdefault(path[:level], {})
            below[path[level]] = below.get(path[level], 0.0) + leaf.weight
    if not found:
        raise ValueError("the tree has no shard of positive weight")
    return found


def descend(df: DataFrame, key: Column, tree: list[Shard], names: tuple[str, str, str] = LEVELS) -> DataFrame:
    """``df`` with the region, rack and shard that ``key`` descends to, in columns of the given names.

    Exact ties go to the lower number; a null key is one key.
    """
    nodes = children(tree)
    for level, name in enumerate(names):
        chosen = None
        for path, below in nodes.items():
            if len(path) != level:
                continue
            draws = [F.struct(draw(key, (*path, n), w).alias("draw"), F.lit(n).alias("node")) for n, w in below.items()]
            best = (F.least(*draws) if len(draws) > 1 else draws[0])["node"]
            here = F.lit(True)
            for above, n in zip(names, path):
                here = here & (F.col(above) == n)
            chosen = F.when(here, best) if chosen is None else chosen.when(here, best)
        df = df.withColumn(name, chosen)
    return df


def assign_shards(df: DataFrame, key: str, tree: list[Shard], grown: list[Shard] | None = None,
                  rows_per_bucket: int = 50_000) -> DataFrame:
    """Every row of ``df`` with ``shard``, ``slot`` and, given a ``grown`` tree, ``grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps, by (bucket, key): rows are ranked
    inside hash buckets of about ``rows_per_bucket`` rows and shifted by the counts of the shard's
    earlier buckets, so no task holds a whole shard.  Buckets are hashed from the row's number, so rows that
    repeat a key share its shard but not one bucket; repeated rows are numbered in any order.  The placed rows are
    written once.  Columns of ``df`` named shard, slot or grown_shard (in any case) are dropped: the
    result's columns replace them.  An empty table gives an empty result.
    """
    new = ["shard", "slot"] + (["grown_shard"] if grown else [])
    rows = df.select([c for c in df.columns if c.lower() not in new or c == key])
    number, bucket, rank, before = (reserve(rows, x) for x in ("row_number", "bucket", "rank", "before"))
    own, more = (tuple(reserve(rows, f"{kind}_{c}") for c in LEVELS) for kind in ("own", "grown"))
    placed = descend(rows.withColumn(number, F.monotonically_increasing_id()), F.col(key), tree, own)
    if grown:
        placed = descend(placed, F.col(key), grown, more)
    placed = written(placed, "placed")
    n = placed.count()
    buckets = max(1, -(-n // (rows_per_bucket * max(1, len(tree)))))
    placed = placed.withColumn(bucket, F.pmod(F.xxhash64(F.col(number), F.lit("shard-bucket")), F.lit(buckets)).cast("int"))
    shard = own[-1]
    counts = placed.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(before))
    # one row per shard and bucket: as many rows as rows_per_bucket goes into the table
    starts = counts.withColumn(before, F.coalesce(F.sum(before).over(
        W.partitionBy(shard).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn(rank, F.row_number().over(W.partitionBy(shard, bucket).orderBy(key, number)) - 1)
    out = ranked.join(starts.select(F.col(shard).alias(shard + "_"), F.col(bucket).alias(bucket + "_"), before),
                      (F.col(shard) == F.col(shard + "_")) & (F.col(bucket) == F.col(bucket + "_")))
    cols = [F.col(c) for c in rows.columns] + [F.col(shard).alias("shard"), (F.col(before) + F.col(rank)).alias("slot")]
    return out.select(*cols, *([F.col(more[-1]).alias("grown_shard")] if grown else []))
