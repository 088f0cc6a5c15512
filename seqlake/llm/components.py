"""Connected components by alternating large-star and small-star steps (map-reduce style)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node hands its least neighbour to its larger (large star) or smaller (small star)
    neighbours.  ``edges`` has u > v, each pair once."""
    pairs = edges if small else edges.union(edges.select("v", "u"))
    # least neighbour by partial aggregation; the join back may hold hot nodes, which Spark's
    # adaptive execution splits
    least = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("node"))
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node that is not the least of its component; ``edges`` are pairs (u, v) of
    longs, in any order and number.  Each round is a written table in the shared folder."""
    state = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u > v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        state = written(_star(_star(state, small=False), small=True), "edges")
    raise RuntimeError("components did not converge")
