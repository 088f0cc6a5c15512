"""A query set against all candidates, block by block.

Queries are dealt to blocks of bounded size and candidates to hash chunks; every (chunk, block) pair is one
group.  Both sides travel as tagged rows of one exchange, sorted so that a group's queries come first: a task
holds one block of queries and streams the group's candidates past it in Arrow batches.  One
plan for every size: nothing is collected, broadcast or planned differently for small inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_pandas, stored


def score_in_blocks(queries: DataFrame, candidates: DataFrame, query_key: str, score: Callable, schema,
                    query_rows: int = 4096, prepare: Callable | None = None) -> DataFrame:
    """Union of ``score(query rows, candidate rows)`` over all pairs of a query block and a candidate batch.

    ``score`` gets two pandas frames with the columns of ``queries`` and ``candidates`` and returns a frame of
    ``schema`` (or None).  With ``prepare`` it gets ``prepare(query rows)``, made once per block and chunk, for the first.  Rows of one ``query_key`` value stay in one block.  About ``query_rows`` query
    rows make a block; the number of chunks is the session's number of shuffle partitions.  The queries are
    stored when this is called: they are counted and dealt, and may be costly to compute.
    """
    import pandas as pd

    spark = candidates.sparkSession
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = stored(queries, "block-queries")
    blocks = max(1, -(-queries.count() // query_rows))
    q_cols, c_cols = list(queries.columns), list(candidates.columns)
    q = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"),
        F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int").alias("_block"), F.lit(0).alias("_side"),
        *[F.col(f"`{c}`").alias(f"q_{i}") for i, c in enumerate(q_cols)],
        *[F.lit(None).cast(candidates.schema[c].dataType).alias(f"c_{i}") for i, c in enumerate(c_cols)])
    c = candidates.select(
        F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in c_cols]), F.lit(chunks)).cast("int").alias("_chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_side"),
        *[F.lit(None).cast(queries.schema[x].dataType).alias(f"q_{i}") for i, x in enumerate(q_cols)],
        *[F.col(f"`{x}`").alias(f"c_{i}") for i, x in enumerate(c_cols)])

    def run(batches):
        held, key, ready = [], None, None
        for pdf in batches:
            # consecutive rows of one group and side
            ids = pdf[["_chunk", "_block", "_side"]].to_numpy()
            cuts = [0, *((ids[1:] != ids[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                group, side, part = tuple(ids[a][:2]), ids[a][2], pdf.iloc[a:b]
                if group != key:
                    held, key, ready = [], group, None
                if side == 0:
                    held.append(part[[f"q_{i}" for i in range(len(q_cols))]].set_axis(q_cols, axis=1))
                elif held:
                    if ready is None:
                        ready = pd.concat(held, ignore_index=True)
                        ready = ready if prepare is None else prepare(ready)
                    cand = part[[f"c_{i}" for i in range(len(c_cols))]].set_axis(c_cols, axis=1)
                    out = score(ready, cand.reset_index(drop=True))
                    if out is not None and len(out):
                        yield out

    order = ["_chunk", "_block"]
    return map_in_pandas(q.unionByName(c).repartition(*order).sortWithinPartitions(*order, "_side"), run, schema)
