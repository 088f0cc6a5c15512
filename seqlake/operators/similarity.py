"""Nearest-neighbour search over vectors.

Exact brute-force k-NN of a query set against every candidate, in blocks
(:mod:`.blocks`): a task holds one block of query vectors, streams candidate
batches past it and gives the k nearest of each batch per query, ties
included; ``row_number <= k`` ranks those few rows exactly.  No pairwise rows are
materialised and no candidate is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import score_in_blocks


def longest_contig(seqs: DataFrame, dataset_filter: str | None = None) -> DataFrame:
    """One contig per genome -- the longest NT record (ties: smallest gid).

    ``min_by`` over a small struct is a partial aggregate (a genome holding a
    third of all records is reduced map-side); sequences are not carried
    through the shuffle.
    """
    nt = seqs.filter(F.col("seq_type") == "NT")
    if dataset_filter:
        nt = nt.filter(F.col("dataset_id") == F.lit(dataset_filter))
    best = (nt.groupBy("dataset_id")
            .agg(F.min_by(F.struct("gid", "length"), F.struct((-F.col("length")).alias("l"), F.col("gid")))
                 .alias("b"))
            .select("dataset_id", F.col("b.gid").alias("gid"), F.col("b.length").alias("contig_length")))
    return best


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, metric: str = "cosine",
            query_id: str = "query_id", vec_col: str = "vector", order_cols: tuple[str, ...] = (),
            query_rows: int = 4096, distance_col: str = "distance") -> DataFrame:
    """For every query, the k candidates closest by ``metric`` (exact).

    ``queries``: (query_id, vector); ``candidates``: any columns + ``vec_col``.
    Ties are broken by ``order_cols`` (candidate id columns).  Output: query
    id, rank (1..k), candidate columns without the vector, distance.

    A batch's contenders are chosen by a matrix product with a tolerance, and
    their distances are computed again row by row, so a pair's distance never
    depends on how rows were batched and equal vectors tie exactly.  Null
    vectors have no neighbours and are nobody's; vectors of different lengths
    raise (split them off, and count them, with ``kmers.valid_vectors``).
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from ..functions.codes import distance_block, distance_rows, topk_with_ties

    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"Unknown distance metric: {metric}")
    q = queries.select(F.col(query_id), F.col(vec_col).alias("_qvec")).filter(F.col("_qvec").isNotNull())
    cand_cols = [c for c in candidates.columns if c != vec_col]
    cand = candidates.select(*cand_cols, vec_col).filter(F.col(vec_col).isNotNull())
    out_schema = T.StructType([q.schema[query_id], *[candidates.schema[c] for c in cand_cols],
                               T.StructField(distance_col, T.DoubleType())])

    def score(qdf: pd.DataFrame, cdf: pd.DataFrame):
        if len({len(v) for v in qdf["_qvec"]} | {len(v) for v in cdf[vec_col]}) > 1:
            raise ValueError("vectors of different lengths; use valid_vectors to reject them first")
        Q, C = (np.array(x.tolist(), dtype=np.float64) for x in (qdf["_qvec"], cdf[vec_col]))
        parts = []
        # the noise of Euclidean distances grows with the vectors
        size = max(1.0, *(float(np.sqrt((x * x).sum(axis=1)).max(initial=0)) for x in (Q, C))) if metric == "euclidean" else 1.0
        for s in range(0, len(Q), 256):
            near = topk_with_ties(distance_block(C, Q[s:s + 256], metric), k, 1e-7 * size)
            for j, rows in enumerate(near, start=s):
                part = cdf.loc[rows, cand_cols].copy()
                part.insert(0, query_id, qdf[query_id].iloc[j])
                part[distance_col] = distance_rows(C[rows], Q[j], metric)
                parts.append(part)
        return pd.concat(parts, ignore_index=True) if parts else None

    scored = score_in_blocks(q, cand, query_id, score, out_schema, query_rows)
    w = Window.partitionBy(query_id).orderBy(F.col(distance_col), *[F.col(c) for c in order_cols])
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def without_self(found: DataFrame, k: int, query_id: str, own_id: str, distance_col: str = "distance",
                 order_cols: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest other rows out of the ``k + 1`` nearest: a query's own row is left out, and so is the last
    row of a query that has ``k + 1`` others as near as itself."""
    w = Window.partitionBy(query_id).orderBy(distance_col, *order_cols)
    rest = found.filter(~F.col(query_id).eqNullSafe(F.col(own_id))).drop("rank")
    return rest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def compare_tnf_ani(tnf_hits: DataFrame, ani_hits: DataFrame, genome_col: str = "dataset_id",
                    ani_col: str = "ani", fraction_col: str = "containment") -> DataFrame:
    """TNF matches with the ANI (and aligned fraction) of the same genome,
    sorted by TNF distance.

    ANI hits are first reduced to the best hit per (query, genome), so the
    left join cannot multiply TNF rows.
    """
    best = (ani_hits.groupBy("query_id", genome_col)
            .agg(F.max_by(F.struct(F.col(ani_col).alias("a"), F.col(fraction_col).alias("f")),
                          F.struct(F.col(ani_col), F.col(fraction_col))).alias("b"))
            .select("query_id", genome_col, F.col("b.a").alias(ani_col), F.col("b.f").alias(fraction_col)))
    return tnf_hits.join(best, ["query_id", genome_col], "left").orderBy("query_id", "tnf_distance", genome_col)
