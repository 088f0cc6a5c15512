"""Exact nearest neighbours through a stored metric index.

Vectors are dealt to cells around centres and stored cell by cell, nearest first, in files ("pages") of
bounded rows, each with its distances to a few pivots.  A page knows the least and largest of these, so the triangle
inequality bounds from below how near any of its vectors can be to a query.  A search
first reads each query's nearest pages, which gives a bound on its k-th distance, and then only pages that
can hold something nearer; inside a page the stored pivot distances skip single vectors the same way.
Cosine distance is searched as the chord between unit vectors, which is a metric and grows with it.
Results equal :func:`.similarity.nearest`: distances are computed pair by pair and ties ranked by id columns.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import distance_rows
from ..session import scratch_path
from .common import map_in_arrow

PIVOTS = 8
CELLS = 64
#: Rows of one page; a task holds one page at a time.
PAGE_ROWS = 20_000
#: Vectors that centres and pivots are chosen from.
SAMPLE = 4096
#: Queries that one task compares with a page; more go to further tasks.
QUERY_ROWS = 20_000
#: Distances are trusted to this part of the vectors' size.
SLACK = 1e-6


def _matrix(lists: pa.Array) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths; use valid_vectors to reject them first")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def _points(v: np.ndarray, metric: str) -> np.ndarray:
    """Where the metric is Euclidean: unit vectors for cosine (zero vectors stay), the vectors themselves else."""
    if metric == "euclidean":
        return v
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size == 0, 1.0, size)


def _distances(x: np.ndarray, targets: np.ndarray, metric: str) -> np.ndarray:
    """Distances (points x targets); a zero vector has cosine distance 1, chord sqrt(2), from every vector."""
    d = np.stack([np.sqrt(((x - t) ** 2).sum(axis=1)) for t in targets], axis=1)
    if metric == "cosine":
        d[~x.any(axis=1)] = np.sqrt(2)
        d[:, ~targets.any(axis=1)] = np.sqrt(2)
    return d


def _radius(distance, metric: str):
    return np.sqrt(2 * np.maximum(distance, 0)) if metric == "cosine" else distance


def _spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` points, each the farthest from those before it."""
    chosen = [int(np.argmax((points * points).sum(axis=1)))]
    near = np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return points[chosen]


def build_index(vectors: DataFrame, root: str, metric: str = "cosine", vec_col: str = "vector", cells: int = CELLS,
                pivots: int = PIVOTS, page_rows: int = PAGE_ROWS) -> None:
    """Store ``vectors`` (any columns and ``vec_col``; null vectors are left out) as an index below ``root``.

    Centres and pivots come from a hash sample of about ``SAMPLE`` vectors; every vector is indexed.  A cell that
    holds most of the vectors is many pages, written by many tasks.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"Unknown distance metric: {metric}")
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec_col).isNotNull()).withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    n = rows.count()
    u = F.pmod(F.xxhash64(vec_col), F.lit(1 << 30))
    picked = rows.where(u <= int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))).select(vec_col).limit(2 * SAMPLE).toArrow()
    sample = np.unique(_points(_matrix(pa.concat_arrays(picked[vec_col].chunks)), metric), axis=0) if len(picked) else np.zeros((1, 1))
    centres = _spread_out(sample, cells)
    guides = centres[:pivots]

    def place(batches):
        for b in batches:
            x = _points(_matrix(b.column(b.schema.get_field_index(vec_col))), metric)
            if not len(x):
                continue
            d = _distances(x, guides, metric)
            cell = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            near = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(near), pa.array(cell.astype(np.int32))],
                                             [*b.schema.names, "_d", "_near", "_cell"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_d", T.ArrayType(T.DoubleType())),
                           T.StructField("_near", T.DoubleType()), T.StructField("_cell", T.IntegerType())])
    parts = max(1, -(-n // (4 * page_rows)))
    (map_in_arrow(rows, place, schema).repartitionByRange(parts, "_cell", "_near").sortWithinPartitions("_cell", "_near")
     .write.option("maxRecordsPerFile", page_rows).partitionBy("_cell").parquet(f"{root}/vectors"))
    stored = spark.read.schema(T.StructType(schema.fields[:-2])).parquet(f"{root}/vectors") if n else None
    bounds = [F.min(F.col("_d")[i]) for i in range(len(guides))] + [F.max(F.col("_d")[i]) for i in range(len(guides))]
    if stored is not None:
        pages = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.array(*bounds).alias("bounds"))
    else:
        pages = spark.createDataFrame([], "file string, n long, bounds array<double>")
    pages.write.parquet(f"{root}/pages")
    spark.createDataFrame([(metric, vec_col, schema.json(), [g.tolist() for g in guides])],
                          "metric string, vec_col string, columns string, pivots array<array<double>>").coalesce(1).write.parquet(f"{root}/meta")


class VectorIndex:
    """A stored index: its pivots and the bounds of its pages (a few numbers for each ``PAGE_ROWS`` rows)."""

    def __init__(self, spark: SparkSession, root: str):
        meta = spark.read.parquet(f"{root}/meta").first()
        self.spark, self.metric, self.vec_col = spark, meta["metric"], meta["vec_col"]
        self.schema = T.StructType(T.StructType.fromJson(json.loads(meta["columns"])).fields[:-2])
        self.columns = [f for f in self.schema.fields if f.name not in (self.vec_col, "_d")]
        self.pivots = np.array(meta["pivots"])
        pages = spark.read.parquet(f"{root}/pages").orderBy("file").toArrow()
        self.files, self.rows = pages["file"].to_pylist(), pages["n"].to_numpy()
        bounds = np.array(pages["bounds"].to_pylist(), dtype=np.float64).reshape(len(self.files), 2 * len(self.pivots))
        self.least, self.most = np.hsplit(bounds, 2)

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", vec_col: str = "vector",
               order_cols: tuple[str, ...] = (), distance_col: str = "distance") -> tuple[DataFrame, DataFrame]:
        """(neighbours, work): per query the ``k`` nearest rows (query id, columns, distance, rank), and how many
        pairs of a query and a vector there are and were compared."""
        q = queries.select(F.col(query_id).alias("_id"), F.col(vec_col).cast("array<double>").alias("_q")) \
                   .filter(F.col("_q").isNotNull())
        path = scratch_path(self.spark, "nn-queries")
        q.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        q = self.spark.read.parquet(path)
        first = self._stored(self._compare(self._pages(q.withColumn("_most", F.lit(float("inf"))), k, True), k, order_cols))
        order = Window.partitionBy("_row").orderBy("_distance")
        kth = (first.filter("_row is not null").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == k)
               .select("_row", F.col("_distance").alias("_kth")))
        bounded = q.join(kth, "_row", "left").withColumn("_most", F.coalesce("_kth", F.lit(float("inf")))).drop("_kth")
        rest = self._stored(self._compare(self._pages(bounded, k, False), k, order_cols))
        found = first.unionByName(rest)
        w = Window.partitionBy("_id").orderBy("_distance", *order_cols)
        names = [f.name for f in self.columns]
        near = (found.filter("_row is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select(F.col("_id").alias(query_id), *names, F.col("_distance").alias(distance_col), "rank"))
        work = found.filter("_row is null").agg(F.coalesce(F.sum("_compared"), F.lit(0)).alias("compared")) \
                    .withColumn("pairs", F.lit(q.count() * int(self.rows.sum())))
        return near, work

    def _stored(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "nn-found")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _pages(self, q: DataFrame, k: int, first: bool) -> DataFrame:
        """``q`` once per page to compare with: the nearest pages that hold ``k`` rows, or the others within reach."""
        pivots, least, most, rows, metric = self.pivots, self.least, self.most, self.rows, self.metric

        def choose(batches):
            for b in batches:
                x = _matrix(b.column(1))
                if not len(x):
                    continue
                d = _distances(_points(x, metric), pivots, metric)
                reach = _radius(b.column(3).to_numpy(), metric)
                slack = SLACK * (1 + np.sqrt((x * x).sum(axis=1)))
                chosen = []
                for i in range(len(x)):
                    bound = np.maximum(least - d[i], d[i] - most).max(axis=1).clip(0)
                    order = np.lexsort((np.abs((least + most) / 2 - d[i]).sum(axis=1), bound))
                    home = order[:int(np.searchsorted(np.cumsum(rows[order]), k)) + 1]
                    if not first:
                        wanted = bound <= reach[i] + slack[i]
                        wanted[home] = False
                        home = np.flatnonzero(wanted)
                    chosen.append(home)
                at = np.repeat(np.arange(len(x)), [len(c) for c in chosen])
                page = pa.array(np.concatenate(chosen).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in b.columns], page], [*b.schema.names, "_page"])

        q = q.select("_id", "_q", "_row", "_most")
        schema = T.StructType([*q.schema.fields, T.StructField("_page", T.IntegerType())])
        return self._stored(map_in_arrow(q, choose, schema)) if len(self.files) else self.spark.createDataFrame([], schema)

    def _compare(self, pairs: DataFrame, k: int, order_cols: tuple[str, ...]) -> DataFrame:
        """(_row, _id, columns, _distance, _compared): the ``k`` nearest rows of each (query, page) pair."""
        names = [f.name for f in self.columns]
        schema = T.StructType([T.StructField("_row", T.LongType()), pairs.schema["_id"], *[
            T.StructField(f.name, f.dataType) for f in self.columns], T.StructField("_distance", T.DoubleType()),
            T.StructField("_compared", T.LongType())])
        need = {r["_page"]: -(-r["count"] // QUERY_ROWS) for r in pairs.groupBy("_page").count().collect()}
        if not need:
            return self.spark.createDataFrame([], schema)
        known = self.spark.createDataFrame([(self.files[p], p, s) for p, s in need.items()], "_file string, _page int, _slices int")
        stored = self.spark.read.schema(self.schema).parquet(*[self.files[p] for p in need])
        side = T.StructType([*[T.StructField(f"c_{f.name}", f.dataType) for f in self.columns]])
        cand = stored.withColumn("_file", F.col("_metadata.file_path")).join(known, "_file").select(
            "_page", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), F.lit(0).alias("_side"),
            F.lit(None).cast("long").alias("_row"), F.lit(None).cast(pairs.schema["_id"].dataType).alias("_id"),
            F.lit(None).cast("double").alias("_most"), F.col(self.vec_col).alias("_v"), "_d",
            *[F.col(f"`{f.name}`").alias(f"c_{f.name}") for f in self.columns])
        asked = pairs.join(known, "_page").select(
            "_page", F.pmod(F.xxhash64("_row"), F.col("_slices")).cast("int").alias("_slice"), F.lit(1).alias("_side"), "_row", "_id",
            "_most", F.col("_q").alias("_v"), F.lit(None).cast("array<double>").alias("_d"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in side.fields])
        metric, pivots = self.metric, self.pivots

        def run(batches):
            held, key, page = [], None, None
            for b in batches:
                ids = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
                cuts = [0, *((ids[1:] != ids[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(ids)] if len(ids) else []
                for s, e in zip(cuts[:-1], cuts[1:]):
                    part, group = b.slice(s, e - s), tuple(ids[s][:2])
                    if group != key:
                        held, key, page = [], group, None
                    if ids[s][2] == 0:
                        held.append(part)
                    elif held:
                        page = page or _Page(pa.Table.from_batches(held).combine_chunks(), names, order_cols, metric)
                        yield from page.nearest(part, pivots, k)

        order = ["_page", "_slice"]
        return map_in_arrow(cand.unionByName(asked).repartition(*order).sortWithinPartitions(*order, "_side"), run, schema)


class _Page:
    """The rows of one page, and their order among equal distances."""

    def __init__(self, table: pa.Table, names: list[str], order_cols: tuple[str, ...], metric: str):
        one = lambda c: pa.concat_arrays(table[c].chunks)
        self.vectors, self.to_pivots, self.metric = _matrix(one("_v")), _matrix(one("_d")), metric
        self.columns = [one(f"c_{c}") for c in names]
        self.names = names
        keys = [(f"c_{c}", "ascending") for c in order_cols]
        ranked = pc.sort_indices(table, keys, null_placement="at_start").to_numpy() if keys else np.arange(len(table))
        self.place = np.empty(len(table), dtype=np.int64)
        self.place[ranked] = np.arange(len(table))

    def nearest(self, part: pa.RecordBatch, pivots: np.ndarray, k: int):
        col = part.schema.get_field_index
        q = _matrix(part.column(col("_v")))
        if q.shape[1] != self.vectors.shape[1]:
            raise ValueError("vectors of different lengths; use valid_vectors to reject them first")
        d = _distances(_points(q, self.metric), pivots, self.metric)
        reach = _radius(part.column(col("_most")).to_numpy(), self.metric) + SLACK * (1 + np.sqrt((q * q).sum(axis=1)))
        at, rows, distances, compared = [], [], [], 0
        for i in range(len(q)):
            near = np.flatnonzero((np.abs(self.to_pivots - d[i]) <= reach[i]).all(axis=1))
            compared += len(near)
            exact = distance_rows(self.vectors[near], q[i], self.metric)
            best = np.lexsort((self.place[near], exact))[:k]
            at.append(np.full(len(best), i))
            rows.append(near[best])
            distances.append(exact[best])
        at, rows = (pa.array(np.concatenate(x).astype(np.int64)) for x in (at, rows))
        n = len(rows)
        blank = lambda kind: pa.nulls(1, kind)
        ids = part.column(col("_id"))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([part.column(col("_row")).take(at), blank(pa.int64())]), pa.concat_arrays([ids.take(at), blank(ids.type)]),
             *[pa.concat_arrays([c.take(rows), blank(c.type)]) for c in self.columns],
             pa.concat_arrays([pa.array(np.concatenate(distances)), blank(pa.float64())]), pa.array([None] * n + [compared], pa.int64())],
            ["_row", "_id", *self.names, "_distance", "_compared"])


def nearest_indexed(queries: DataFrame, root: str, k: int = 10, query_id: str = "query_id", vec_col: str = "vector",
                    order_cols: tuple[str, ...] = (), distance_col: str = "distance") -> DataFrame:
    """The ``k`` nearest rows of a stored index for every query, as :func:`.similarity.nearest` gives them."""
    return VectorIndex(queries.sparkSession, root).search(queries, k, query_id, vec_col, order_cols, distance_col)[0]
