"""Product registry (R1, R2, W3, U4, F13): a manifest of published files.

The registry is a small table of (dataset_id, product, uri, sha256, version,
created_at).  A product may have many files: an upsert keeps every file of the newest
version of each (dataset, product).  Checksums are recomputed for every file in one
``binaryFile`` job, never file by file on the driver.  The table lives in Parquet,
one table per revision, and a revision is published by one atomic file (:mod:`.snapshots`): a reader never sees a
half-written registry, and of two writers the later one upserts into the earlier one's table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PRODUCTS
from .analytics import latest_per_key
from .snapshots import current, publish

KEY = ["dataset_id", "product"]


def latest_products(products: DataFrame) -> DataFrame:
    """One entry per (dataset, product): the newest."""
    return latest_per_key(products, KEY, "created_at")


def newest_version(products: DataFrame) -> DataFrame:
    """Every row of the newest (created_at, version) of each (dataset, product)."""
    stamp = F.struct("created_at", "version")
    newest = products.groupBy(*[F.col(c).alias(f"_{c}") for c in KEY]).agg(F.max(stamp).alias("_newest"))
    on = [products[c].eqNullSafe(newest[f"_{c}"]) for c in KEY] + [stamp.eqNullSafe(F.col("_newest"))]
    return products.join(newest, on, "left_semi")


def upsert_products(products: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of the same key are replaced by the newest version's, file by file; a file
    listed twice in it is kept once."""
    both = products.unionByName(new, allowMissingColumns=True)
    return newest_version(both).dropDuplicates([*KEY, "uri"])


def load_products(spark: SparkSession, root: str, revision: int | None = None) -> DataFrame:
    """A revision of the registry (default: the newest); an empty table if there is none."""
    return current(spark, root, "tables", PRODUCTS, revision)


def register_products(spark: SparkSession, root: str, new: DataFrame) -> int:
    """Upsert ``new`` into the stored registry; returns the revision written."""
    rows = new.select(*PRODUCTS.fieldNames())
    return publish(spark, root, "tables", PRODUCTS, lambda stored: upsert_products(stored, rows))


def list_products(products: DataFrame, dataset_id: str | None = None, product: str | None = None) -> DataFrame:
    df = products
    if dataset_id:
        df = df.filter(F.col("dataset_id") == F.lit(dataset_id))
    if product:
        df = df.filter(F.col("product") == F.lit(product))
    return df


def get_product(products: DataFrame, dataset_id: str, product: str) -> DataFrame:
    """Every file of the product's newest version."""
    return newest_version(list_products(products, dataset_id, product))


def file_hashes(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, sha256, size) of every file matching the glob, hashed on executors."""
    return (spark.read.format("binaryFile").load(path_glob)
            .select(F.col("path"), F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("size")))


def verify_checksums(products: DataFrame, hashes: DataFrame, uri_col: str = "uri") -> DataFrame:
    """R2: per entry: no recorded hash -> true; missing file -> false; else equality."""
    h = hashes.select(F.col("path").alias("_path"), F.col("sha256").alias("_actual"))
    j = products.join(h, products[uri_col] == h["_path"], "left")
    ok = (F.when(F.col("sha256").isNull(), F.lit(True))
          .when(F.col("_actual").isNull(), F.lit(False))
          .otherwise(F.col("sha256") == F.col("_actual")))
    return j.select(*products.columns, ok.alias("verified"))


def manifest(spark: SparkSession, path_glob: str, dataset_id: str, product: str, version: str) -> DataFrame:
    """R1 re-aimed: registry rows for every file an export wrote (one job)."""
    return file_hashes(spark, path_glob).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(product).alias("product"), F.col("path").alias("uri"),
        "sha256", F.lit(version).alias("version"), F.current_timestamp().alias("created_at"))
