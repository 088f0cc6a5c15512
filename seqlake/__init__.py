"""seqlake: a Spark-native catalogue of genomes and proteins.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver inside an operator.  Modules:

* ``seqlake.functions``  column expressions (sequence, taxonomy, vectors, text)
* ``seqlake.sources``    readers (FASTA, metadata/classifier/annotation TSVs,
  hit tables, the Parquet lake, marts) and the surrogate catalogue built from
  the driver tables
* ``seqlake.operators``  ingest, catalogue lookups and aggregates, analytics,
  k-mers/TNF, similarity search, hits, placement, registry, documented tables
* ``seqlake.sinks``      FASTA/TSV/JSON export and analytics marts
* ``seqlake.plans``      the named query catalogue used by ``__spark_entry__``
"""

__version__ = "0.1.0"
