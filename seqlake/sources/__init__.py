"""Readers: FASTA, metadata/classifier/orthogroup/annotation TSVs, hit tables,
the Parquet lake and marts, plus the surrogate catalogue from driver tables."""
