"""Column expressions (pure functions Column -> Column); JVM-side, codegen friendly."""

from .sequence import (gc_col, header_cols, normalise_sequence, seq_type_col,
                       wrap_fasta, fasta_record)
from .taxonomy import RANK_PREFIX, PHYLO_COLUMNS, ENVIRONMENT_COLUMNS, rank_raw, rank_label, clean_label
from .vectors import cosine_distance, euclidean_distance, valid_vector

__all__ = [
    "gc_col", "header_cols", "normalise_sequence", "seq_type_col", "wrap_fasta", "fasta_record",
    "RANK_PREFIX", "PHYLO_COLUMNS", "ENVIRONMENT_COLUMNS", "rank_raw", "rank_label", "clean_label",
    "cosine_distance", "euclidean_distance", "valid_vector",
]
