"""Sinks: FASTA/TSV/JSON export and analytics marts (K1-K5, M1)."""
