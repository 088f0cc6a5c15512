"""Named query catalogue: Spark plans and their DuckDB oracle SQL."""
