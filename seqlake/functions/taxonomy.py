"""Rank-label expressions over ``taxonomy_majority`` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank prefixes used inside classifier lineage strings
# ("d_...;p_...;c_...;o_...;f_...;g_...;s_...").
RANK_PREFIX = {
    "domain": "d",
    "phylum": "p",
    "class": "c",
    "order": "o",
    "family": "f",
    "genus": "g",
    "species": "s",
}

# Metadata columns holding the phylogeny-based ranks.
PHYLO_COLUMNS = {
    "domain": "domain",
    "phylum": "phylum",
    "class": "class",
    "order": "order",
    "family": "family",
    "genus": "genus",
}

# Environment dimensions of the metadata.
ENVIRONMENT_COLUMNS = (
    "ecosystem",
    "ecosystem_category",
    "ecosystem_type",
    "ecosystem_subtype",
    "habitat",
    "source",
)

UNASSIGNED = "Unassigned"


def rank_pattern(level: str, anchored: bool = True) -> str:
    if level not in RANK_PREFIX:
        raise ValueError(f"Unsupported taxonomy level: {level}")
    prefix = RANK_PREFIX[level]
    # anchored: the prefix must start the lineage or follow a ';' (the
    # unanchored form can match inside another rank's label)
    return f"(?:^|;){prefix}_([^;]+)" if anchored else f"{prefix}_([^;]+)"


def rank_raw(taxonomy, level: str, anchored: bool = True) -> Column:
    """Raw captured label: '' when the rank is absent, null when the lineage is null."""
    col = F.col(taxonomy) if isinstance(taxonomy, str) else taxonomy
    return F.regexp_extract(col, rank_pattern(level, anchored), 1)


def clean_label(raw: Column, na_is_missing: bool = True, fallback: str = UNASSIGNED) -> Column:
    """'' (and optionally 'NA') and null become ``fallback``."""
    cleaned = F.nullif(raw, F.lit(""))
    if na_is_missing:
        cleaned = F.nullif(cleaned, F.lit("NA"))
    return F.coalesce(cleaned, F.lit(fallback))


def rank_label(taxonomy, level: str, anchored: bool = True, na_is_missing: bool = True,
               fallback: str = UNASSIGNED) -> Column:
    return clean_label(rank_raw(taxonomy, level, anchored), na_is_missing, fallback)
