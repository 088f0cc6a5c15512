"""Per-record sequence expressions used by ingest and export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NT_ALPHABET_RE = "^[ACGTUN]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def header_cols(record_id) -> tuple[Column, Column]:
    """Split a FASTA record id into (dataset_id, local header).

    ``genome|contig``   -> (genome, contig)      split on the first bar
    ``genome_<digits>`` -> (genome, whole id)
    anything else       -> (id, id)
    """
    rid = _c(record_id)
    has_bar = F.instr(rid, "|") > 0
    numbered = rid.rlike("_[0-9]+$")
    dataset_id = (F.when(has_bar, F.substring_index(rid, "|", 1))
                  .when(numbered, F.regexp_extract(rid, r"^(.*)_[0-9]+$", 1))
                  .otherwise(rid))
    local = F.when(has_bar, F.substr(rid, F.instr(rid, "|") + 1)).otherwise(rid)
    return dataset_id, local


def seq_type_col(seq_upper) -> Column:
    """NT when every distinct character is one of ACGTUN, else AA; empty -> AA.

    The reference rule is "share of distinct characters inside ACGTUN > 0.95".
    Only six such characters exist and 6/7 < 0.95, so a single foreign
    character already makes a sequence AA: the rule is a full-match test,
    evaluated here as one regex scan without building a character set.
    """
    return F.when(_c(seq_upper).rlike(NT_ALPHABET_RE), F.lit("NT")).otherwise(F.lit("AA"))


def normalise_sequence(seq, seq_type=None, protein_u_to_t: bool = False) -> Column:
    """Upper-case; ``U`` -> ``T`` for nucleotides.

    With ``protein_u_to_t=True`` the replacement is applied to proteins as well
    (parity with the reference, which also rewrites selenocysteine).
    """
    up = F.upper(_c(seq))
    if protein_u_to_t:
        return F.translate(up, "U", "T")
    kind = seq_type_col(up) if seq_type is None else _c(seq_type)
    return F.when(kind == "NT", F.translate(up, "U", "T")).otherwise(up)


def gc_col(seq_upper, seq_type=None) -> Column:
    """GC percentage as float32: (G+C)/length*100, 0.0 when empty; null for AA rows."""
    s = _c(seq_upper)
    total = F.length(s)
    gc = total - F.length(F.translate(s, "GC", ""))
    value = F.when(total == 0, F.lit(0.0)).otherwise(gc / total * F.lit(100.0)).cast("float")
    if seq_type is None:
        return value
    return F.when(_c(seq_type) == "NT", value)


def wrap_fasta(seq, width: int = 60) -> Column:
    """Insert a newline after every ``width`` characters except at the very end."""
    return F.regexp_replace(_c(seq), f"(.{{{width}}})(?=.)", "$1\n")


def fasta_record(header, seq, width: int = 60) -> Column:
    """``>header\\n`` followed by the wrapped sequence (one text row per record)."""
    return F.concat(F.lit(">"), _c(header), F.lit("\n"), wrap_fasta(seq, width))
