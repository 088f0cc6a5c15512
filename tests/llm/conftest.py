import os

import pytest
from .odd_texts import ODD_TEXTS


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("driver tables missing")
    return path


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a null id and columns whose names clash with results."""
    rows = [(i, t, "en", None, 7, "x") for i, t in enumerate(ODD_TEXTS)] + [
        (3, ODD_TEXTS[3], "en", "s", 7, "x"), (5, ODD_TEXTS[5], None, None, 7, "x"), (5, ODD_TEXTS[5], None, None, 7, "x"),
        (None, "no id here", "de", "s", 7, "x"), (None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").select(
        "*", *[_lit(c) for c in ("slot", "start", "ids", "grp", "n_words", "Fingerprint", "component_id", "score", "kept",
                                 "spans", "row", "block", "word", "bucket", "rank")])


def _lit(name):
    from pyspark.sql import functions as F

    return F.lit("clash").alias(name)
