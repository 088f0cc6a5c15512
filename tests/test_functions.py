"""Column expressions on tiny literals."""

from pyspark.sql import functions as F

from seqlake.functions import (clean_label, gc_col, header_cols, normalise_sequence, rank_label,
                               seq_type_col, wrap_fasta)
from seqlake.functions.vectors import cosine_distance, euclidean_distance


def one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_header_forms(spark):
    rows = [("AbALV|LC506465__1_21",), ("Ac19_000123",), ("plain",), ("a_1_2",), ("abc_",), ("_12",), ("x|y|z",)]
    ds, hd = header_cols(F.col("h"))
    got = [tuple(r) for r in one(spark, rows, "h string", ds, hd)]
    assert got == [("AbALV", "LC506465__1_21"), ("Ac19", "Ac19_000123"), ("plain", "plain"),
                   ("a_1", "a_1_2"), ("abc_", "abc_"), ("", "_12"), ("x", "y|z")]


def test_seq_type(spark):
    rows = [("ACGT",), ("acgun",), ("",), ("ACGTX",), ("MKV",), ("NNNN",)]
    got = [r[0] for r in one(spark, rows, "s string", seq_type_col(F.upper(F.col("s"))))]
    assert got == ["NT", "NT", "AA", "AA", "AA", "NT"]


def test_gc_and_normalise(spark):
    rows = [("acgu", "NT"), ("", "NT"), ("GGCC", "NT"), ("NNGC", "NT"), ("MUG", "AA")]
    df = spark.createDataFrame(rows, "s string, t string")
    n = normalise_sequence(F.col("s"), F.col("t"))
    got = df.select(n.alias("n"), gc_col(n, F.col("t")).alias("gc")).collect()
    assert [r.n for r in got] == ["ACGT", "", "GGCC", "NNGC", "MUG"]  # U kept in proteins by default
    assert [r.gc for r in got][:4] == [50.0, 0.0, 100.0, 50.0] and got[4].gc is None
    parity = df.select(normalise_sequence(F.col("s"), F.col("t"), protein_u_to_t=True)).collect()
    assert parity[4][0] == "MTG"


def test_rank_labels(spark):
    rows = [("d_V;p_P;o_Ord",), ("d_V;o_NA",), ("unclassified",), (None,), ("d_V;po_X;o_Y",)]
    got = one(spark, rows, "t string", rank_label("t", "order"),
              rank_label("t", "order", na_is_missing=False),
              rank_label("t", "order", anchored=False))
    assert [tuple(r) for r in got] == [
        ("Ord", "Ord", "Ord"), ("Unassigned", "NA", "Unassigned"), ("Unassigned", "Unassigned", "Unassigned"),
        ("Unassigned", "Unassigned", "Unassigned"), ("Y", "Y", "X")]
    got = one(spark, [("",), ("x",), (None,)], "c string", clean_label(F.col("c")))
    assert [r[0] for r in got] == ["Unassigned", "x", "Unassigned"]


def test_wrap(spark):
    s = "A" * 125
    got = one(spark, [(s,), ("A" * 60,), ("",)], "s string", wrap_fasta(F.col("s")))
    assert got[0][0] == "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 5
    assert got[1][0] == "A" * 60 and got[2][0] == ""


def test_distances(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])]
    got = one(spark, rows, "a array<float>, b array<float>", cosine_distance("a", "b"), euclidean_distance("a", "b"))
    assert abs(got[0][0] - 1.0) < 1e-12 and abs(got[1][0]) < 1e-12 and got[2][0] == 1.0
    assert abs(got[0][1] - 2 ** 0.5) < 1e-12


def test_half_even_integers(spark):
    from seqlake.sources.files import _typed
    df = spark.createDataFrame([("2.5",), ("3.5",), ("NA",), ("x",), (None,)], "lenbp string")
    got = [r[0] for r in df.select(_typed("lenbp", ("lenbp",), ())).collect()]
    assert got == [2, 4, None, None, None]


def test_approximate_summaries_close(spark):
    from seqlake.operators import analytics as an

    rows = [(f"g{i}", "A" if i % 3 else "B", i / 10.0, 40.0 + i % 7, 90.0 - i % 5, (i % 4) / 4.0) for i in range(200)]
    stats = spark.createDataFrame(rows, "dataset_id string, taxonomy_order string, genome_length_mb double, "
                                        "gc_percent double, completeness double, contamination double")
    exact = {r.group: r for r in an.group_summary(stats).collect()}
    approx = {r.group: r for r in an.group_summary(stats, approximate=True).collect()}
    assert set(exact) == set(approx)
    for g in exact:
        assert exact[g].genomes == approx[g].genomes
        assert abs(exact[g].median_length_mb - approx[g].median_length_mb) <= 0.1
    b = an.box_stats(stats, approximate=True).collect()
    assert len(b) == 4 and all(r["min"] <= r.median <= r["max"] for r in b)
