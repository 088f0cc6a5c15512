"""File sources, ingest, lake, exports and registry on small files."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURE_DIR
from seqlake.operators import catalog as cat
from seqlake.operators import ingest as ing
from seqlake.operators import registry as R
from seqlake.sinks import export as X
from seqlake.sources import files
from seqlake.sources.lake import open_catalog, read_mart
from seqlake.schemas import LAKE_COLUMNS

FASTA = ">g1|c_1 first record\nACGTN\nacgu\n>g1|c_2\n\n>g2_7 desc\r\nMKV\r\nLLU\r\n>orphan\nACGT\n"

METADATA = ("Genome\tskani_rep\tOrder\tlenBP\tGenome Name / Sample Name\torder_completeness\tpubmed_id\n"
            "g1\tg1\tOrdA\t1000.5\tname one\t91.5\t\n"
            "g2\tg1\tNA\tN/A\tname two\tbad\t123\n"
            "g1\tg1\tOrdB\t2000\tname one again\t95\t\n")


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_read_fasta(spark, tmp_path):
    p = write(tmp_path, "a.fa", FASTA)
    rows = {r.record_id: r for r in files.read_fasta(spark, p).collect()}
    assert set(rows) == {"g1|c_1", "g1|c_2", "g2_7", "orphan"}
    assert rows["g1|c_1"].sequence == "ACGTNacgu" and rows["g1|c_1"].description == "g1|c_1 first record"
    assert rows["g1|c_2"].sequence == "" and rows["g2_7"].sequence == "MKVLLU"


def test_read_fasta_split_sizes_agree(spark, tmp_path):
    recs = "".join(f">r{i}\n{'ACGT' * (i % 50 + 1)}\n{'GG' * (i % 7)}\n" for i in range(3000))
    p = write(tmp_path, "big.fa", recs)
    base = None
    for size in ("2048", "65536", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = files.read_fasta(spark, p)
        got = df.agg(F.count(F.lit(1)), F.sum(F.length("sequence")), F.countDistinct("record_id")).collect()[0]
        base = base or tuple(got)
        assert tuple(got) == base and got[0] == 3000
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_read_metadata(spark, tmp_path):
    p = write(tmp_path, "m.tsv", METADATA)
    df = files.read_metadata(spark, p)
    assert "genome_name___sample_name" in df.columns and "order" in df.columns
    rows = df.orderBy("genome_name___sample_name").collect()
    assert rows[0].lenbp == 1000 and rows[1].lenbp == 2000  # half-even: 1000.5 -> 1000
    assert rows[2].order is None and rows[2].lenbp is None and rows[2].order_completeness is None
    assert rows[0].pubmed_id == "" and rows[2].pubmed_id == "123"


def test_orthogroups_singletons_annotations(spark, tmp_path):
    og = write(tmp_path, "og.tsv", "# Species\tGenes\tAlg.-Conn.\tg1.faa\tg2.faa\n"
                                   "2\t2\t0.1\tg1|p1\tg2|p9,g2|p8\n"
                                   "1\t1\t0.1\t*\tg2|p7\n"
                                   "2\t2\t0.1\tg1|p1\t*\n")
    members = {r.gid: r.orthogroup_id for r in files.read_orthogroups(spark, og).collect()}
    assert members == {"g1|p1": "3", "g2|p9": "1", "g2|p8": "1", "g2|p7": "2"}
    raw = {r.gid for r in files.read_orthogroups(spark, og, split_cells=False).collect()}
    assert "g2|p9,g2|p8" in raw
    st = write(tmp_path, "s.tsv", "# Species\tGenes\tAlg.-Conn.\tg1.faa\tg2.faa\n1\t1\t0\t*\tg2|p5\n1\t1\t0\tg1|p4\t*\n")
    assert {r.gid for r in files.read_singletons(spark, st).collect()} == {"g2|p5", "g1|p4"}
    an = write(tmp_path, "a.tsv", "## comment\n#query\tseed_ortholog\tevalue\tscore\tCOG_category\n"
                                  "g1|p1\tx\t1e-5\tbad\tK\ng1|p2\t-\t0.1\t3\t\ng1|p1\ty\t1e-9\t7\tL\n")
    rows = {r.gid: r for r in files.read_annotations(spark, an).collect()}
    assert rows["g1|p1"].emapper_seed_ortholog == "y" and rows["g1|p1"].emapper_score == 7.0
    assert rows["g1|p2"].emapper_seed_ortholog is None and rows["g1|p2"].emapper_COG_category is None
    assert rows["g1|p2"].emapper_PFAMs is None


def test_hit_readers(spark, tmp_path):
    b = write(tmp_path, "b.tsv", "q1\tg1|p1\t90.5\t100\t1\t0\t1\t100\t1\t100\t1e-20\t200\n")
    assert files.read_blast_hits(spark, b).collect()[0].bitscore == 200.0
    e = write(tmp_path, "e.tsv", "")
    assert files.read_blast_hits(spark, e).count() == 0
    a = write(tmp_path, "ani.tsv", "Ref_file\tQuery_file\tANI\tAlign_fraction_ref\tAlign_fraction_query\tRef_name\tQuery_name\n"
                                   "r\tq\t97.5\t80\t70\tg1|c_1\tquery\n")
    row = files.read_ani_hits(spark, a).collect()[0]
    assert row.ANI == 97.5 and row.ANI_5_percentile is None
    h = write(tmp_path, "h.tsv", "qseqid\ttarget_name\n1\tg1|p1\n")
    assert files.read_hits_any(spark, h, "sseqid")[1] == "target_name"
    bad = write(tmp_path, "bad.tsv", "x\ty\n1\t2\n")
    with pytest.raises(ValueError):
        files.read_hits_any(spark, bad)


def test_ingest_end_to_end(spark, tmp_path):
    fa = write(tmp_path, "nt.fna", FASTA)
    meta = write(tmp_path, "m.tsv", METADATA)
    og = write(tmp_path, "og.tsv", "# Species\tGenes\tAlg.-Conn.\tg2.faa\n1\t1\t0\tg2|g2_7\n")
    st = write(tmp_path, "s.tsv", "# Species\tGenes\tAlg.-Conn.\tg2.faa\n")
    an = write(tmp_path, "a.tsv", "#query\tseed_ortholog\tevalue\tscore\tCOG_category\ng2|g2_7\ts\t1e-9\t5\tK\n")
    root = str(tmp_path / "lake")
    report = ing.ingest(spark, meta, [fa], root, orthogroups_path=og, singletons_path=st, annotations_path=an)
    assert report == {"records_read": 4, "records_written": 3, "records_skipped": 1, "ignored_columns": []}
    lake = open_catalog(spark, root)
    assert [(f.name, f.dataType.simpleString()) for f in lake.schema.fields if f.name != "seq_type"] == [
        x for x in LAKE_COLUMNS if x[0] != "seq_type"] and len(lake.columns) == 95
    rows = {r.gid: r for r in lake.collect()}
    assert set(rows) == {"g1|c_1", "g1|c_2", "g2|g2_7"}
    assert rows["g1|c_1"].seq_type == "NT" and rows["g1|c_1"].sequence == "ACGTNACGT"
    assert rows["g2|g2_7"].seq_type == "AA" and rows["g2|g2_7"].gc_content is None
    # g2 is not its own representative -> no orthogroup/annotation attached
    assert rows["g2|g2_7"].orthogroup_id is None and rows["g2|g2_7"].emapper_COG_category is None
    assert rows["g1|c_1"].is_skani_representative is True
    assert len(rows["g1|c_1"].tnf_136) == 136 and abs(sum(rows["g1|c_1"].tnf_136) - 1.0) < 1e-5
    assert rows["g2|g2_7"].tnf_136 is None and rows["g1|c_2"].tnf_136 is None  # empty -> AA
    # last metadata row of g1 won
    assert rows["g1|c_1"].order == "OrdB"
    got = cat.lookup_gid(lake, "g1|c_2").collect()
    assert len(got) == 1 and got[0].length == 0
    plan = cat.lookup_gid(lake, "g1|c_2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "dataset_id" in plan


def test_export_roundtrip_and_registry(spark, tmp_path):
    df = spark.createDataFrame([("b|2", "b", "NT", "A" * 130), ("a|1", "a", "NT", "ACGT"), ("c|3", "c", "AA", "MKV")],
                               "gid string, dataset_id string, seq_type string, sequence string")
    out = str(tmp_path / "nt")
    assert X.export_fasta(df, out, "NT", num_partitions=2) == 2
    back = {r.record_id: r.sequence for r in files.read_fasta(spark, out).collect()}
    assert back == {"a|1": "ACGT", "b|2": "A" * 130}
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert text.index(">a|1") < text.index(">b|2") and "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10 in text
    X.export_fasta_by_genome(df, str(tmp_path / "by"), "NT")
    parts = {d for d in os.listdir(tmp_path / "by") if d.startswith("dataset_id=")}
    assert parts == {"dataset_id=a", "dataset_id=b"}
    files_glob = str(tmp_path / "nt" / "part-*")
    hashes = R.file_hashes(spark, files_glob)
    first = hashes.orderBy("path").collect()[0]
    products = spark.createDataFrame(
        [("a", "fna", first.path, first.sha256, "v1"), ("a", "faa", first.path, "0" * 64, "v1"),
         ("b", "fna", first.path, None, "v1"), ("c", "fna", "file:/missing", "ab", "v1")],
        "dataset_id string, product string, uri string, sha256 string, version string")
    ok = {(r.dataset_id, r.product): r.verified for r in R.verify_checksums(products, hashes).collect()}
    assert ok == {("a", "fna"): True, ("a", "faa"): False, ("b", "fna"): True, ("c", "fna"): False}
    assert read_mart(spark, str(tmp_path), "nothing_here") is None
    man = R.manifest(spark, files_glob, "a", "fna", "v1")
    assert man.count() == 2 and R.verify_checksums(man, hashes).filter("NOT verified").count() == 0


def _fixture(pattern: str):
    import glob
    found = sorted(glob.glob(os.path.join(FIXTURE_DIR, pattern))) if FIXTURE_DIR else []
    return found[0] if found else None


def _fasta_facts(path):
    """Independent plain-Python parse: per-genome record counts and residues."""
    per, residues, n = {}, 0, 0
    with open(path) as f:
        for line in f:
            if line.startswith(">"):
                n += 1
                rid = line[1:].split()[0]
                g = rid.split("|", 1)[0] if "|" in rid else rid
                per[g] = per.get(g, 0) + 1
            else:
                residues += len(line.strip())
    return n, residues, per


@pytest.mark.skipif(not _fixture("*.faa"), reason="SEQLAKE_FIXTURE_DIR with a protein FASTA not set")
def test_real_fixtures(spark, tmp_path):
    import csv

    faa = shutil.copy(_fixture("*.faa"), tmp_path / "p.faa")
    n, residues, per = _fasta_facts(faa)
    parsed = ing.parse_records(files.read_fasta(spark, str(faa)))
    agg = parsed.agg(F.count(F.lit(1)), F.sum("length")).collect()[0]
    assert tuple(agg) == (n, residues)
    assert {r.dataset_id: r["count"] for r in parsed.groupBy("dataset_id").count().collect()} == per
    meta_path = _fixture("*metadata*.tsv")
    if meta_path:
        meta = shutil.copy(meta_path, tmp_path / "m.tsv")
        with open(meta) as f:
            rows = list(csv.DictReader(f, delimiter="\t"))
        key = {k.lower(): k for k in rows[0]}
        reps = sum(1 for r in rows if r[key["genome"]] == r.get(key.get("skani_rep", ""), None))
        g = ing.genome_table(files.read_metadata(spark, str(meta)))
        assert g.count() == len(rows) and g.filter("is_skani_representative").count() == reps
    for ani in (_fixture("*ci*.tsv"), _fixture("*debug*.tsv")):
        if ani:
            with open(ani) as f:
                expected = max(0, sum(1 for line in f if line.strip()) - 1)
            assert files.read_ani_hits(spark, str(shutil.copy(ani, tmp_path / os.path.basename(ani)))).count() == expected


def test_hit_exports_placement_and_upsert(spark, tmp_path):
    import json

    ext = spark.createDataFrame([("g1|c1", "g1", "P1", 5, "ACGTA"), ("g2|c2", None, None, 3, "MKV")],
                                "gid string, dataset_id string, phylum string, length int, sequence string")
    X.export_hits(ext, fasta_path=str(tmp_path / "fa"), tsv_path=str(tmp_path / "tsv"), json_path=str(tmp_path / "js"))
    text = "".join(open(tmp_path / "fa" / f).read() for f in sorted(os.listdir(tmp_path / "fa")) if f.startswith("part"))
    assert ">g1|c1 | genome=g1 | phylum=P1 | length=5\nACGTA\n" in text
    assert ">g2|c2 | genome=NA | phylum=NA | length=3\nMKV" in text
    tsv = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert tsv.count() == 2 and "sequence" in tsv.columns
    js = [json.loads(line) for f in os.listdir(tmp_path / "js") if f.startswith("part")
          for line in open(tmp_path / "js" / f)]
    assert {r["gid"] for r in js} == {"g1|c1", "g2|c2"}
    with pytest.raises(ValueError):
        X.export_hits(ext)
    raw = spark.createDataFrame([("q", "g1|c1", 99.0)], "qseqid string, sseqid string, pident double")
    X.write_hits(raw, str(tmp_path / "raw"), raw, str(tmp_path / "ann"))
    first = [l for f in os.listdir(tmp_path / "raw") if f.startswith("part") for l in open(tmp_path / "raw" / f)]
    assert first == ["q\tg1|c1\t99.0\n"]
    pl = spark.createDataFrame([("q1", "g1", 0.1)], "query_id string, tnf_top_match string, tnf_distance double")
    X.write_placement(pl, str(tmp_path / "place"))
    assert spark.read.json(str(tmp_path / "place" / "placement_json")).collect()[0].tnf_top_match == "g1"

    import datetime as dt
    old = spark.createDataFrame([("a", "fna", "u1", "h1", "v1", dt.datetime(2024, 1, 1)),
                                 ("a", "faa", "u2", "h2", "v1", dt.datetime(2024, 1, 1))],
                                "dataset_id string, product string, uri string, sha256 string, version string, created_at timestamp")
    new = spark.createDataFrame([("a", "fna", "u3", "h3", "v2", dt.datetime(2024, 2, 1))],
                                "dataset_id string, product string, uri string, sha256 string, version string, created_at timestamp")
    up = {(r.dataset_id, r.product): r.version for r in R.upsert_products(old, new).collect()}
    assert up == {("a", "fna"): "v2", ("a", "faa"): "v1"}
    assert R.get_product(R.upsert_products(old, new), "a", "fna").collect()[0].uri == "u3"
    assert R.list_products(old, product="faa").count() == 1


def test_build_marts_and_read_through(spark, tmp_path):
    from conftest import SF_SMALL
    from seqlake.operators import analytics as an
    from seqlake.sinks.marts import MART_NAMES, build_marts, taxonomy_from_mart
    from seqlake.sources import surrogate as sg

    if not os.path.exists(SF_SMALL):
        pytest.skip("driver tables missing")
    seqs = sg.catalogue(spark, SF_SMALL)
    paths = build_marts(seqs, str(tmp_path / "marts"))
    assert set(paths) == set(MART_NAMES)
    mart = read_mart(spark, str(tmp_path / "marts"), "taxonomy")
    got = [tuple(r) for r in taxonomy_from_mart(mart, "classifier", "order", None).collect()]
    exp = [tuple(r) for r in an.taxonomy_distribution(seqs, "order", "classifier", None).collect()]
    assert got == exp
    ov = read_mart(spark, str(tmp_path / "marts"), "overview").collect()[0]
    assert ov.total_sequences == seqs.count()
    ann = read_mart(spark, str(tmp_path / "marts"), "annotations")
    assert ann.select("field").distinct().count() == 4
    top3 = read_mart(spark, str(tmp_path / "marts"), "cluster_summary",
                     order=[F.col("genomes").desc(), F.col("cluster_id")], n=3).collect()
    full = an.cluster_summary(seqs, None).collect()
    assert [tuple(r) for r in top3] == [tuple(r) for r in full[:3]]


def test_ingest_with_classifier(spark, tmp_path):
    fa = write(tmp_path, "nt.fna", FASTA)
    meta = write(tmp_path, "m.tsv", METADATA)
    cls = write(tmp_path, "c.tsv", "query\torder\ttaxonomy_majority\torder_completeness\tcontigs\tlenbp\n"
                                   "g1\tGOrd\td_V;o_GOrd\t77.5\t3.5\t555\n"
                                   "g1\tGOrd2\td_V;o_GOrd2\t88\t4\t556\n")
    root = str(tmp_path / "lake")
    report = ing.ingest(spark, meta, [fa], root, classifier_path=cls)
    assert report["records_written"] == 3
    rows = {r.gid: r for r in open_catalog(spark, root, view=None).collect()}
    g1 = rows["g1|c_1"]
    # classifier renamed ranks, overrode the overlapping count columns, last classifier row won
    assert g1.gvclass_order == "GOrd2" and g1.taxonomy_majority == "d_V;o_GOrd2"
    assert g1.order_completeness == 88.0 and g1.lenbp == 556 and g1.contigs == 4
    assert g1.order == "OrdB"  # metadata's own phylogeny order is kept
    g2 = rows["g2|g2_7"]
    assert g2.gvclass_order is None and g2.order_completeness is None  # no classifier row -> nulls


@pytest.mark.skipif(not (_fixture("*.faa") and _fixture("*metadata*.tsv")),
                    reason="SEQLAKE_FIXTURE_DIR with a protein FASTA and a metadata TSV not set")
def test_annotation_queries_on_fixture_lake(spark, tmp_path):
    """Annotation-coverage style SQL, run by DuckDB on the lake we ingest from
    real fixtures, against our operators on the same lake."""
    import duckdb

    from seqlake.operators import catalog as C

    faa = shutil.copy(_fixture("*.faa"), tmp_path / "p.faa")
    meta = shutil.copy(_fixture("*metadata*.tsv"), tmp_path / "m.tsv")
    n, _, per = _fasta_facts(faa)
    root = str(tmp_path / "lake")
    rep = ing.ingest(spark, str(meta), [str(faa)], root)
    known = {r.genome for r in files.read_metadata(spark, str(meta)).select("genome").collect()}
    kept = sum(c for g, c in per.items() if g in known)
    # genomes without a metadata row are skipped
    assert (rep["records_read"], rep["records_written"], rep["records_skipped"]) == (n, kept, n - kept)
    lake = open_catalog(spark, root, view=None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sequences AS SELECT * FROM read_parquet('{root}/**/*.parquet', hive_partitioning = true)")

    q1 = con.sql("SELECT is_skani_representative, seq_type, COUNT(*) AS n FROM sequences GROUP BY 1, 2").fetchall()
    got1 = [tuple(r) for r in C.representative_breakdown(lake).collect()]
    assert sorted(got1, key=repr) == sorted(q1, key=repr)
    q2 = con.sql("""SELECT COUNT(*), COUNT(orthogroup_id), SUM(CASE WHEN is_singleton THEN 1 ELSE 0 END),
                    SUM(CASE WHEN orthogroup_id IS NULL AND is_singleton IS NULL THEN 1 ELSE 0 END)
                    FROM sequences WHERE seq_type = 'AA'""").fetchall()[0]
    got2 = C.orthogroup_coverage(lake).collect()[0]
    assert (got2.total_proteins, got2.with_orthogroup, got2.singletons, got2.no_assignment) == \
        (q2[0], q2[1], q2[2] or 0, q2[3])
    q3 = con.sql("""SELECT COUNT(*), COUNT(emapper_Description), COUNT(emapper_COG_category),
                    COUNT(emapper_KEGG_ko), COUNT(emapper_PFAMs) FROM sequences WHERE seq_type = 'AA'""").fetchall()[0]
    got3 = C.annotation_coverage(lake, ["emapper_Description", "emapper_COG_category", "emapper_KEGG_ko",
                                        "emapper_PFAMs"]).collect()[0]
    assert tuple(got3) == q3
    stats = C.stats(lake).collect()[0]
    q4 = con.sql("SELECT COUNT(*), COUNT(DISTINCT dataset_id), SUM(length) FROM sequences").fetchall()[0]
    assert (stats.total_sequences, stats.unique_genomes, stats.total_bases) == q4
    top = [tuple(r) for r in C.top_datasets(lake).collect()]
    assert top == sorted(((g, c) for g, c in per.items() if g in known), key=lambda x: (-x[1], x[0]))[:10]


def test_hmm_reader_build_sequences_and_vectors(spark, tmp_path):
    from seqlake.operators import kmers as K
    from seqlake.operators import search as SR

    h = write(tmp_path, "hmm.tsv", "query_name\ttarget_name\tevalue\tscore\tbias\nPF1\tg1|p1\t1e-9\t50.5\t0.1\n")
    row = files.read_hmm_hits(spark, h).collect()[0]
    assert row.target_name == "g1|p1" and row.score == 50.5
    recs = files.read_fasta(spark, write(tmp_path, "a.fa", FASTA))
    genomes = spark.createDataFrame([("g1", "g1"), ("g2", "g1")], "genome string, skani_rep string")
    genomes = ing.genome_table(genomes)
    wide = ing.build_sequences(recs, genomes)
    assert {r.gid for r in wide.collect()} == {"g1|c_1", "g1|c_2", "g2|g2_7"}
    vecs = spark.createDataFrame([("a", [0.0] * 136), ("b", [1.0] * 5), ("c", None)], "id string, tnf_136 array<float>")
    ok, bad = K.valid_vectors(vecs)
    assert [r.id for r in ok.collect()] == ["a"] and sorted(r.id for r in bad.collect()) == ["b", "c"]
    nt = spark.createDataFrame([("A", "ACGTACGTAAACCCGGGTTT" * 50)], "dataset_id string, sequence string")
    path = str(tmp_path / "sketch")
    SR.write_sketch(nt, path, k=8, c=2)
    stored = spark.read.parquet(path)
    assert stored.count() == SR.sketch(nt, "dataset_id", k=8, c=2).count() > 0


def test_hot_genome_spreads_over_many_files(spark, tmp_path):
    """A genome holding 90% of the records is written by many tasks (range
    partitioning on (dataset_id, gid)), not funnelled into one."""
    recs = [(f"hot|c{i:05d}", "ACGT" * 10) for i in range(1800)] + \
           [(f"cold{i % 5}|c{i:05d}", "ACGT" * 10) for i in range(200)]
    fa = write(tmp_path, "hot.fa", "".join(f">{r}\n{s}\n" for r, s in recs))
    meta = write(tmp_path, "m.tsv", "genome\tskani_rep\n" + "".join(f"{g}\t{g}\n" for g in
                                                                   ["hot", "cold0", "cold1", "cold2", "cold3", "cold4"]))
    root = str(tmp_path / "lake")
    rep = ing.ingest(spark, meta, [fa], root, num_partitions=8, compute_tnf=False)
    assert rep["records_written"] == 2000
    files_with_hot = (open_catalog(spark, root, view=None).filter(F.col("dataset_id") == "hot")
                      .select(F.input_file_name().alias("f")).distinct().count())
    assert files_with_hot >= 6


def test_upsert_keeps_every_file_and_survives_rereading(spark, tmp_path):
    df = spark.createDataFrame([(f"a|{i}", "a", "NT", "ACGT" * i) for i in range(1, 9)],
                               "gid string, dataset_id string, seq_type string, sequence string")
    X.export_fasta(df, str(tmp_path / "out"), "NT", num_partitions=4)
    new = R.manifest(spark, str(tmp_path / "out" / "part-*"), "a", "fna", "v1")
    root = f"file://{tmp_path}/registry"
    assert R.load_products(spark, root).count() == 0
    assert R.register_products(spark, root, new) == 1 and R.load_products(spark, root).count() == 4
    other = new.withColumn("product", F.lit("faa"))
    assert R.register_products(spark, root, other) == 2 and R.load_products(spark, root).count() == 8
    newer = new.limit(3).withColumn("version", F.lit("v2")).withColumn("created_at", F.expr("created_at + interval 1 day"))
    R.register_products(spark, root, newer)
    stored = R.load_products(spark, root)
    assert stored.where("product = 'fna'").count() == 3 and stored.where("product = 'faa'").count() == 4
    one = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part"))[0]
    os.remove(tmp_path / "out" / f".{one}.crc")  # the local file system's own checksum would reject the file
    with open(tmp_path / "out" / one, "a") as f:
        f.write("tampered")
    checked = R.verify_checksums(R.load_products(spark, root).where("product = 'faa'"),
                                 R.file_hashes(spark, str(tmp_path / "out" / "part-*"))).collect()
    assert sorted(r.verified for r in checked) == [False, True, True, True]


def test_minimal_lake_has_the_whole_contract(spark, tmp_path):
    """A six-column metadata table still gives every column, all catalogue operators and all marts."""
    from seqlake.operators import analytics as an
    from seqlake.operators import tables as T
    from seqlake.operators.placement import place_genome
    from seqlake.sinks.marts import MART_NAMES, build_marts

    rng = random.Random(6)
    fa = write(tmp_path, "nt.fna", "".join(f">g{i % 4}|c{i}\n{''.join(rng.choices('ACGT', k=300 + i))}\n" for i in range(12))
               + ">g1|p1\nMKVLLW\n")
    meta = write(tmp_path, "m.tsv", "genome\tskani_rep\torder\tphylum\tlenbp\textra\n"
                 + "".join(f"g{i}\tg0\tO{i}\tP\t{i}000\tx\n" for i in range(4)))
    root, tables = str(tmp_path / "lake"), str(tmp_path / "tables")
    report = ing.ingest(spark, meta, [fa], root, tables_root=tables)
    assert report == {"records_read": 13, "records_written": 13, "records_skipped": 0, "ignored_columns": ["extra"]}
    lake = open_catalog(spark, root, view=None)
    assert len(lake.columns) == 95 and lake.where("genome = dataset_id").count() == 13
    assert cat.overview_metrics(lake).collect()[0].total_sequences == 13
    assert cat.overview_metrics(lake.limit(0)).collect()[0].total_sequences == 0
    for df in (an.cluster_summary(lake), an.taxonomy_distribution(lake, "order", "phylo"), an.environment_distribution(lake, "ecosystem"),
               an.genome_statistics(lake), an.annotation_matrix(lake, "emapper_COG_category", "order"), T.orthogroup_stats(lake)):
        df.collect()
    marts = build_marts(lake, str(tmp_path / "marts"))
    assert set(marts) == set(MART_NAMES)
    stored = sorted(map(tuple, spark.read.parquet(marts["genome_statistics"]).collect()), key=repr)
    assert stored == sorted(map(tuple, an.genome_statistics(lake).collect()), key=repr)
    with pytest.raises(ValueError, match="nothing"):
        build_marts(lake, str(tmp_path / "m2"), ["nothing"])
    q = lake.where("dataset_id = 'g1' AND seq_type = 'NT'").select(F.lit("q1").alias("query_id"), "gid", "sequence")
    q = spark.createDataFrame(q.collect(), q.schema)
    assert set(os.listdir(tables)) == set(T.TABLE_NAMES)
    tables = str(tmp_path / "dense")
    T.write_tables(spark, root, tables, sketch_c=1)
    read = {n: spark.read.parquet(f"{tables}/{n}") for n in T.TABLE_NAMES}
    full = place_genome(q, lake, ani_c=1)
    fast = place_genome(q, None, ani_c=1, genomes=read["genomes"], contigs=read["tnf"], ref_sketch=read["sketch"])
    assert list(map(tuple, fast.collect())) == list(map(tuple, full.collect()))
    assert full.collect()[0].ani_top_match == "g1" and full.collect()[0].ani == 100.0
    read_from = {f.split("/")[-2] for f in fast.inputFiles()}
    assert read_from == {"genomes", "tnf", "sketch"}  # no record of the lake
    short = spark.createDataFrame([("s", "s|1", "ACG")], "query_id string, gid string, sequence string")
    assert place_genome(short, lake).collect()[0].placement == "no sampled k-mers - lineage not assessed"


def test_line_readers_odd_files(spark, tmp_path):
    og = write(tmp_path, "og.tsv", "Species\tGenes\tConn\tg1\tg2\r\n1\t1\t0\tg1|a\t*\r\n1\t1\t0\t*\tg2|b\r\n")
    assert {r.gid: r.orthogroup_id for r in files.read_orthogroups(spark, og).collect()} == {"g1|a": "1", "g2|b": "2"}
    wide = "\t".join(["*"] * 3000 + ["g9|z"])
    st = write(tmp_path, "s.tsv", f"Species\tGenes\tConn\tg1\tg2\n1\t1\t0\t*\tg2|p\r\n1\t1\t0\t{wide}\n1\t1\t0\t*\t*\n")
    assert {r.gid for r in files.read_singletons(spark, st).collect()} == {"g2|p", "g9|z"}
    an_ = write(tmp_path, "a.tsv", "#query\tPFAMs\tevalue\tCOG_category\nx|1\tPF1\t1e-3\tK\nx|2\tPF2\nx|1\t-\tbad\tL\r\n")
    rows = {r.gid: r for r in files.read_annotations(spark, an_).collect()}
    assert (rows["x|1"].emapper_PFAMs, rows["x|1"].emapper_evalue, rows["x|1"].emapper_COG_category) == (None, None, "L")
    assert rows["x|2"].emapper_PFAMs == "PF2" and rows["x|2"].emapper_COG_category is None
    big = write(tmp_path, "big.tsv", "h\n" + "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = files._numbered_lines(spark, big).where("line_no > 0").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.line_no, r.line) for r in rows} == {(i + 1, str(i)) for i in range(5000)}


def test_placement_output_lists(spark, tmp_path):
    import json

    pl = spark.createDataFrame([("q1", "g0"), ("q2", None)], "query_id string, tnf_top_match string")
    tnf = spark.createDataFrame([("q1", i + 1, f"g{i}", i / 10) for i in range(15)], "query_id string, rank int, dataset_id string, tnf_distance double")
    ani = spark.createDataFrame([("q1", "g3", 91.0), ("q1", "g1", 97.0)], "query_id string, dataset_id string, ani double")
    X.write_placement(pl, str(tmp_path), tnf, ani)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tnf_matches")).count() == 15
    rows = [json.loads(x) for f in os.listdir(tmp_path / "placement_json") if f.startswith("part")
            for x in open(tmp_path / "placement_json" / f)]
    q1 = next(r for r in rows if r["query_id"] == "q1")
    assert [x["dataset_id"] for x in q1["tnf_top_matches"]] == [f"g{i}" for i in range(10)]
    assert [x["dataset_id"] for x in q1["ani_top_matches"]] == ["g1", "g3"] and len(rows) == 2


def test_export_of_several_forms_finds_its_records_once(spark, tmp_path):
    from seqlake.sinks.export import export_hits

    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"g{i}", "d", None if i % 2 else "p", 4, "ACGT") for i in range(50)]
    df = spark.createDataFrame(rows, "gid string, dataset_id string, phylum string, length int, sequence string")
    export_hits(df.mapInArrow(look, df.schema), f"{tmp_path}/fasta", f"{tmp_path}/tsv", f"{tmp_path}/json")
    assert seen.value == 50
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/tsv").count() == 50
    assert spark.read.option("lineSep", "\n>").text(f"{tmp_path}/fasta").count() == 50


def test_a_single_mart_is_not_cached_first(spark, tmp_path, monkeypatch):
    from seqlake.sinks.marts import build_marts
    from seqlake.sources.surrogate import catalogue

    kept = []
    seqs = catalogue(spark, "/root/testdata/sf0.001")
    persist = type(seqs).persist
    monkeypatch.setattr(type(seqs), "persist", lambda self, *a: kept.append(1) or persist(self, *a))
    build_marts(seqs, str(tmp_path / "one"), names=("genome_statistics",))
    assert not kept
    build_marts(seqs, str(tmp_path / "two"), names=("genome_statistics", "overview"))
    assert kept == [1]
    one, two = (spark.read.parquet(str(tmp_path / x / "genome_statistics")) for x in ("one", "two"))
    assert one.count() == two.count() > 0
