"""Versioned lake, one-read ingest, registry races, mergeable marts and chunk tables."""

import glob
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from seqlake.operators import analytics as an
from seqlake.operators import catalog as cat
from seqlake.operators import chunks as CH
from seqlake.operators import ingest as ing
from seqlake.operators import kmers as K
from seqlake.operators import registry as R
from seqlake.operators import snapshots as SN
from seqlake.schemas import PRODUCTS
from seqlake.sinks import mart_state as MS
from seqlake.sinks import marts
from seqlake.sources import files
from test_sources_ingest import write


def fasta(genomes, letters="ACGT"):
    return "".join(f">{g}|c{i}\n{(letters * (i % 9 + 3))}\n" for g, n in genomes.items() for i in range(n))


def metadata(genomes, order="O"):
    return "genome\tskani_rep\torder\tecosystem\n" + "".join(f"{g}\t{g}\t{order}{g}\tE{g}\n" for g in genomes)


def deliver(spark, tmp_path, root, genomes, name, letters="ACGT", order="O", **options):
    return ing.ingest(spark, write(tmp_path, f"{name}.tsv", metadata(genomes, order)), [write(tmp_path, f"{name}.fna", fasta(genomes, letters))],
                      root, compute_tnf=False, versioned=True, **options)


def stored_files(root):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{root}/**/part-*", recursive=True)}


def per_genome(df):
    return {r.dataset_id: (r.n, r.order) for r in df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("order")).collect()}


def test_reingest_replaces_its_genomes_only(spark, tmp_path):
    root = str(tmp_path / "lake")
    first = deliver(spark, tmp_path, root, {"a": 5, "b": 7, "c": 4}, "first")
    assert first["version"] == 1 and first["records_written"] == 16
    before, old = stored_files(root), SN.read_snapshot(spark, root, 1).cache()
    second = deliver(spark, tmp_path, root, {"b": 3}, "second", order="N")
    assert second["version"] == 2
    after = stored_files(root)
    assert {p: t for p, t in after.items() if p in before} == before  # no file of the first commit was touched
    new = [p for p in after if p not in before and "/commits/commit=" in p]
    assert {r.dataset_id for r in spark.read.parquet(*new).select("dataset_id").collect()} == {"b"}
    assert per_genome(SN.read_snapshot(spark, root)) == {"a": (5, "Oa"), "b": (3, "Nb"), "c": (4, "Oc")}
    assert per_genome(SN.read_snapshot(spark, root, 1)) == per_genome(old) == {"a": (5, "Oa"), "b": (7, "Ob"), "c": (4, "Oc")}
    # a genome delivered without records is gone from the new version
    write(tmp_path, "third.tsv", metadata({"c": 0, "d": 0}))
    ing.ingest(spark, str(tmp_path / "third.tsv"), [write(tmp_path, "third.fna", fasta({"d": 2}))], root, compute_tnf=False, versioned=True)
    assert per_genome(SN.read_snapshot(spark, root)) == {"a": (5, "Oa"), "b": (3, "Nb"), "d": (2, "Od")}
    assert len(SN.read_snapshot(spark, root).columns) == 95
    with pytest.raises(ValueError, match="no version 9"):
        SN.read_snapshot(spark, root, 9)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert SN.read_snapshot(spark, root).count() == 0 and SN.versions(spark, root) == []
    deliver(spark, tmp_path, root, {"a": 5}, "first")

    def broken(folder):
        spark.range(3).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        SN.commit_genomes(spark, root, spark.createDataFrame([("a",)], "dataset_id string"), broken)
    assert SN.versions(spark, root) == [1] and per_genome(SN.read_snapshot(spark, root)) == {"a": (5, "Oa")}


def test_of_two_racing_writers_none_is_lost(spark, tmp_path):
    root = f"file://{tmp_path}/race"
    rows = lambda *names: spark.createDataFrame([(n, "x") for n in names], SN.MANIFEST)
    SN.publish(spark, root, "manifests", SN.MANIFEST, lambda t: rows("start"))
    raced = []

    def slow(table):  # another writer publishes while this one is at work, the first time
        if not raced:
            raced.append(SN.publish(spark, root, "manifests", SN.MANIFEST, lambda t: t.unionByName(rows("other"))))
        return table.unionByName(rows("mine"))

    assert SN.publish(spark, root, "manifests", SN.MANIFEST, slow) == 3 and raced == [2]
    assert {r.dataset_id for r in SN.manifest(spark, root).collect()} == {"start", "other", "mine"}
    assert not SN.create_if_absent(spark, f"{root}/versions/00000003", "late")
    assert {r.dataset_id for r in SN.manifest(spark, root, 2).collect()} == {"start", "other"}


def test_compaction_keeps_what_others_replace(spark, tmp_path):
    root = str(tmp_path / "lake")
    deliver(spark, tmp_path, root, {"a": 5, "b": 7}, "first")
    deliver(spark, tmp_path, root, {"c": 2}, "second")

    def rewrite(df, folder):
        ing.write_sequences(df, folder, 2)
        deliver(spark, tmp_path, root, {"b": 1}, "meanwhile", order="M")

    SN.compact(spark, root, rewrite)
    live = {r.dataset_id: r.commit for r in SN.manifest(spark, root).collect()}
    assert live["a"] == live["c"] != live["b"]
    assert per_genome(SN.read_snapshot(spark, root)) == {"a": (5, "Oa"), "b": (1, "Mb"), "c": (2, "Oc")}


def test_registry_race_and_product_of_many_files(spark, tmp_path):
    root = f"file://{tmp_path}/registry"

    def entries(product, n, version="v1", day=1):
        rows = spark.createDataFrame([("a", product, f"{version}/{i}", "0", version) for i in range(n)],
                                     "dataset_id string, product string, uri string, sha256 string, version string")
        return rows.withColumn("created_at", F.expr(f"timestamp'2024-01-0{day}'")).select(*PRODUCTS.fieldNames())

    assert R.register_products(spark, root, entries("fna", 4)) == 1
    raced = []

    def slow(stored):
        if not raced:
            raced.append(R.register_products(spark, root, entries("faa", 2)))
        return R.upsert_products(stored, entries("gff", 3))

    assert SN.publish(spark, root, "tables", PRODUCTS, slow) == 3
    stored = R.load_products(spark, root)
    assert {p: R.get_product(stored, "a", p).count() for p in ("fna", "faa", "gff", "none")} == {"fna": 4, "faa": 2, "gff": 3, "none": 0}
    R.register_products(spark, root, entries("fna", 2, "v2", 2))
    assert sorted(r.uri for r in R.get_product(R.load_products(spark, root), "a", "fna").collect()) == ["v2/0", "v2/1"]
    assert R.load_products(spark, root, 1).count() == 4


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mart_state_adds_up_and_refreshes_new_commits_only(spark, tmp_path):
    root, state, out = (str(tmp_path / x) for x in ("lake", "state", "marts"))
    deliver(spark, tmp_path, root, {"a": 5, "b": 7, "c": 4}, "first", "ACGT")
    first = MS.refresh_marts(spark, root, state, out)
    assert len(first) == 1 and MS.refresh_marts(spark, root, state, out) == []
    kept = stored_files(state)
    deliver(spark, tmp_path, root, {"b": 3, "d": 9}, "second", "MKVW", order="N")
    second = MS.refresh_marts(spark, root, state, out)
    assert len(second) == 1 and second != first
    assert {p: t for p, t in stored_files(state).items() if p in kept} == kept
    lake = SN.read_snapshot(spark, root)
    whole = marts.build_marts(lake, str(tmp_path / "whole"))
    for name, path in whole.items():
        wanted = spark.read.parquet(path)
        assert rows(spark.read.parquet(f"{out}/{name}").select(*wanted.columns)) == rows(wanted), name
    # state(A) + state(B) is the state of A and B
    a, b = lake.where("dataset_id < 'c'"), lake.where("dataset_id >= 'c'")
    parts = [MS.genome_state(x) for x in (a, b)], [an.annotation_counts(x, list(marts.MART_FIELDS), ("dataset_id",)) for x in (a, b)]
    both = MS.marts_of_state(*[x.unionByName(y) for x, y in parts])
    one = MS.marts_of_state(MS.genome_state(lake), an.annotation_counts(lake, list(marts.MART_FIELDS), ("dataset_id",)))
    assert all(rows(both[n]) == rows(one[n]) for n in both)
    # an older version's marts, from the same state
    old = MS.marts_of_state(*MS.live_state(spark, root, state, 1))
    assert rows(old["overview"]) == rows(cat.overview_metrics(SN.read_snapshot(spark, root, 1)))


def test_layout_is_sampled_at_bounded_places(spark, tmp_path):
    many = "".join(f">g{i // 50:03d}|c{i:05d}\n{'ACGT' * 30}\n" for i in range(5000))
    path = write(tmp_path, "many.fna", many)
    titles = ing.sampled_headers(spark, [path], places=100, each=400)
    assert 80 <= len(titles) <= 100 and titles == sorted(titles)
    assert ing.sampled_headers(spark, [path + ".gz"]) == [] and ing.sampled_headers(spark, []) == []
    frame = spark.createDataFrame([(t,) for t in titles], "record_id string")
    bounds = ing.range_bounds(frame, 5)
    assert len(bounds) == 4 and bounds == sorted(bounds)
    spread = spark.createDataFrame([(f"g{i // 50:03d}", f"g{i // 50:03d}|c{i:05d}") for i in range(5000)], "dataset_id string, gid string")
    sizes = [r["count"] for r in spread.groupBy(ing._part(bounds, 5).alias("part")).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1500 and ing.range_bounds(frame.limit(0), 5) == []


EVENTS = """
import sys; sys.path.insert(0, {root!r})
from seqlake.session import get_spark
spark = get_spark("local[2]", 4, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{log}", "spark.eventLog.compress": "false",
    "spark.ui.enabled": "false", "spark.checkpoint.dir": "{log}/scratch"}})
from seqlake.operators import ingest as ing, catalog as cat
from seqlake.sources.lake import open_catalog
spark.sparkContext.setJobGroup("ingest", "x")
print("REPORT", ing.ingest(spark, "{meta}", ["{nt}", "{aa}"], "{lake}", num_partitions=4, compute_tnf=False))
lake = open_catalog(spark, "{lake}", view=None)
for group, gid in (("absent", "g01|c00050x"), ("present", "g01|c00055")):
    spark.sparkContext.setJobGroup(group, "x")
    print(group, len(lake.where(lake.gid == gid).select("gid", "sequence").collect()))
spark.stop()
"""


def test_ingest_reads_its_files_once_and_lookups_skip(tmp_path):
    """From the event log of a session of its own: bytes and records read by job group."""
    rng = random.Random(1)
    record = lambda g, i, alphabet: f">{g}|c{i:05d}\n{''.join(rng.choices(alphabet, k=700))}\n"
    nt = write(tmp_path, "nt.fna", "".join(record(f"g{i % 6:02d}", i, "ACGT") for i in range(3000)))
    aa = write(tmp_path, "aa.faa", "".join(record(f"g{i % 6:02d}", i + 5000, "MKVLWHE") for i in range(1500)))
    meta = write(tmp_path, "m.tsv", metadata({f"g{i:02d}": 1 for i in range(5)}))  # g05 is unknown
    log, lake = str(tmp_path / "log"), str(tmp_path / "lake")
    os.makedirs(log)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = EVENTS.format(root=root, log=log, meta=meta, nt=nt, aa=aa, lake=lake)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "'records_read': 4500, 'records_written': 3750, 'records_skipped': 750" in done.stdout, done.stdout + done.stderr[-2000:]
    assert "absent 0" in done.stdout and "present 1" in done.stdout
    groups, read = {}, {}
    for path in glob.glob(f"{log}/**/*", recursive=True):
        if not os.path.isfile(path) or not os.path.basename(path).startswith(("local-", "events_")):
            continue
        for line in open(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerStageSubmitted":
                groups[e["Stage Info"]["Stage ID"]] = e["Properties"].get("spark.jobGroup.id")
            elif e["Event"] == "SparkListenerTaskEnd":
                m = e["Task Metrics"]["Input Metrics"]
                old = read.get(groups[e["Stage ID"]], (0, 0))
                read[groups[e["Stage ID"]]] = (old[0] + m["Bytes Read"], old[1] + m["Records Read"])
    size = os.path.getsize(nt) + os.path.getsize(aa)
    assert size <= read["ingest"][0] < 1.15 * size  # the files once, and the small metadata file
    stored = sum(os.path.getsize(p) for p in glob.glob(f"{lake}/**/*.parquet", recursive=True))
    assert read["absent"][1] == 0 < read["present"][1]  # no row group is read for an id that none has
    assert read["absent"][0] < 0.1 * stored


@pytest.mark.parametrize("core", [1, 7, 64, 1 << 20])
def test_chunks_count_as_the_whole_sequences(spark, tmp_path, core):
    rng = random.Random(core)
    seqs = [(f"s{i}", "g" + str(i % 3), "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.choice([0, 1, 3, 4, 5, 30, 64, 65, 400])))) for i in range(60)]
    seqs += [("none", "g0", None), ("hot", "g1", "".join(rng.choices("ACGT", k=3000)))]
    df = spark.createDataFrame(seqs, "gid string, dataset_id string, sequence string")
    path = f"{tmp_path}/chunks"
    CH.write_chunks(df, path, ["gid", "dataset_id"], core=core)
    chunks = spark.read.parquet(path)
    if core == 7:  # a long sequence is spread over tasks (small ones are joined here, so they are counted before)
        dealt = CH.cut_chunks(df, ["gid", "dataset_id"], core=core).repartition(8, "gid", "dataset_id", "place")
        assert dealt.where("gid = 'hot'").select(F.spark_partition_id()).distinct().count() == 8
    for k in (1, 4, 9):
        assert rows(CH.kmer_counts(chunks, k)) == rows(K.kmer_counts(df, k))
    assert rows(CH.tnf_136(chunks)) == rows(K.tnf_136(df))
    assert rows(CH.tnf_136(chunks, "dataset_id")) == rows(K.genome_tnf(df))
    with pytest.raises(ValueError, match="overlap"):
        CH.kmer_counts(chunks, 32)


@pytest.mark.parametrize("core", [40, 1000])
@pytest.mark.parametrize("split", ["512", "3000", "134217728"])
def test_fasta_chunks_at_any_split_size(spark, tmp_path, core, split):
    rng = random.Random(3)
    wrap = lambda s, n: "\n".join(s[i:i + n] for i in range(0, len(s), n))
    records = [(f"r{i}", "".join(rng.choices("ACGT", k=rng.choice([0, 5, 80, 700])))) for i in range(30)] + [
        ("long", "".join(rng.choices("ACGT", k=20_000))), ("same", "ACGTAC" * 9), ("last", "TTTT")]
    folder = tmp_path / "fa"
    folder.mkdir()
    text = "".join(f">{t} words\r\n{wrap(s, 60)}\n" for t, s in records)
    (folder / "a.fa").write_text(text)
    (folder / "b.fa").write_text(">other\n" + wrap("GGCC" * 500, 70) + "\n>empty\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        chunks = CH.read_fasta_chunks(spark, str(folder), core=core, overlap=8)
        whole = files.read_fasta(spark, str(folder)).select("record_id", "sequence")
        got = {}
        for r in chunks.orderBy("record_id", "place").collect():
            place, so_far = got.get(r.record_id, (0, ""))
            assert r.place == place and len(r.sequence) <= r.core + 8 and (r.core <= 2 * core)
            got[r.record_id] = (place + r.core, so_far + r.sequence[:r.core])
        assert {k: v[1] for k, v in got.items()} == {r.record_id: r.sequence for r in whole.collect()}
        assert rows(CH.kmer_counts(chunks, 5, "record_id", overlap=8)) == rows(K.kmer_counts(whole, 5, "record_id"))
        if split == "512" and core == 40:
            assert chunks.where("record_id = 'long'").count() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
