"""K-mer, TNF, nearest-neighbour, search, hits and placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as CH
from ..operators import hits as H
from ..operators import kmers as K
from ..operators import placement as P
from ..operators import metric_index as MI
from ..operators import search as SR
from ..operators import similarity as SIM
from ..operators import tables as T
from ..operators.common import stored
from ..operators.seed_index import SeedIndex, build_seed_index
from ..session import scratch_path
from ..sources import surrogate as sg
from .ingest_queries import PARSED_SQL
from .registry import query

CAT = ("catalogue",)


def tnf_ctes(name: str, src: str, id_col: str) -> str:
    """DuckDB CTEs producing ``{name}_tnf(id, idx, value REAL)`` (dense, 136 per id)."""
    return f"""
{name}_occ AS (
  SELECT {id_col} AS id, substr(sequence, p, 4) AS kmer
  FROM (SELECT {id_col}, sequence, unnest(generate_series(1, length(sequence) - 3)) AS p FROM {src})
),
{name}_cc AS (SELECT o.id, i.idx, COUNT(*) AS n FROM {name}_occ o JOIN kmer_index i ON o.kmer = i.kmer GROUP BY 1, 2),
{name}_tot AS (SELECT id, SUM(n) AS total FROM {name}_cc GROUP BY id),
{name}_ids AS (SELECT DISTINCT {id_col} AS id FROM {src}),
{name}_tnf AS (
  SELECT g.id, r.idx,
         CAST(CASE WHEN COALESCE(t.total, 0) > 0 THEN CAST(COALESCE(c.n, 0) AS DOUBLE) / t.total ELSE 0.0 END AS REAL) AS value
  FROM {name}_ids g CROSS JOIN (SELECT range AS idx FROM range(136)) r
  LEFT JOIN {name}_cc c ON c.id = g.id AND c.idx = r.idx
  LEFT JOIN {name}_tot t ON t.id = g.id
)"""


LONGEST_SQL = """
lc AS (
  SELECT dataset_id, gid, length AS contig_length FROM (
    SELECT dataset_id, gid, length,
           row_number() OVER (PARTITION BY dataset_id ORDER BY length DESC, gid) AS rn
    FROM catalogue WHERE seq_type = 'NT') WHERE rn = 1
),
lc_seq AS (SELECT c.gid, c.sequence FROM catalogue c JOIN lc USING (gid)),
gmeta AS (SELECT DISTINCT dataset_id, lenbp, gcperc, common_name, phylum, "order", taxonomy_majority, s_cluster, skani_rep
          FROM catalogue)"""

PAIR_SQL = """
pairs AS (
  SELECT q.id AS query_id, c.id AS cand,
         SUM(CAST(q.value AS DOUBLE) * CAST(c.value AS DOUBLE)) AS dot,
         sqrt(SUM(CAST(q.value AS DOUBLE) * CAST(q.value AS DOUBLE))) AS nq,
         sqrt(SUM(CAST(c.value AS DOUBLE) * CAST(c.value AS DOUBLE))) AS nc,
         sqrt(SUM((CAST(q.value AS DOUBLE) - CAST(c.value AS DOUBLE)) * (CAST(q.value AS DOUBLE) - CAST(c.value AS DOUBLE)))) AS eu
  FROM q_tnf q JOIN c_tnf c ON q.idx = c.idx GROUP BY 1, 2
)"""

COS = "CASE WHEN nq = 0 OR nc = 0 THEN 1.0 ELSE 1.0 - dot / (nq * nc) END"


def _nearest_tnf_sql(metric: str) -> str:
    dist = COS if metric == "cosine" else "eu"
    return f"""
WITH {LONGEST_SQL.strip()},
qsrc AS (SELECT dataset_id, sequence FROM catalogue WHERE seq_type = 'NT'),
{tnf_ctes('q', 'qsrc', 'dataset_id').strip()},
{tnf_ctes('c', 'lc_seq', 'gid').strip()},
{PAIR_SQL.strip()},
scored AS (
  SELECT p.query_id, lc.dataset_id, lc.gid, lc.contig_length, {dist} AS d
  FROM pairs p JOIN lc ON lc.gid = p.cand
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, dataset_id) AS rank FROM scored)
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.dataset_id, r.gid, r.contig_length, m.lenbp, m.gcperc,
       m.common_name, m.phylum, m."order", m.taxonomy_majority, m.s_cluster, m.skani_rep,
       round(greatest(r.d, 0.0), 6) AS tnf_distance
FROM ranked r JOIN gmeta m USING (dataset_id) WHERE r.rank <= 10"""


def _nearest_tnf(spark, d, metric, nearest=P.nearest_by_tnf):
    """Every genome's vector against the longest contig of every genome."""
    c = sg.catalogue(spark, d)
    qv = K.genome_tnf(c.filter(F.col("seq_type") == "NT")).select(F.col("dataset_id").alias("query_id"), "tnf_136")
    r = nearest(qv, c, metric, 10)
    return r.select("query_id", "rank", "dataset_id", "gid", "contig_length", "lenbp", "gcperc", "common_name",
                    "phylum", "order", "taxonomy_majority", "s_cluster", "skani_rep",
                    F.round("tnf_distance", 6).alias("tnf_distance"))


@query("nearest_by_tnf_cosine", _nearest_tnf_sql("cosine"), CAT + ("kmer_index",))
def q_nn_cos(spark, d):
    return _nearest_tnf(spark, d, "cosine")


@query("nearest_by_tnf_euclidean", _nearest_tnf_sql("euclidean"), CAT + ("kmer_index",))
def q_nn_eu(spark, d):
    return _nearest_tnf(spark, d, "euclidean")


KMER_COUNTS_SQL = """
SELECT gid, kmer, CAST(COUNT(*) AS BIGINT) AS count FROM (
  SELECT gid, substr(sequence, p, 4) AS kmer
  FROM (SELECT gid, sequence, unnest(generate_series(1, length(sequence) - 3)) AS p FROM catalogue WHERE seq_type = 'NT')
) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY 1, 2"""


@query("kmer_counts", KMER_COUNTS_SQL, CAT)
def q_kmer_counts(spark, d):
    c = sg.catalogue(spark, d).filter(F.col("seq_type") == "NT")
    return K.kmer_counts(c, 4)


TNF_SQL = ("WITH " + PARSED_SQL.strip() + ",\nnt AS (SELECT gid, sequence FROM parsed WHERE seq_type = 'NT'),\n"
       + tnf_ctes("t", "nt", "gid").strip() + """
SELECT id AS gid, CAST(idx AS INTEGER) AS idx, round(CAST(value AS DOUBLE), 6) AS value FROM t_tnf""")


@query("tnf_136", TNF_SQL, ("raw_records", "kmer_index"))
def q_tnf(spark, d):
    from ..operators import ingest as ing
    p = ing.parse_records(sg.raw_records(spark, d), "record_id", "raw_sequence").filter(F.col("seq_type") == "NT")
    return K.tnf_long(K.tnf_136(p.select("gid", "sequence")), "gid")


def _chunked(spark, seqs, id_col):
    """The stored chunk table of the sequences; a small core cuts every record."""
    path = scratch_path(spark, "chunks")
    CH.write_chunks(seqs, path, [id_col], core=500)
    return spark.read.parquet(path)


@query("kmer_counts_chunked", KMER_COUNTS_SQL, CAT)
def q_kmer_counts_chunked(spark, d):
    c = sg.catalogue(spark, d).filter(F.col("seq_type") == "NT")
    return CH.kmer_counts(_chunked(spark, c, "gid"), 4)


@query("tnf_136_chunked", TNF_SQL, ("raw_records", "kmer_index"))
def q_tnf_chunked(spark, d):
    from ..operators import ingest as ing
    p = ing.parse_records(sg.raw_records(spark, d), "record_id", "raw_sequence").filter(F.col("seq_type") == "NT")
    return K.tnf_long(CH.tnf_136(_chunked(spark, p, "gid")), "gid")


@query("genome_tnf", "WITH nt AS (SELECT dataset_id, gid, sequence FROM catalogue WHERE seq_type = 'NT'),\n"
       + tnf_ctes("t", "nt", "dataset_id").strip() + """
SELECT id AS dataset_id, CAST(idx AS INTEGER) AS idx, round(CAST(value AS DOUBLE), 6) AS value FROM t_tnf""",
       CAT + ("kmer_index",))
def q_genome_tnf(spark, d):
    c = sg.catalogue(spark, d).filter(F.col("seq_type") == "NT")
    return K.tnf_long(K.genome_tnf(c), "dataset_id")


@query("longest_contig", "WITH " + LONGEST_SQL.strip() + "\nSELECT dataset_id, gid, contig_length FROM lc", CAT)
def q_longest(spark, d):
    return SIM.longest_contig(sg.catalogue(spark, d))


NEAREST_EMBEDDING_SQL = """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS idx FROM embeddings),
q AS (SELECT vec_id AS id, idx, v AS value FROM e WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS id, idx, v AS value FROM e),
pairs AS (
  SELECT q.id AS query_id, c.id AS cand,
         SUM(CAST(q.value AS DOUBLE) * CAST(c.value AS DOUBLE)) AS dot,
         sqrt(SUM(CAST(q.value AS DOUBLE) * CAST(q.value AS DOUBLE))) AS nq,
         sqrt(SUM(CAST(c.value AS DOUBLE) * CAST(c.value AS DOUBLE))) AS nc
  FROM q JOIN c ON q.idx = c.idx WHERE q.id <> c.id GROUP BY 1, 2
),
ranked AS (SELECT query_id, cand, CASE WHEN nq = 0 OR nc = 0 THEN 1.0 ELSE 1.0 - dot / (nq * nc) END AS d,
                  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nq = 0 OR nc = 0 THEN 1.0 ELSE 1.0 - dot / (nq * nc) END, cand) AS rank
           FROM pairs)
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.cand AS vec_id, e.label, round(r.d, 6) AS distance
FROM ranked r JOIN (SELECT DISTINCT vec_id, label FROM embeddings) e ON e.vec_id = r.cand WHERE r.rank <= 10"""


def _embeddings(spark, d):
    """(queries, candidates): every vector whose id is divisible by 100, and all vectors."""
    e = sg.table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.select("vec_id", "label", F.col("embedding").alias("vector"))


def _embedding_rows(found):
    r = SIM.without_self(found, 10, "query_id", "vec_id", "distance", ("vec_id",))
    return r.select("query_id", "rank", "vec_id", "label", F.round("distance", 6).alias("distance"))


@query("nearest_embedding", NEAREST_EMBEDDING_SQL)
def q_nn_embed(spark, d):
    q, c = _embeddings(spark, d)
    return _embedding_rows(SIM.nearest(q, c, k=11, metric="cosine", order_cols=("vec_id",)))


@query("nearest_embedding_indexed", NEAREST_EMBEDDING_SQL)
def q_nn_embed_indexed(spark, d):
    """The same neighbours from a stored metric index."""
    q, c = _embeddings(spark, d)
    root = scratch_path(spark, "embedding-index")
    MI.build_index(c, root, "cosine", page_rows=2000)
    return _embedding_rows(MI.nearest_indexed(q, root, k=11, order_cols=("vec_id",)))


def _tnf_through_index(spark):
    def nearest(vectors, seqs, metric, k):
        root = scratch_path(spark, "tnf-index")
        MI.build_index(P.tnf_candidates(seqs), root, metric, vec_col="tnf_136", page_rows=2000)
        return P.nearest_by_tnf(vectors, None, metric, k, index=root)
    return nearest


@query("nearest_by_tnf_indexed", _nearest_tnf_sql("euclidean"), CAT + ("kmer_index",))
def q_nn_tnf_indexed(spark, d):
    """Genomes against a stored index of the longest contigs' vectors."""
    return _nearest_tnf(spark, d, "euclidean", _tnf_through_index(spark))


# ------------------------------------------------------------------ ANI / seeds

def _code_sql(expr_char, k: int) -> str:
    terms = f"list_transform(range({k}), lambda i: CAST({expr_char} AS UBIGINT) * CAST(pow(4, {k - 1} - i) AS UBIGINT))"
    return f"CAST(list_sum({terms}) AS UBIGINT)"


def _sketch_sql(k: int = 16, c: int = 1000) -> str:
    fwd = _code_sql("strpos('ACGT', substr(kmer, i + 1, 1)) - 1", k)
    rev = _code_sql(f"4 - strpos('ACGT', substr(kmer, {k} - i, 1))", k)
    return f"""
sk_occ AS (
  SELECT dataset_id AS owner, substr(sequence, p, {k}) AS kmer
  FROM (SELECT dataset_id, sequence, unnest(generate_series(1, length(sequence) - {k - 1})) AS p
        FROM catalogue WHERE seq_type = 'NT')
),
sk_code AS (SELECT owner, least({fwd}, {rev}) AS code FROM sk_occ WHERE regexp_full_match(kmer, '[ACGT]+')),
sk_h1 AS (SELECT owner, code, xor(code, code >> 32) & CAST(4294967295 AS UBIGINT) AS h FROM sk_code),
sk_h2 AS (SELECT owner, code, xor(h, h >> 16) AS h FROM sk_h1),
sk_h3 AS (SELECT owner, code, (h * CAST(2246822507 AS UBIGINT)) % CAST(4294967296 AS UBIGINT) AS h FROM sk_h2),
sk_h4 AS (SELECT owner, code, xor(h, h >> 13) AS h FROM sk_h3),
sk_h5 AS (SELECT owner, code, (h * CAST(3266489909 AS UBIGINT)) % CAST(4294967296 AS UBIGINT) AS h FROM sk_h4),
sk_h6 AS (SELECT owner, code, xor(h, h >> 16) AS h FROM sk_h5),
ref_sk AS (SELECT DISTINCT owner, code FROM sk_h6 WHERE h < {(1 << 32) // c}),
q_sk AS (SELECT * FROM ref_sk),
qn AS (SELECT owner, COUNT(*) AS n FROM q_sk GROUP BY owner),
rn AS (SELECT owner, COUNT(*) AS n FROM ref_sk GROUP BY owner),
shared AS (SELECT q.owner AS query_id, r.owner AS dataset_id, COUNT(*) AS shared
           FROM q_sk q JOIN ref_sk r ON q.code = r.code GROUP BY 1, 2),
ani AS (
  SELECT s.query_id, s.dataset_id, CAST(s.shared AS BIGINT) AS shared, CAST(qn.n AS BIGINT) AS query_kmers,
         CAST(rn.n AS BIGINT) AS ref_kmers, CAST(s.shared AS DOUBLE) / qn.n AS containment,
         100.0 * pow(CAST(s.shared AS DOUBLE) / qn.n, 1.0 / {k}) AS ani
  FROM shared s JOIN qn ON qn.owner = s.query_id JOIN rn ON rn.owner = s.dataset_id
)"""


def _query_genomes(spark, d):
    """Every genome is a query."""
    c = sg.catalogue(spark, d)
    q = c.filter(F.col("seq_type") == "NT").select(F.col("dataset_id").alias("query_id"), "gid", "sequence")
    return c, q


def _stored_genomes(spark, d):
    """The nucleotide records of the catalogue, derived from the driver's texts once; every genome is a query."""
    c = sg.catalogue(spark, d).filter(F.col("seq_type") == "NT")
    nt = stored(c.select("dataset_id", "gid", "seq_type", "length", "sequence", *P.META_COLS), "nt-records")
    return nt, nt.select(F.col("dataset_id").alias("query_id"), "gid", "sequence")


@query("ani_estimate", "WITH " + _sketch_sql().strip() + """
SELECT query_id, dataset_id, shared, query_kmers, ref_kmers, round(containment, 6) AS containment, round(ani, 6) AS ani
FROM ani WHERE ani >= 80""", CAT)
def q_ani(spark, d):
    c, q = _stored_genomes(spark, d)
    refs = c.select("dataset_id", "sequence")
    r = SR.ani_estimate(q, refs, 16, 1000, 80.0)
    return r.withColumn("containment", F.round("containment", 6)).withColumn("ani", F.round("ani", 6))


@query("ani_estimate_stored", "WITH " + _sketch_sql().strip() + """
SELECT query_id, dataset_id, shared, query_kmers, ref_kmers, round(containment, 6) AS containment, round(ani, 6) AS ani
FROM ani WHERE ani >= 80""", CAT)
def q_ani_stored(spark, d):
    """Against a stored, co-partitioned sketch with heavy codes split."""
    c, q = _query_genomes(spark, d)
    path = scratch_path(spark, "stored-sketch")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    SR.store_sketch(c.filter(F.col("seq_type") == "NT").select("dataset_id", "sequence"), path, buckets=buckets, code_owners=8)
    r = SR.ani_estimate(q, None, 16, 1000, 80.0, ref_sketch=SR.StoredSketch(spark, path))
    return r.withColumn("containment", F.round("containment", 6)).withColumn("ani", F.round("ani", 6))


@query("compare_tnf_ani", "WITH " + LONGEST_SQL.strip() + ",\n"
       + "qsrc AS (SELECT dataset_id, gid, sequence FROM catalogue WHERE seq_type = 'NT'),\n"
       + tnf_ctes("q", "qsrc", "dataset_id").strip() + ",\n" + tnf_ctes("c", "lc_seq", "gid").strip() + ",\n"
       + PAIR_SQL.strip() + ",\n" + _sketch_sql().strip() + f""",
scored AS (SELECT p.query_id, lc.dataset_id, {COS} AS d FROM pairs p JOIN lc ON lc.gid = p.cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, dataset_id) AS rank FROM scored)
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.dataset_id, round(greatest(r.d, 0.0), 6) AS tnf_distance,
       round(a.ani, 6) AS ani, round(a.containment, 6) AS containment
FROM ranked r LEFT JOIN ani a ON a.query_id = r.query_id AND a.dataset_id = r.dataset_id
WHERE r.rank <= 10""", CAT + ("kmer_index",))
def q_compare(spark, d):
    c, q = _stored_genomes(spark, d)
    qv = K.genome_tnf(q, genome_col="query_id")
    tn = P.nearest_by_tnf(qv, c, "cosine", 10).select("query_id", "rank", "dataset_id", "tnf_distance")
    refs = c.select("dataset_id", "sequence")
    ani = SR.ani_estimate(q.select("query_id", "sequence"), refs, 16, 1000, None)
    out = SIM.compare_tnf_ani(tn, ani)
    return out.select("query_id", "rank", "dataset_id", F.round("tnf_distance", 6).alias("tnf_distance"),
                      F.round("ani", 6).alias("ani"), F.round("containment", 6).alias("containment"))


PLACE_SQL = ("WITH " + LONGEST_SQL.strip() + ",\n"
       + "qsrc AS (SELECT dataset_id, gid, sequence FROM catalogue WHERE seq_type = 'NT'),\n"
       + tnf_ctes("q", "qsrc", "dataset_id").strip() + ",\n" + tnf_ctes("c", "lc_seq", "gid").strip() + ",\n"
       + PAIR_SQL.strip() + ",\n" + _sketch_sql().strip() + f""",
scored AS (SELECT p.query_id, lc.dataset_id, {COS} AS d FROM pairs p JOIN lc ON lc.gid = p.cand
           WHERE lc.dataset_id <> p.query_id),
tbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, dataset_id) AS rn FROM scored) WHERE rn = 1),
abest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ani DESC, dataset_id) AS rn
                         FROM ani WHERE ani >= 80 AND dataset_id <> query_id) WHERE rn = 1),
qs AS (SELECT DISTINCT dataset_id AS query_id FROM qsrc)
SELECT qs.query_id, t.dataset_id AS tnf_top_match, round(greatest(t.d, 0.0), 6) AS tnf_distance,
       m.taxonomy_majority AS tnf_taxonomy, round(1.0 - greatest(t.d, 0.0), 6) AS tnf_similarity,
       a.dataset_id AS ani_top_match, round(a.ani, 6) AS ani, am.s_cluster AS ani_cluster,
       CASE WHEN a.ani IS NULL THEN 'no close ANI match - likely novel lineage'
            WHEN a.ani >= 95 THEN 'species-level match' WHEN a.ani >= 90 THEN 'genus-level similarity'
            ELSE 'distant relationship' END AS placement
FROM qs LEFT JOIN tbest t ON t.query_id = qs.query_id LEFT JOIN gmeta m ON m.dataset_id = t.dataset_id
LEFT JOIN abest a ON a.query_id = qs.query_id LEFT JOIN gmeta am ON am.dataset_id = a.dataset_id""")


@query("place_genome", PLACE_SQL, CAT + ("kmer_index",))
def q_place(spark, d):
    c, q = _stored_genomes(spark, d)
    return _placed(P.place_genome(q, c, "cosine", k=20, min_ani=80.0, exclude_self=True))


def _placed(found):
    return found.select("query_id", "tnf_top_match", F.round("tnf_distance", 6).alias("tnf_distance"), "tnf_taxonomy",
                        F.round("tnf_similarity", 6).alias("tnf_similarity"), "ani_top_match",
                        F.round("ani", 6).alias("ani"), "ani_cluster", "placement")


@query("place_genome_stored", PLACE_SQL, CAT + ("kmer_index",))
def q_place_stored(spark, d):
    """Placement from stored tables: genomes, contig vectors and a co-partitioned sketch; no reference record is read."""
    c, q = _query_genomes(spark, d)
    root = scratch_path(spark, "placement-tables")
    nt = c.filter(F.col("seq_type") == "NT")
    T.genome_table(c).write.parquet(f"{root}/genomes")
    K.add_tnf(nt.select("gid", "dataset_id", "seq_type", "length", "sequence")).drop("sequence").write.parquet(f"{root}/tnf")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    SR.store_sketch(nt.select("dataset_id", "sequence"), f"{root}/sketch", buckets=buckets)
    return _placed(P.place_genome(q, None, "cosine", k=20, min_ani=80.0, exclude_self=True, genomes=spark.read.parquet(f"{root}/genomes"),
                                  contigs=spark.read.parquet(f"{root}/tnf"), ref_sketch=SR.StoredSketch(spark, f"{root}/sketch")))


SEED_SQL = """
aa AS (SELECT gid, dataset_id, sequence FROM catalogue WHERE seq_type = 'AA'),
aa_k AS (
  SELECT DISTINCT gid, kmer FROM (
    SELECT gid, substr(sequence, p, 5) AS kmer
    FROM (SELECT gid, sequence, unnest(generate_series(1, length(sequence) - 4)) AS p FROM aa))
  WHERE regexp_full_match(kmer, '[ACDEFGHIKLMNPQRSTVWY]+')
),
q_k AS (SELECT gid AS q, kmer FROM aa_k WHERE CAST(regexp_extract(gid, '_([0-9]+)$', 1) AS BIGINT) % 100 = 0),
qn AS (SELECT q, COUNT(*) AS n FROM q_k GROUP BY q),
pairs AS (SELECT q.q, t.gid AS t, COUNT(*) AS shared FROM q_k q JOIN aa_k t ON q.kmer = t.kmer GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY shared DESC, t) AS hit_rank FROM pairs),
seed AS (
  SELECT r.q AS query_id, r.t AS target_id, CAST(r.shared AS BIGINT) AS shared, CAST(qn.n AS BIGINT) AS query_kmers,
         round(CAST(r.shared AS DOUBLE) / qn.n, 6) AS containment, CAST(r.hit_rank AS INTEGER) AS hit_rank
  FROM ranked r JOIN qn USING (q) WHERE r.hit_rank <= 25
)"""
ALL_SEEDS = "WITH " + SEED_SQL.strip() + "\nSELECT * FROM seed"


def _seed_queries(aa):
    """Every protein whose document's id is divisible by 100."""
    number = F.regexp_extract("gid", "_([0-9]+)$", 1).cast("long")
    return aa.filter(number % 100 == 0).select(F.col("gid").alias("query_id"), "sequence")


@query("protein_seed_search", ALL_SEEDS, CAT)
def q_seed(spark, d):
    c = sg.catalogue(spark, d).filter(F.col("seq_type") == "AA")
    r = SR.protein_seed_search(_seed_queries(c), c.select("gid", "sequence"), k=5, max_target_seqs=25)
    return r.withColumn("containment", F.round("containment", 6))


@query("protein_seed_search_indexed", ALL_SEEDS, CAT)
def q_seed_indexed(spark, d):
    """The same targets from a stored inverted index."""
    c = sg.catalogue(spark, d).filter(F.col("seq_type") == "AA")
    root = scratch_path(spark, "seed-index")
    build_seed_index(c.select("gid", "sequence"), root, k=5)
    r, _ = SeedIndex(spark, root).search(_seed_queries(c), max_target_seqs=25)
    return r.withColumn("containment", F.round("containment", 6))


# ------------------------------------------------------------------ hits

HIT_COLS = "qseqid, sseqid, pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore"


@query("hits_evalue_filter", f"SELECT {HIT_COLS} FROM protein_hits WHERE evalue <= 1e-5", ("protein_hits",))
def q_evalue(spark, d):
    return H.evalue_filter(sg.protein_hits(spark, d), 1e-5)


@query("hits_ani_filter", 'SELECT * FROM ani_hits WHERE "ANI" >= 80', ("ani_hits",))
def q_ani_filter(spark, d):
    return H.ani_filter(sg.ani_hits(spark, d), 80.0)


@query("top_hits_per_query", f"""
SELECT {HIT_COLS}, CAST(hit_rank AS INTEGER) AS hit_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) AS hit_rank FROM protein_hits
) WHERE hit_rank <= 5""", ("protein_hits",))
def q_top_hits(spark, d):
    return H.top_hits_per_query(sg.protein_hits(spark, d), 5)


@query("hit_summary", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_hits, CAST(COUNT(DISTINCT qseqid) AS BIGINT) AS queries FROM protein_hits""",
       ("protein_hits",))
def q_hit_summary(spark, d):
    return H.hit_summary(sg.protein_hits(spark, d))


@query("enrich_protein_hits", f"""
SELECT h.*, m.dataset_id, m.length AS target_length, m.common_name, m.phylum, m."class", m."order", m.family,
       m.genus, m.ecosystem, m.habitat
FROM protein_hits h LEFT JOIN catalogue m ON m.gid = h.sseqid""", CAT + ("protein_hits",))
def q_enrich_protein(spark, d):
    return H.enrich_protein_hits(sg.protein_hits(spark, d), sg.catalogue(spark, d), "sseqid")


@query("enrich_hmm_hits", """
SELECT h.*, m.dataset_id, m.length AS target_length, m.common_name, m.phylum, m."class", m."order", m.family,
       m.genus, m.ecosystem, m.habitat
FROM hmm_hits h LEFT JOIN (SELECT * FROM catalogue WHERE seq_type = 'AA') m ON m.gid = h.target_name
WHERE h.evalue <= 1e-5""", CAT + ("hmm_hits",))
def q_enrich_hmm(spark, d):
    h = H.evalue_filter(sg.hmm_hits(spark, d), 1e-5)
    return H.enrich_protein_hits(h, sg.catalogue(spark, d), "target_name", seq_type="AA")


# Genome columns of annotated ANI results.
ANI_META = ["common_name", "phylum", "class", "order", "family", "genus", "gvclass_phylum", "gvclass_class",
            "gvclass_order", "gvclass_family", "gvclass_genus", "gvclass_species", "taxonomy_majority", "s_cluster",
            "skani_rep", "pdm_cluster", "mcl_rep", "lenbp", "gcperc", "genecount", "order_completeness",
            "order_confidence_score", "ecosystem", "habitat"]
ANI_META_SQL = ", ".join(f'g."{c}"' for c in ANI_META)
GMETA_SQL = "(SELECT DISTINCT dataset_id, " + ", ".join(f'"{c}"' for c in ANI_META) + " FROM catalogue)"


@query("enrich_ani_hits", f"""
SELECT h.*, split_part(h."Ref_name", '|', 1) AS dataset_id, {ANI_META_SQL}
FROM ani_hits h LEFT JOIN {GMETA_SQL} g ON g.dataset_id = split_part(h."Ref_name", '|', 1)
WHERE h."ANI" >= 80""", CAT + ("ani_hits",))
def q_enrich_ani(spark, d):
    return H.enrich_ani_hits(sg.ani_hits(spark, d), sg.catalogue(spark, d), 80.0, ANI_META)


@query("order_by_ani", f"""
SELECT h.*, split_part(h."Ref_name", '|', 1) AS dataset_id, {ANI_META_SQL}
FROM ani_hits h LEFT JOIN {GMETA_SQL} g ON g.dataset_id = split_part(h."Ref_name", '|', 1)
WHERE h."ANI" >= 80 ORDER BY h."ANI" DESC, h."Query_name", h."Ref_name" LIMIT 200""", CAT + ("ani_hits",))
def q_order_by_ani(spark, d):
    """The 200 best ANI hits (a top-k report)."""
    return H.enrich_ani_hits(sg.ani_hits(spark, d), sg.catalogue(spark, d), 80.0, ANI_META, max_results=200)


@query("cluster_hit_counts", f"""
SELECT g.s_cluster, CAST(COUNT(*) AS BIGINT) AS hits
FROM ani_hits h LEFT JOIN {GMETA_SQL} g ON g.dataset_id = split_part(h."Ref_name", '|', 1)
WHERE h."ANI" >= 80 AND g.s_cluster IS NOT NULL GROUP BY 1 ORDER BY hits DESC, s_cluster LIMIT 5""",
       CAT + ("ani_hits",))
def q_cluster_hits(spark, d):
    e = H.enrich_ani_hits(sg.ani_hits(spark, d), sg.catalogue(spark, d), 80.0, ANI_META)
    return H.cluster_hit_counts(e, 5)


def _mode_sql(col: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT "Query_name", {col}, COUNT(*) AS n FROM e WHERE "ANI" >= 95 AND {col} IS NOT NULL GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Query_name" ORDER BY n DESC, {col}) AS rn
                          FROM {name}_c) WHERE rn = 1)"""


@query("cluster_membership", f"""
WITH e AS (
  SELECT h.*, split_part(h."Ref_name", '|', 1) AS dataset_id, {ANI_META_SQL}
  FROM ani_hits h LEFT JOIN {GMETA_SQL} g ON g.dataset_id = split_part(h."Ref_name", '|', 1)
  WHERE h."ANI" >= 80
),
t AS (SELECT "Query_name", COUNT(*) AS total_hits, COUNT(*) FILTER (WHERE "ANI" >= 95) AS species_level_matches
      FROM e GROUP BY 1),
b AS (SELECT * FROM (SELECT "Query_name", "ANI", dataset_id, "Ref_name",
                            row_number() OVER (PARTITION BY "Query_name" ORDER BY "ANI" DESC, "Ref_name") AS rn FROM e)
      WHERE rn = 1),
{_mode_sql('s_cluster', 'scm').strip()},
{_mode_sql('pdm_cluster', 'pcm').strip()},
rep AS (SELECT * FROM (SELECT "Query_name", skani_rep,
                              row_number() OVER (PARTITION BY "Query_name" ORDER BY "ANI" DESC, "Ref_name") AS rn
                       FROM e WHERE "ANI" >= 95) WHERE rn = 1)
SELECT t."Query_name", CAST(t.total_hits AS BIGINT) AS total_hits,
       CAST(t.species_level_matches AS BIGINT) AS species_level_matches,
       b."ANI" AS top_match_ani, b.dataset_id AS top_match_genome, b."Ref_name" AS top_match_ref,
       scm.s_cluster AS likely_species_cluster, CAST(scm.n AS BIGINT) AS species_cluster_genomes,
       rep.skani_rep AS cluster_representative, pcm.pdm_cluster AS phylogenetic_cluster,
       CASE WHEN t.species_level_matches = 0
            THEN 'No species-level matches (>=95% ANI). Top hit: ' || printf('%.2f', b."ANI") || '%' END AS message
FROM t JOIN b USING ("Query_name") LEFT JOIN scm USING ("Query_name") LEFT JOIN pcm USING ("Query_name")
LEFT JOIN rep USING ("Query_name")""", CAT + ("ani_hits",))
def q_membership(spark, d):
    e = H.enrich_ani_hits(sg.ani_hits(spark, d), sg.catalogue(spark, d), 80.0, ANI_META)
    return H.cluster_membership(e, 95.0)


@query("extract_hits", """
SELECT gid, dataset_id, header, seq_type, length, round(CAST(gc_content AS DOUBLE), 6) AS gc_content, sequence, genome,
       common_name, phylum, "class", "order", family, genus, s_cluster, ecosystem, ecosystem_category, ecosystem_type,
       habitat, lenbp, gcperc, genecount
FROM catalogue WHERE gid IN (SELECT sseqid FROM protein_hits)""", CAT + ("protein_hits",))
def q_extract_hits(spark, d):
    out = H.extract_hits(sg.protein_hits(spark, d), sg.catalogue(spark, d), "sseqid")
    return out.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


EXTRACT_IDS = ["src0|src0_0", "src5|src5_5", "src3|src3_23", "src7|src7_47", "missing|nothing_1"]


@query("extract_gids", """
SELECT gid, dataset_id, header, seq_type, length, round(CAST(gc_content AS DOUBLE), 6) AS gc_content, sequence
FROM catalogue WHERE gid IN ('src0|src0_0', 'src5|src5_5', 'src3|src3_23', 'src7|src7_47', 'missing|nothing_1')""", CAT)
def q_extract_gids(spark, d):
    r = H.extract_gids(sg.catalogue(spark, d), EXTRACT_IDS)
    return r.withColumn("gc_content", F.round(F.col("gc_content").cast("double"), 6))


@query("export_counts", """
SELECT dataset_id, CAST(COUNT(*) AS BIGINT) AS sequences FROM catalogue WHERE seq_type = 'AA' GROUP BY 1""", CAT)
def q_export_counts(spark, d):
    return H.export_counts(sg.catalogue(spark, d), "AA")


@query("seed_search_with_metadata", "WITH " + SEED_SQL.strip() + """
SELECT s.*, m.dataset_id, m.length AS target_length, m.common_name, m.phylum, m."class", m."order", m.family,
       m.genus, m.ecosystem, m.habitat
FROM seed s LEFT JOIN (SELECT * FROM catalogue WHERE seq_type = 'AA') m ON m.gid = s.target_id""", CAT)
def q_seed_meta(spark, d):
    c = sg.catalogue(spark, d)
    aa = c.filter(F.col("seq_type") == "AA")
    q = _seed_queries(aa)
    hits = SR.protein_seed_search(q, aa.select("gid", "sequence"), k=5, max_target_seqs=25) \
        .withColumn("containment", F.round("containment", 6))
    return H.seed_search_with_metadata(hits, c)


@query("ani_with_metadata", "WITH " + _sketch_sql().strip() + f"""
SELECT a.query_id, a.dataset_id, a.shared, a.query_kmers, a.ref_kmers, round(a.containment, 6) AS containment,
       round(a.ani, 6) AS ani, {ANI_META_SQL}
FROM ani a LEFT JOIN {GMETA_SQL} g ON g.dataset_id = a.dataset_id
WHERE a.ani >= 80""", CAT)
def q_ani_meta(spark, d):
    c, q = _query_genomes(spark, d)
    refs = c.filter(F.col("seq_type") == "NT").select("dataset_id", "sequence")
    ani = SR.ani_estimate(q, refs, 16, 1000, 80.0)
    out = H.ani_with_metadata(ani, c, ANI_META)
    return out.withColumn("containment", F.round("containment", 6)).withColumn("ani", F.round("ani", 6))
