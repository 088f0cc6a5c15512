"""DuckDB SQL for the catalogue tables, written independently of the Spark
DataFrame code in ``seqlake.sources.surrogate`` (same meaning, other engine).

``with_views(sql, *names)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

# every letter and digit of a text as one of a-z (see the surrogate's recoding)
LETTERS_SQL = r"""regexp_replace(translate(lower(regexp_replace(text, '[\x00-\x20\x7f\p{P}\p{S}\p{Z}]', '', 'g')),
  '0123456789àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß', 'adeghiklmnaaaaaaaceeeeiiiinooooooouuuuyys'), '[^a-z]', 'x', 'g')"""

GENOMES = """
genomes AS (
  SELECT concat('src', CAST(n_nationkey AS VARCHAR)) AS dataset_id,
         concat('src', CAST(n_nationkey AS VARCHAR)) AS genome,
         concat('genome ', n_name) AS common_name,
         CASE WHEN n_nationkey % 7 = 6 THEN '' ELSE 'Viruses' END AS domain,
         r_name AS phylum,
         concat('C', CAST(n_nationkey % 3 AS VARCHAR)) AS "class",
         CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE n_name END AS "order",
         CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE concat('F', CAST(n_nationkey % 5 AS VARCHAR)) END AS family,
         concat('G', CAST(n_nationkey % 8 AS VARCHAR)) AS genus,
         CASE WHEN n_nationkey % 6 = 5 THEN 'unclassified'
              WHEN n_nationkey % 6 = 4 THEN NULL
              WHEN n_nationkey % 6 = 3 THEN concat('d_', r_name, ';o_NA')
              ELSE concat('d_', r_name, ';p_', r_name, ';c_C', CAST(n_nationkey % 3 AS VARCHAR),
                          ';o_', n_name, ';f_F', CAST(n_nationkey % 5 AS VARCHAR),
                          ';g_G', CAST(n_nationkey % 8 AS VARCHAR), ';s_S', CAST(n_nationkey % 9 AS VARCHAR))
         END AS taxonomy_majority,
         CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE concat('sp', CAST(n_nationkey % 7 AS VARCHAR)) END AS gvclass_species,
         concat('G', CAST(n_nationkey % 8 AS VARCHAR)) AS gvclass_genus,
         CASE WHEN n_nationkey % 5 = 2 THEN NULL ELSE concat('F', CAST(n_nationkey % 5 AS VARCHAR)) END AS gvclass_family,
         n_name AS gvclass_order,
         concat('C', CAST(n_nationkey % 3 AS VARCHAR)) AS gvclass_class,
         r_name AS gvclass_phylum,
         concat('M', CAST(n_nationkey % 6 AS VARCHAR)) AS mcl_rep,
         CASE WHEN n_nationkey % 4 = 2 THEN NULL ELSE CAST(n_nationkey % 9 AS DOUBLE) / 8 END AS order_confidence_score,
         CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE concat('S', CAST(n_nationkey % 4 AS VARCHAR)) END AS s_cluster,
         concat('src', CAST(n_nationkey - n_nationkey % 2 AS VARCHAR)) AS skani_rep,
         n_nationkey % 2 = 0 AS is_skani_representative,
         concat('P', CAST(n_nationkey % 3 AS VARCHAR)) AS pdm_cluster,
         CASE n_nationkey % 4 WHEN 0 THEN 'Marine' WHEN 1 THEN 'Freshwater' WHEN 2 THEN '' ELSE NULL END AS ecosystem,
         CASE n_nationkey % 3 WHEN 0 THEN 'Aquatic' WHEN 1 THEN 'Terrestrial' ELSE NULL END AS ecosystem_category,
         concat('T', CAST(n_nationkey % 4 AS VARCHAR)) AS ecosystem_type,
         CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('U', CAST(n_nationkey % 2 AS VARCHAR)) END AS ecosystem_subtype,
         CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('H', CAST(n_nationkey % 4 AS VARCHAR)) END AS habitat,
         CASE WHEN n_nationkey % 2 = 0 THEN 'IMG' ELSE 'GenBank' END AS source,
         CAST(100000 + n_nationkey * 7919 AS BIGINT) AS lenbp,
         CAST(100 + n_nationkey * 3 AS BIGINT) AS genecount,
         CAST(1 + n_nationkey AS BIGINT) AS contigs,
         CAST(20 + n_nationkey AS DOUBLE) AS gcperc,
         CAST(80 + n_nationkey % 15 AS DOUBLE) AS codingperc,
         CAST(n_nationkey * 37 % 101 AS DOUBLE) AS order_completeness,
         CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE CAST(n_nationkey % 5 AS DOUBLE) / 4 END AS order_dup
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

SEQ_BASE = f"""
seq_base AS (
  SELECT concat(source, '|', source, '_', CAST(doc_id AS VARCHAR)) AS gid,
         source AS dataset_id,
         concat(source, '_', CAST(doc_id AS VARCHAR)) AS header,
         CASE WHEN doc_id // 20 % 5 = 0 THEN 'AA' ELSE 'NT' END AS seq_type,
         CASE WHEN doc_id // 20 % 5 = 0 THEN upper({LETTERS_SQL})
              ELSE translate({LETTERS_SQL},
                             'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') END AS sequence,
         CASE WHEN doc_id // 20 % 5 = 0 AND doc_id % 3 <> 0 THEN concat('OG', CAST(doc_id % 7 AS VARCHAR)) END AS orthogroup_id,
         CASE WHEN doc_id // 20 % 5 = 0 AND doc_id % 3 <> 0 THEN false
              WHEN doc_id // 20 % 5 = 0 AND doc_id % 2 = 0 THEN true END AS is_singleton,
         CASE WHEN doc_id // 20 % 5 = 0 AND doc_id % 4 <> 0 THEN upper(lang) END AS emapper_cog_category,
         CASE WHEN doc_id // 20 % 5 = 0 AND doc_id % 4 IN (1, 2)
              THEN concat('protein family ', CAST(doc_id % 13 AS VARCHAR)) END AS emapper_description,
         CASE WHEN doc_id // 20 % 5 = 0 AND doc_id % 3 <> 2
              THEN concat('PF', CAST(doc_id % 7 AS VARCHAR), ',PF', CAST(doc_id % 11 AS VARCHAR)) END AS emapper_pfams,
         CASE WHEN doc_id // 20 % 5 = 0 AND doc_id % 2 = 0 THEN concat('ko', CAST(doc_id % 9 AS VARCHAR)) END AS emapper_kegg_pathway
  FROM documents
)"""

SEQUENCES = """
sequences AS (
  SELECT *, CAST(length(sequence) AS INTEGER) AS length,
         CASE WHEN seq_type = 'NT' THEN
           CAST(CASE WHEN length(sequence) = 0 THEN 0.0
                     ELSE CAST(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) AS DOUBLE)
                          / length(sequence) * 100.0 END AS REAL) END AS gc_content
  FROM seq_base
)"""

CATALOGUE = """
catalogue AS (
  SELECT s.*, g.* EXCLUDE (dataset_id) FROM sequences s JOIN genomes g USING (dataset_id)
)"""

PROTEIN_HITS = """
protein_hits AS (
  SELECT concat('q', CAST(doc_id % 10 AS VARCHAR)) AS qseqid,
         CASE WHEN doc_id % 11 = 0 THEN concat('unknown|', CAST(doc_id AS VARCHAR))
              ELSE concat(source, '|', source, '_', CAST(doc_id AS VARCHAR)) END AS sseqid,
         CAST(30 + doc_id * 13 % 70 AS DOUBLE) AS pident,
         CAST(20 + doc_id * 17 % 500 AS INTEGER) AS length,
         CAST(doc_id % 7 AS INTEGER) AS mismatch,
         CAST(doc_id % 3 AS INTEGER) AS gapopen,
         CAST(1 AS INTEGER) AS qstart,
         CAST(20 + doc_id * 17 % 500 AS INTEGER) AS qend,
         CAST(1 + doc_id % 50 AS INTEGER) AS sstart,
         CAST(20 + doc_id * 17 % 500 + doc_id % 50 AS INTEGER) AS send,
         CASE WHEN doc_id % 4 = 0 THEN CAST(0.001 AS DOUBLE) ELSE CAST(1e-30 AS DOUBLE) END AS evalue,
         CAST(doc_id * 29 % 300 AS DOUBLE) AS bitscore
  FROM documents
)"""

ANI_HITS = """
ani_hits AS (
  SELECT 'query.fna' AS "Ref_file", 'refs.fna' AS "Query_file",
         CAST(76 + doc_id * 7 % 24 AS DOUBLE) AS "ANI",
         CAST(40 + doc_id % 60 AS DOUBLE) AS "Align_fraction_ref",
         CAST(50 + doc_id % 50 AS DOUBLE) AS "Align_fraction_query",
         CASE WHEN doc_id % 11 = 0 THEN concat('src9', CAST(doc_id % 5 AS VARCHAR), '|x_', CAST(doc_id AS VARCHAR))
              ELSE concat(source, '|', source, '_', CAST(doc_id AS VARCHAR)) END AS "Ref_name",
         concat('query', CAST(doc_id % 3 AS VARCHAR)) AS "Query_name"
  FROM documents
)"""

RAW_RECORDS = f"""
raw_records AS (
  SELECT CASE doc_id % 4
           WHEN 0 THEN concat('src', CAST(doc_id % 31 AS VARCHAR), '|contig_', CAST(doc_id AS VARCHAR))
           WHEN 1 THEN concat('src', CAST(doc_id % 31 AS VARCHAR), '_', CAST(doc_id AS VARCHAR))
           WHEN 2 THEN concat('src', CAST(doc_id % 31 AS VARCHAR), '|c', CAST(doc_id AS VARCHAR), '|x')
           ELSE concat('orphan', CAST(doc_id AS VARCHAR), 'x') END AS record_id,
         CASE WHEN doc_id % 5 = 0 THEN {LETTERS_SQL}
              ELSE translate({LETTERS_SQL},
                             'abcdefghijklmnopqrstuvwxyz', 'acgtacgtnacgtacgtacguacgta') END AS raw_sequence,
         doc_id AS record_pos
  FROM documents
)"""

METADATA_RECORDS = """
metadata_records AS (
  SELECT source AS genome, doc_id AS row_pos,
         CASE WHEN doc_id % 10 = 3 THEN NULL ELSE CAST(doc_id % 97 AS DOUBLE) END AS order_completeness,
         n_chars AS lenbp, lang AS ecosystem
  FROM documents
)"""

CLASSIFIER_RECORDS = """
classifier_records AS (
  SELECT CASE WHEN suffix(source, '5') THEN concat('other_', source) ELSE source END AS query, doc_id AS row_pos,
         concat('GO_', upper(lang)) AS gvclass_order,
         concat('d_V;o_', upper(lang)) AS taxonomy_majority,
         CAST(doc_id % 89 AS DOUBLE) AS order_completeness
  FROM documents
)"""

PRODUCTS = """
products AS (
  SELECT source AS dataset_id,
         CASE doc_id % 3 WHEN 0 THEN 'fna' WHEN 1 THEN 'faa' ELSE 'tnf' END AS product,
         concat('lake/', source, '/', CASE doc_id % 3 WHEN 0 THEN 'fna' WHEN 1 THEN 'faa' ELSE 'tnf' END,
                '/v', CAST(doc_id AS VARCHAR), '.parquet') AS uri,
         sha256(text) AS sha256,
         concat('v', CAST(doc_id AS VARCHAR)) AS version,
         1700000000 + doc_id AS created_epoch
  FROM documents
)"""

# canonical 4-mer index: code = 2 bits per base (A=0,C=1,G=2,T=3); class =
# rank of min(code, revcomp(code)) among the distinct canonical codes
KMER_INDEX = """
kmer_codes AS (
  SELECT i AS code,
         (3 - (i % 4)) * 64 + (3 - (i // 4) % 4) * 16 + (3 - (i // 16) % 4) * 4 + (3 - (i // 64) % 4) AS rc,
         concat(substr('ACGT', (i // 64) % 4 + 1, 1), substr('ACGT', (i // 16) % 4 + 1, 1),
                substr('ACGT', (i // 4) % 4 + 1, 1), substr('ACGT', i % 4 + 1, 1)) AS kmer
  FROM range(256) t(i)
),
kmer_index AS (
  SELECT kmer, code, CAST(dense_rank() OVER (ORDER BY least(code, rc)) - 1 AS INTEGER) AS idx
  FROM kmer_codes
)"""

HMM_HITS = """
hmm_hits AS (
  SELECT replace(qseqid, 'q', 'HMM') AS query_name, sseqid AS target_name, evalue, bitscore AS score,
         round(pident / 10, 3) AS bias
  FROM protein_hits
)"""

VIEWS = {
    "hmm_hits": (HMM_HITS, ("protein_hits",)),
    "genomes": (GENOMES, ()),
    "seq_base": (SEQ_BASE, ()),
    "sequences": (SEQUENCES, ("seq_base",)),
    "catalogue": (CATALOGUE, ("sequences", "genomes")),
    "protein_hits": (PROTEIN_HITS, ()),
    "ani_hits": (ANI_HITS, ()),
    "raw_records": (RAW_RECORDS, ()),
    "metadata_records": (METADATA_RECORDS, ()),
    "classifier_records": (CLASSIFIER_RECORDS, ()),
    "products": (PRODUCTS, ()),
    "kmer_codes": (KMER_INDEX.split("kmer_index AS")[0].rstrip().rstrip(","), ()),
    "kmer_index": ("kmer_index AS" + KMER_INDEX.split("kmer_index AS")[1], ("kmer_codes",)),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str) -> str:
    ctes = ",\n".join(VIEWS[n][0].strip() for n in _closure(names))
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
