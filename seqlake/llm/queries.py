"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (balltree, bpe, decontam, hmm, langid, orcout, packing, quality, secret_scan, sharding, simhash, turntrie,
               warc)
from .common import scratch_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), path)
    return warc.page_captures(warc.read_warc(spark, path))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                       (F.size("hit_words") > 0).alias("contaminated"))


oracle("op2_decontamination", r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM iwin),
dwin AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)),
hit AS (SELECT rid, i, d.k, item_id FROM dwin d JOIN iwin USING (k, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    end_id=1, spaced=True)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens", "padded_length")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == secret_scan.KINDS.index(kind)))
    return found.select("doc_id", *[count(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.assign_shards(docs, "doc_id", sharding.regular_tree(40), sharding.regular_tree(41))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(rows, model, "lang_pred", "score").drop("text")


@query
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first follows measured costs, so the query returns the verdict alone
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


oracle("op8_quality_rules", r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
win AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
rep AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win
  JOIN (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1) USING (rid, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM rep GROUP BY rid),
m AS (
  SELECT doc_id, text, ln, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS uppers
  FROM doc LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR ((word_chars < 2 * n_words OR word_chars > 15 * n_words)
      AND NOT regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]'))
    OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 60 * len(ln) OR 100 * letters < 60 * word_chars OR 100 * uppers > 60 * letters
    OR 100 * len(list_filter(ln, lambda x: regexp_matches(x, '^\s*[-*•]'))) > 90 * len(ln)
    OR 100 * len(list_filter(ln, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 30 * len(ln)) AS kept
FROM b
""")


@query
def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), hmm.held_out_tenth(F.col("doc_id")))


@query
def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "token-orc")
    orcout.write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"),
                           end_id=2, spaced=False)
    return orcout.token_digests(orcout.read_token_orc(spark, path))


@query
def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.decode(bpe.encode(docs, path, bpe.build_lexicon(docs, path)), path)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("text", 256).alias("decoded_sha256"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


oracle("op12_ranked_search", r"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS length FROM doc WHERE len(w) > 0),
dt AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM doc) GROUP BY ALL),
it AS (SELECT i, t, count(*) AS qf FROM (SELECT i, unnest(w) AS t FROM item) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM dt, size GROUP BY t, n_docs),
md AS (SELECT d, doc_id, 100 - 75 + ((75 * len(w)::BIGINT * n_docs) // length) AS m FROM doc, size),
sc AS (SELECT i, d, sum(qf * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM it JOIN dt USING (t) JOIN wt USING (t) JOIN md USING (d) GROUP BY i, d),
rk AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM sc JOIN md USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk JOIN item USING (i) WHERE rank <= 10
""")


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """Every conversation c with its first crc32(c) % 6 turns taken from conversation c - c % 100."""
    conv = F.col("conv_id")
    return turntrie.spliced(turns, conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turntrie.sequences(table(spark, sf_dir, "conversations")), "turns")
    return turntrie.trie_nodes(rebuilt_conversations(turns))


oracle("op13_conversation_trie", r"""
WITH RECURSIVE step(b, k, v) AS (SELECT b, 0, b::BIGINT FROM range(256) AS r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM step WHERE k = 8),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(role)::VARCHAR || ':' || role || text)) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295],
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = base WHERE i < h
  UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id WHERE i >= h),
l AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS s
  FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM l),
n AS (SELECT s[1:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d) AS ends FROM p GROUP BY ALL),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END AS own
  FROM n LEFT JOIN k USING (node)),
t AS (SELECT node[1:a] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved
  FROM (SELECT node, n_children, own, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN t ON t.node = m.node LEFT JOIN m AS up ON m.depth > 0 AND up.node = m.node[1:m.depth - 1]
""")
