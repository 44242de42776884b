"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.llm import (
    alignment,
    ann,
    bpe,
    langid,
    licenses,
    mixing,
    neardup,
    orderminhash,
    packing,
    sharding,
    tokencount,
    urlfilter,
    whitening,
)
from aforo.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 8
BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
COUNT_FILE = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
# The rules of the url query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_projected_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op2_histogram_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = sharding.shard_by_bytes(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), SHARDS)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.taken_words(mixing.mix(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op3_source_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM docs GROUP BY source
), weighed AS (
  SELECT *, (r % 3 + 1)::BIGINT AS w, (sum(source_size) OVER ())::BIGINT AS total FROM sizes
), open AS (
  SELECT *,
    total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words,
    (sum(w) OVER (ORDER BY source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM weighed
), judged AS (
  SELECT *, (source_size * 3)::DOUBLE < (words * w)::DOUBLE / weights::DOUBLE AS full_up FROM open
), share AS (
  SELECT words, weights FROM judged WHERE NOT full_up ORDER BY source_size / w, r LIMIT 1
), targets AS (
  SELECT j.source, j.source_size,
    CASE WHEN j.full_up OR s.words IS NULL THEN (j.source_size * 3)::DOUBLE ELSE (s.words * j.w)::DOUBLE / s.weights::DOUBLE END AS target
  FROM judged j LEFT JOIN share s ON true
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target + 0.5)::BIGINT, 3 * t.source_size) AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, quota) - start)
   + greatest(0, least(source_size + start + size, quota) - (source_size + start))
   + greatest(0, least(2 * source_size + start + size, quota) - (2 * source_size + start)))::BIGINT AS taken
FROM placed
"""


@query
def op4_order_minhash(spark, sf_dir):
    return orderminhash.compared_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_bpe_round_trip(spark, sf_dir):
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(BPE_FILE))
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


@query
def op6_license_scan(spark, sf_dir):
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.get(F.sort_array(F.transform("matches", lambda m: F.struct(m["dice"], m["license"], m["first_line"], m["last_line"])), False), F.lit(0))
    found = scanned.select("doc_id", "n_lines", F.size("matches").alias("n_matches"), best.alias("best"), "matches")
    names = F.array_join(F.array_sort(F.array_distinct("matches.license")), ",")
    return found.select("doc_id", "n_lines", "n_matches", F.expr("best.license"), F.expr("best.dice"), names.alias("licenses"))


@query
def op7_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE["op7_url_rules"] = r"""
WITH rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rests AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, n,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), fits AS (
  SELECT p.n, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parsed p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""


@query
def op8_token_counts(spark, sf_dir):
    tokenizer = tokencount.load_tokenizer(public_tokenizers.path(COUNT_FILE))
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, limit=TOKEN_LIMIT)


@query
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op10_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, words=2)


ORACLE["op10_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), distinct_sets AS (
  SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), shingles AS (
  SELECT id, len(s) AS n, unnest(s) AS x FROM distinct_sets
), rare AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, x) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM shingles)
), candidates AS (
  SELECT DISTINCT a.id AS a, b.id AS b
  FROM (SELECT * FROM rare WHERE k <= n - (n * 4 + 4) // 5 + 1) a JOIN (SELECT * FROM rare WHERE k <= n - (n * 4 + 4) // 5 + 1) b
    ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
), links AS (
  SELECT c.a, c.b FROM candidates c JOIN distinct_sets p ON p.id = c.a JOIN distinct_sets q ON q.id = c.b
  WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id AS a, id AS b FROM distinct_sets UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
), roots AS (
  SELECT a AS id, min(b) AS root FROM reach GROUP BY a
)
SELECT t.doc_id, len(t.s)::BIGINT AS n_shingles, coalesce(r.root, t.doc_id) AS component_id,
       t.doc_id IS NOT DISTINCT FROM coalesce(r.root, t.doc_id) AS kept
FROM sets t LEFT JOIN distinct_sets d ON list_sort(t.s) = d.s LEFT JOIN roots r ON r.id = d.id
"""


@query
def op11_merge_path_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = alignment.Pieces.load(public_tokenizers.path(PIECE_FILE))
    return alignment.link_counts(docs, bpe.Vocabulary.load(public_tokenizers.path(BPE_FILE)), pieces)


@query
def op12_polarised_whitening(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitening.by_component(white).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_curve_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, bpe.Vocabulary.load(public_tokenizers.path(BPE_FILE)), TOKEN_LIMIT)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
