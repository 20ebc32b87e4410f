"""The opN_ queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, language, line_dedup, mixing, packing, parity_join, prefix_trie, search, secrets, sharding, suffix_dedup, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.with_held_out(table(spark, sf_dir, "documents"))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), passage_words=50)


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_sharding, op3_rank_order_language, op4_temperature_mixing, op5_parity_join, op6_projected_neighbours, op7_suffix_dedup, op8_ordinal_toxicity, op9_threshold_top_k, op10_secret_scan, op11_line_dedup, op12_prefix_trie, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op5_parity_join": OP5_SQL, "op9_threshold_top_k": OP9_SQL, "op11_line_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_source_divergence": OP13_SQL}


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i+4], ' ') ELSE array_to_string(ws, ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 75 * (na.n + nb.n - p.i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""

OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, i, p[i] AS line, translate(trim(p[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
), common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common c ON c.key = l.key GROUP BY l.doc_id
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS own FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS lender, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h
  FROM o
), r AS (
  SELECT h.conv_id, list_concat(coalesce(l.own, [])[1:h.h], h.own[h.h + 1:]) AS ts FROM h LEFT JOIN o l ON l.conv_id = h.lender
), p AS (
  SELECT conv_id, len(ts) AS length, d, ts[1:d] AS path FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)
), n AS (
  SELECT d AS depth, path, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = d), '')) AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM p GROUP BY d, path
), k AS (
  SELECT c.*, u.conv_id AS parent FROM n c LEFT JOIN n u ON u.depth = c.depth - 1 AND u.path = c.path[1:c.depth - 1]
), s AS (
  SELECT k.*, (SELECT count(*) FROM k x WHERE x.depth = k.depth + 1 AND x.parent = k.conv_id) AS children FROM k
), b AS (
  SELECT a AS depth, path[1:a] AS path, count(*) FILTER (WHERE children = 0) AS leaves, sum(saved) AS saved FROM (SELECT path, children, saved, unnest(range(0, depth + 1)) AS a FROM s) GROUP BY 1, 2
)
SELECT s.conv_id, s.depth, s.parent AS parent_conv_id, s.n AS n_convs, s.children AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, s.ends AS ends_sha256
FROM s JOIN b ON b.depth = s.depth AND b.path = s.path
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gp AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0) + 2 * v.v) AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lp AS (
  SELECT k.lang, k.term, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(sum(c.n), 0) + 2) // (coalesce(sum(sum(c.n)) OVER (PARTITION BY k.lang), 0) + 2 * any_value(v.v)) AS q
  FROM kept k JOIN v ON v.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.term = k.term GROUP BY k.lang, k.term
), a AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN gp x ON x.lang = a.lang AND x.source = a.source LEFT JOIN gp y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT gp.lang, gp.source, 'term', gp.term, CAST((gp.p - q) * (gp.p - q) // (gp.p + q) AS BIGINT) FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE gp.n > 0 AND gp.p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM a QUALIFY part = 'pair' OR rank <= 10
"""
