"""The subpackage's queries: each applies one operator to its whole table; SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_pack, cutting_stock, disclosure, domain_mix, jpeg_media, license_rules, line_rules, mask_search, merkle_manifest, projection_passes, quality_ftrl, secret_models, signature_tree_join
from .common import table


def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("key", "removed")


def op2_domain_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_columns(table(spark, sf_dir, "documents"))


def op4_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack(table(spark, sf_dir, "documents"))


def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree_join.jaccard_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_models.digest(table(spark, sf_dir, "documents"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack.packed_matrices(table(spark, sf_dir, "documents"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op12_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_rules, op2_domain_mix, op3_jpeg_media, op4_cutting_stock, op5_signature_tree_join, op6_secret_models, op7_quality_ftrl, op8_license_rules, op9_best_fit_pack, op10_disclosure, op11_merkle_manifest, op12_projection_passes, op13_mask_search)
    return {f.__name__: f for f in own}


LINE_RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT r, doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm
  FROM (SELECT r, doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)
), full_lines AS (SELECT * FROM lines WHERE n > 0),
own AS (SELECT r, doc_id, host, norm, sum(n) AS n FROM full_lines GROUP BY ALL),
frequent AS (SELECT host, norm FROM own GROUP BY ALL HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT r, sum(n) AS removed_words FROM own JOIN frequent USING (host, norm) GROUP BY r),
repeats AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY r),
places AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3),
triples AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM places),
again AS (SELECT r, w FROM triples GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM triples JOIN again USING (r, w)) GROUP BY r
), measures AS (
  SELECT r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       coalesce(removed_words, 0)::BIGINT AS removed_words,
       n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND 100 * (n_words - coalesce(removed_words, 0)) >= 30 * n_words AS kept
FROM measures LEFT JOIN repeats USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')" for c in merkle_manifest.FIELDS) + ")"
_LOWERED = _LEAF.replace("cast(text AS varchar)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: The checksum of doc_id, byte by byte and bit by bit, and its last inversion.
_CRC = "xor(4294967295, list_reduce([ord(x) FOR x IN string_split(cast(doc_id AS varchar), '')], lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, (a & 1) * 3988292384), xor(c, x)), 4294967295::BIGINT))"
MERKLE_SQL = f"""
WITH RECURSIVE leafs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 3 = 0 AND text IS NOT NULL THEN {_LOWERED} END AS tampered FROM documents
), pos AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leafs
), up AS (
  SELECT tree, 0 AS level, idx, leaf AS hash, n FROM pos
  UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), max((n + 7) // 8) FROM up WHERE n > 1 GROUP BY tree, level, idx // 8
), sub AS (SELECT tree, hash AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, subroot AS hash, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), max((n + 7) // 8) FROM top WHERE n > 1 GROUP BY level, idx // 8
), runs AS (
  SELECT tree, level, idx // 8 AS run, list(hash ORDER BY idx) AS h FROM up WHERE n > 1 GROUP BY ALL
), top_runs AS (SELECT level, idx // 8 AS run, list(hash ORDER BY idx) AS h FROM top WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT r, tree, 0 AS level, idx, coalesce(tampered, leaf) AS cur, '' AS proof FROM pos
  UNION ALL SELECT r, c.tree, c.level + 1, idx // 8, sha256(array_to_string(h[1:idx % 8], '') || cur || array_to_string(h[idx % 8 + 2:], '')), proof || array_to_string(h[1:idx % 8], '') || array_to_string(h[idx % 8 + 2:], '')
  FROM climb c JOIN runs s ON s.tree = c.tree AND s.level = c.level AND s.run = idx // 8
), crown AS (
  SELECT r, 0 AS level, tree AS idx, cur, proof FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1
  UNION ALL SELECT r, c.level + 1, idx // 8, sha256(array_to_string(h[1:idx % 8], '') || cur || array_to_string(h[idx % 8 + 2:], '')), proof || array_to_string(h[1:idx % 8], '') || array_to_string(h[idx % 8 + 2:], '')
  FROM crown c JOIN top_runs s ON s.level = c.level AND s.run = idx // 8
), ends AS (SELECT r, arg_max(cur, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM crown GROUP BY r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM pos JOIN sub USING (tree) JOIN ends USING (r) CROSS JOIN (SELECT hash AS root FROM top WHERE n = 1)
"""

VECTORS_SQL = """
WITH RECURSIVE own AS (
  SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM own a JOIN own b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.93
), reach AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, e.vec_id)::BIGINT AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) x ON x.a = e.vec_id LEFT JOIN (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id) m ON m.vec_id = e.vec_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
sums AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_all FROM d WHERE len(t) > 0),
tf AS (SELECT r, x, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS x FROM d) GROUP BY ALL),
w AS (SELECT x, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN sums GROUP BY x, n_docs),
q AS (SELECT item_id, x, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS x FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t)::BIGINT * n_docs) // n_all))))::BIGINT AS score
  FROM q JOIN tf USING (x) JOIN w USING (x) JOIN d USING (r) CROSS JOIN sums GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM scored JOIN d USING (r) WHERE score > 0
) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_rules": LINE_RULES_SQL, "op5_signature_tree_join": JACCARD_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_projection_passes": VECTORS_SQL, "op13_mask_search": SEARCH_SQL}
