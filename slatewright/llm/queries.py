"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, extraction, language, licenses, media, negatives, packing, repair, secrets, simhash, substrings, vectors
from .common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(documents(spark, sf_dir))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(spark, documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("n_tokens")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(spark, documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(spark, documents(spark, sf_dir))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_media": op2_media,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_vectors": op4_vectors,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_licenses": op7_licenses,
    "op8_substrings": op8_substrings,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_negatives": op11_negatives,
    "op12_repair": op12_repair,
    "op13_extraction": op13_extraction,
}

#: Operators whose whole result SQL can express; the others are tested against brute force,
#: round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op4_vectors": """WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM good),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.n * b.n) >= CAST(0.9 AS DOUBLE)),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN least m ON m.a = e.vec_id""",
    "op6_chat": """WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (SELECT *, length(replace(replace(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '\\', '\\\\'), chr(10), '\\n')) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM escaped GROUP BY conv_id""",
    "op8_substrings": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM starts),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM windows) x WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS text, count(*) AS n FROM words t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.p = t.p) GROUP BY t.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op11_negatives": """WITH good AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT a, b, s FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM scores WHERE alike) x WHERE r <= 5),
neg AS (SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r
  FROM pos p JOIN scores n ON n.a = p.a AND NOT n.alike AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE r <= 10""",
    "op12_repair": """WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substring(key, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda u, z: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 20 AS k FROM keyed),
after AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, LATERAL (SELECT unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy) x),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM after),
judged AS MATERIALIZED (SELECT conv_id, turn, role, text, p, n, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  substring(role, 1, 1) AS r, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM placed),
dp AS (
  SELECT conv_id, n AS p, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s1, {'c': 2, 'a': 'I', 't': 'assistant:' || chr(10)} AS s2, {'c': 0, 'a': '', 't': ''} AS s3 FROM judged WHERE p = 1
  UNION ALL
  SELECT conv_id, p,
    list_sort([r0, {'c': r2.c + 2, 'a': 'I' || r2.a, 't': 'user:' || chr(10) || r2.t}, {'c': r3.c + 4, 'a': 'II' || r3.a, 't': 'user:' || chr(10) || 'assistant:' || chr(10) || r3.t}])[1],
    list_sort([r1, {'c': r2.c + 2, 'a': 'I' || r2.a, 't': 'user:' || chr(10) || r2.t}, {'c': r3.c + 4, 'a': 'II' || r3.a, 't': 'user:' || chr(10) || 'assistant:' || chr(10) || r3.t}])[1],
    list_sort([r2, {'c': r3.c + 2, 'a': 'I' || r3.a, 't': 'assistant:' || chr(10) || r3.t}])[1],
    list_sort([r3, {'c': r2.c + 2, 'a': 'I' || r2.a, 't': 'user:' || chr(10) || r2.t}])[1]
  FROM (SELECT d.conv_id, d.p - 1 AS p,
      list_sort([{'c': d.s0.c + 3, 'a': 'D' || d.s0.a, 't': d.s0.t}, {'c': d.s2.c + 2 + j.x, 'a': 'R' || d.s2.a, 't': 'user:' || j.text || chr(10) || d.s2.t},
        {'c': CASE j.r WHEN 's' THEN d.s1.c WHEN 'u' THEN d.s2.c ELSE 900000 END + j.x, 'a': 'K' || CASE j.r WHEN 's' THEN d.s1.a ELSE d.s2.a END, 't': j.role || ':' || j.text || chr(10) || CASE j.r WHEN 's' THEN d.s1.t ELSE d.s2.t END}])[1] AS r0,
      list_sort([{'c': d.s1.c + 3, 'a': 'D' || d.s1.a, 't': d.s1.t}, {'c': d.s2.c + 2 + j.x, 'a': 'R' || d.s2.a, 't': 'user:' || j.text || chr(10) || d.s2.t},
        {'c': CASE j.r WHEN 'u' THEN d.s2.c ELSE 900000 END + j.x, 'a': 'K' || d.s2.a, 't': j.role || ':' || j.text || chr(10) || d.s2.t}])[1] AS r1,
      list_sort([{'c': d.s2.c + 3, 'a': 'D' || d.s2.a, 't': d.s2.t}, {'c': d.s3.c + 2 + j.x, 'a': 'R' || d.s3.a, 't': 'assistant:' || j.text || chr(10) || d.s3.t},
        {'c': CASE j.r WHEN 'a' THEN d.s3.c ELSE 900000 END + j.x, 'a': 'K' || d.s3.a, 't': j.role || ':' || j.text || chr(10) || d.s3.t}])[1] AS r2,
      list_sort([{'c': d.s3.c + 3, 'a': 'D' || d.s3.a, 't': d.s3.t}, {'c': d.s2.c + 2 + j.x, 'a': 'R' || d.s2.a, 't': 'user:' || j.text || chr(10) || d.s2.t},
        {'c': CASE j.r WHEN 'u' THEN d.s2.c ELSE 900000 END + j.x, 'a': 'K' || d.s2.a, 't': j.role || ':' || j.text || chr(10) || d.s2.t}])[1] AS r3
    FROM dp d JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 500000 END AS x FROM judged) j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.p = d.p) y),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE p > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  CAST(coalesce(d.s0.c, 0) AS BIGINT) AS cost, coalesce(d.s0.a, '') AS audit, sha256(coalesce(CASE WHEN d.s0.t = '' THEN '' ELSE left(d.s0.t, length(d.s0.t) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN dp d ON d.conv_id IS NOT DISTINCT FROM o.conv_id AND d.p = 0""",
}
