"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.alignment import align_tokenizers
from corpusloom.llm.exact_dedup import exact_duplicates
from corpusloom.llm.language_id import identify_language
from corpusloom.llm.media import media_digests
from corpusloom.llm.merkle import verify_manifest
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.sharding import shard_rows
from corpusloom.llm.token_counts import length_histogram
from corpusloom.llm.token_pieces import tokenizer_path
from corpusloom.llm.substring_dedup import remove_repeated_substrings
from corpusloom.llm.url_filters import judge_urls, rules_table
from corpusloom.llm.warc import archive_pages
from corpusloom.session import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

#: The rules of the query (host, path, action).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_substrings(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_media": op3_media,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_minhash": op9_minhash,
    "op10_language_id": op10_language_id,
    "op11_url_filters": op11_url_filters,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

#: A document takes what its words overlap with the first ``quota`` words of its source's stream, read twice.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY src) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY src
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM l
), v AS (SELECT arg_min(lvl, (cap / w, src)) AS lvl FROM f WHERE lvl * w <= cap
), t AS (
  SELECT src, source_size, CASE WHEN v.lvl IS NULL THEN cap ELSE least(cap, v.lvl * w) END AS target FROM f, v
), p AS (
  SELECT d.*, source_size, target, floor(target + 1e-6)::BIGINT AS quota,
         coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st
  FROM d JOIN t ON d.src = t.src
)
SELECT doc_id, size, source_size, target,
       (greatest(least(quota, st + size) - st, 0) + greatest(least(quota - source_size, st + size) - st, 0))::BIGINT AS taken
FROM p
"""

OP11_SQL = r"""
WITH r(h, p, verdict) AS (VALUES %s
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         row_number() OVER () AS n
  FROM pages
), s AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), f AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (n)
""" % ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(raised: str) -> str:
    text = {c: f"({c}{raised if c == 'n_chars' else ''})::VARCHAR" for c in _FIELDS}
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in text.values()) + ")"


#: CRC-32 by bits: each byte of the id is XORed in, then eight shifts (-1) follow.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER () AS rid, {_leaf_sql('')} AS leaf, {_leaf_sql(' + 1::HUGEINT')} AS raised,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
  FROM documents
), l AS (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), t AS (
  SELECT g, 0 AS lvl, i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM l
  UNION ALL
  SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lvl, i // 2, n
), s AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS gn FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, gi AS i, gn AS n, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n
), p AS (
  SELECT l.rid, v.lvl, l.i >> v.lvl AS i, l.g FROM l JOIN (SELECT DISTINCT g, lvl FROM t WHERE n > 1) v ON v.g = l.g
), q AS (
  SELECT rid, 1 AS part, p.lvl, p.i, t.h FROM p LEFT JOIN t ON t.g = p.g AND t.lvl = p.lvl AND t.i = xor(p.i, 1)
), r AS (
  SELECT l.rid, v.lvl, s.gi >> v.lvl AS i FROM l JOIN s ON s.g = l.g CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) v
), w AS (
  SELECT * FROM q UNION ALL SELECT rid, 2, r.lvl, r.i, u.h FROM r LEFT JOIN u ON u.lvl = r.lvl AND u.i = xor(r.i, 1)
), proofs AS (
  SELECT rid, list(CASE WHEN h IS NULL THEN 'N' WHEN i % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY part, lvl) AS steps,
         coalesce(string_agg(h, '' ORDER BY part, lvl), '') AS siblings
  FROM w GROUP BY rid
), f AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN crc % 7 = 0 THEN raised ELSE leaf END, coalesce(steps, [])),
           lambda a, b: sha256(CASE b[1] WHEN 'L' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
  FROM l JOIN s ON s.g = l.g LEFT JOIN proofs USING (rid)
)
SELECT *, folded_root = root AS verified FROM f
"""

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op11_url_filters": OP11_SQL, "op13_merkle": OP13_SQL}
