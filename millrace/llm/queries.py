"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, htmltext, langid, media, neardup, packing, pii, quality, secretscan, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_media_columns(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


@query
def op5_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.TOKENIZER))


@query
def op9_warc(spark, sf_dir):
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


ORACLES["op9_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(from_hex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits
  FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT)
        + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT)
        + CAST(substr(bits, i * 5 + 5, 1) AS INT), 1)), '') AS payload_digest
  FROM p
), k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark, sf_dir):
    return pii.span_digests(table(spark, sf_dir, "documents"))


@query
def op8_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op6_quality_rules(spark, sf_dir):
    return quality.measured(table(spark, sf_dir, "documents"))


ORACLES["op6_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS up,
    len(regexp_extract_all(t, '[a-z]')) AS low, len(regexp_extract_all(t, '[!?]')) AS marks
  FROM d LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)
    OR word_chars > 12 * n_words OR word_chars < 2 * n_words OR (up >= 20 AND up > low) OR 100 * marks > 10 * word_chars) AS kept
FROM b
"""


@query
def op3_secret_scans(spark, sf_dir):
    return secretscan.span_digests(table(spark, sf_dir, "documents"))


@query
def op7_html_extraction(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))
