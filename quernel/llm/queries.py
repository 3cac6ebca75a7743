"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import gif, jaccard, language, mixing, packing, pii, quality, suffixes, tokens, warc
from quernel.llm.common import WORD, table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def llm_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages, which have all its evidence: markup language, address suffix and host."""
    fields = language.page_fields(table(spark, sf_dir, "pages"))
    return language.identify(fields, suffix=F.col("suffix")).withColumnRenamed("doc_id", "page_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply(quality.ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def llm_quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.edit_counts(tokens.sample_edits(table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op9_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.stored(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc_derivatives, op2_source_mix, op3_language_id, op4_quality_rules, op5_personal_data, op6_token_counts, op7_suffix_dedup, op8_best_fit_packing, op9_media_gif, op10_jaccard_join, llm_page_language, llm_quality_ablations)
}


def _warc_sql() -> str:
    def urn(seed: str) -> str:
        h = f"sha256({seed})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    hidden = "html"
    x = f"regexp_replace({hidden}, '<!--.*?-->', ' ', 'gs')"
    for name in warc.HIDDEN:
        x = rf"regexp_replace({x}, '<{name}\b.*?</{name}[^<>]*>', ' ', 'gis')"
    x = rf"regexp_replace({x}, '</?(?:{warc.BLOCKS})\b[^<>]*>', chr(10), 'gi')"
    x = f"regexp_replace({x}, '<[^<>]*>', '', 'g')"
    for name, is_ in warc.ENTITIES:
        quoted = name.replace("'", "''")
        x = f"replace({x}, '{quoted}', '{is_.replace(chr(39), chr(39) * 2)}')"
    x = rf"regexp_replace({x}, '[ \t\r\f\x{{00a0}}]+', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    nl = "chr(13) || chr(10)"
    return rf"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
    r AS (
      SELECT page_id, target_uri, html, 'sha256:' || sha256(html) AS payload_digest, {x} AS txt,
        {urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri")} AS refers_to,
        substr(regexp_replace(regexp_extract(html, '<title[^<>]*>(.*?)</title', 1, 'is'), '[\r\n]+', ' ', 'g'), 1, 1000) AS title,
        regexp_extract(html, '<html[^<>]*\slang=["'']?([A-Za-z-]+)', 1, 'i') AS lang
      FROM p),
    m AS (
      SELECT *, {urn("'metadata|' || refers_to || '|' || payload_digest")} AS meta, {urn("'conversion|' || refers_to || '|' || payload_digest")} AS conv,
        'title: ' || title || {nl} || 'language: ' || lang || {nl} || 'source-content-type: text/html; charset=UTF-8' || {nl}
        || 'source-payload-digest: ' || payload_digest || {nl} || 'conversion-digest: sha256:' || sha256(txt) || {nl}
        || 'conversion-length: ' || CAST(strlen(txt) AS VARCHAR) || {nl} AS fields
      FROM r),
    u AS (
      SELECT page_id, 'metadata' AS warc_type, meta AS record_id, refers_to, conv AS concurrent_to, target_uri, 'application/warc-fields' AS content_type, payload_digest, fields AS content FROM m
      UNION ALL
      SELECT page_id, 'conversion', conv, refers_to, meta, target_uri, 'text/plain; charset=UTF-8', payload_digest, txt FROM m)
    SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '{warc.DATE}' AS warc_date, content_type,
      'text/html; charset=UTF-8' AS source_content_type, payload_digest AS source_payload_digest,
      'sha256:' || sha256(content) AS block_digest, CAST(strlen(content) AS BIGINT) AS content_length, content
    FROM u"""


_LEDGER_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS txt FROM documents),
    w AS (SELECT k, doc_id, txt, regexp_extract_all(txt, '{WORD}') AS ws, list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
    win AS (SELECT k, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
    twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM twice) GROUP BY k),
    m AS (
      SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(txt, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (k)),
    f AS (
      SELECT *, (n_words < 20) AS b0, (100 * n_repeat_words > 30 * n_words) AS b1, (n_symbols > n_words) AS b2,
        (2 * n_dup_lines > n_lines) AS b3, (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS b4 FROM m)"""

_RULES_SQL = (
    _LEDGER_SQL
    + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (b0 OR b1) AS base_failed,
      NOT (b0 OR b1 OR b2 OR b3 OR b4) AS kept,
      CAST(CAST(b0 AS INT) + 2 * CAST(b1 AS INT) + 4 * CAST(b2 AS INT) + 8 * CAST(b3 AS INT) + 16 * CAST(b4 AS INT) AS BIGINT) AS failures
    FROM f"""
)

_ABLATIONS_SQL = (
    _LEDGER_SQL
    + """,
    t AS (SELECT *, CAST(b0 AS INT) + CAST(b1 AS INT) + CAST(b2 AS INT) + CAST(b3 AS INT) + CAST(b4 AS INT) AS n FROM f),
    e AS ("""
    + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, b{r.bit} AS b, n FROM t" for r in quality.RULES)
    + """)
    SELECT rule, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
      CAST(sum(CASE WHEN b AND n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_only,
      CAST(sum(CASE WHEN n - CAST(b AS INT) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept_without
    FROM e GROUP BY rule HAVING count(*) > 0"""
)

_JACCARD_SQL = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.m AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM c GROUP BY a) t ON t.a = d.doc_id"""

ORACLE_SQL = {"op1_warc_derivatives": _warc_sql(), "op4_quality_rules": _RULES_SQL, "llm_quality_ablations": _ABLATIONS_SQL, "op10_jaccard_join": _JACCARD_SQL}
