"""The operators of this subpackage applied to the given tables, and the same questions in SQL where SQL can ask them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echelon.llm import (
    byte_bpe, decontamination, fingerprints, line_dedup, lm_scoring, near_dedup, secret_scan, spelling, substring_dedup, token_counts, toxicity, url_filter,
    whitening,
)
from echelon.llm.common import table

URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against the texts that labels call good, and against all."""
    docs = table(spark, folder, "documents")
    return lm_scoring.cross_entropy_difference(docs, lm_scoring.good_texts(docs, table(spark, folder, "labels")))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, folder, "documents"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts whose pages are mostly linked with tracking parameters are listed."""
    pages = table(spark, folder, "pages")
    return url_filter.judge_urls(pages, url_filter.tracked_hosts(pages), URL_RULES)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, folder, "documents"))[0]


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, folder, "documents")).select("doc_id", "class_id")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_report(table(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_token_counts, op2_lm_scoring, op3_byte_bpe, op4_fingerprints, op5_url_filter, op6_toxicity, op7_secret_scan, op8_decontamination,
        op9_near_dedup, op10_line_dedup, op11_whitening, op12_spelling_variants, op13_substring_dedup,
    )
}
_UPPER_TO_LOWER = f"'{line_dedup.UPPER}', '{line_dedup.LOWER}'"


def _url_sql() -> str:
    """Membership is asked of the list itself."""
    longest = sorted(URL_RULES, key=lambda rule: -len(rule.name))
    fits = [f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}') THEN" for rule in longest]
    names = " ".join(f"{fit} '{rule.name}'" for fit, rule in zip(fits, longest, strict=True))
    verdicts = " ".join(f"{fit} '{rule.verdict}'" for fit, rule in zip(fits, longest, strict=True))
    return f"""WITH rests AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER_TO_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    listed AS (SELECT host FROM parts GROUP BY host HAVING 2 * count(*) FILTER (WHERE regexp_matches(url, '[?&](utm_[a-z]+|ref|gclid|fbclid)=')) > count(*))
    SELECT page_id, host, path, CASE {names} END AS rule, CASE {verdicts} WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM parts"""


def _secret_sql() -> str:
    """Places from the lengths of matches and of what lies between them."""
    kinds = {rule.kind: rank for rank, rule in enumerate(secret_scan.RULES)}
    blocks = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        blocks.append(
            f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
              'a': CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
              'n': length(found[i]), 'kept': length(held[i]) >= {rule.least}}})) AS s
            FROM (SELECT r, string_split_regex(t, {pattern}) AS between, regexp_extract_all(t, {pattern}, 0) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS held FROM docs)"""
        )
    text = "string_agg(kind || ':' || s.a || ':' || (s.a + s.n), ',' ORDER BY s.a, rank)"
    base = len(secret_scan.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {kinds[rule.kind]}) AS n_{rule.kind}" for rule in secret_scan.BASE)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS (SELECT * FROM ({" UNION ALL ".join(blocks)}) WHERE s.kept),
    summed AS (SELECT r, {counts}, {text} FILTER (WHERE rank < {base}) AS base, {text} AS spans FROM spans GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN summed USING (r)"""


_SPACE = " || ".join(f"chr({ord(c)})" for c in line_dedup.SPACE)
_LINE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
lines AS (SELECT r, doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS place FROM docs),
keyed AS (SELECT *, trim(translate(line, {_UPPER_TO_LOWER}), {_SPACE}) AS key FROM lines),
frequent AS (SELECT key AS gone FROM (SELECT DISTINCT r, key FROM keyed WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent ON key = gone GROUP BY r, doc_id"""

#: The other operators have no SQL; tests hold them against brute force, a round trip or held-out labels.
SQL = {"op5_url_filter": _url_sql(), "op7_secret_scan": _secret_sql(), "op10_line_dedup": _LINE_SQL}
