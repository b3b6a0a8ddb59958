"""Driver queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkburst.llm import audit_sql, chat, code_books, divergence, embed_dedup, license_scan, line_dedup, line_links, line_rules, mixing, packing, quality, sharding, simhash, url_filter
from sparkburst.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return {
        "op1_sharding": lambda s, d: sharding.sharding_report(table(s, d, "documents")),
        "op2_quality_classifier": lambda s, d: quality.quality_report(table(s, d, "documents"), table(s, d, "labels")),
        "op3_embedding_dedup": lambda s, d: embed_dedup.embedding_links(table(s, d, "embeddings")),
        "op4_quality_rules": lambda s, d: line_rules.line_rules_report(table(s, d, "documents")),
        "op5_mixing": lambda s, d: mixing.mixing_report(table(s, d, "documents")),
        "op6_packing": lambda s, d: packing.packing_report(table(s, d, "documents")),
        "op7_url_filter": lambda s, d: url_filter.url_report(table(s, d, "pages"), table(s, d, "labels")),
        "op8_chat_format": lambda s, d: chat.chat_report(table(s, d, "conversations")),
        "op9_line_dedup": lambda s, d: line_dedup.line_dedup_report(table(s, d, "documents")),
        "op9_line_links": lambda s, d: line_links.line_links_report(table(s, d, "documents")),
        "op10_simhash_dedup": lambda s, d: simhash.simhash_report(table(s, d, "documents")),
        "op11_license_scan": lambda s, d: license_scan.license_report(table(s, d, "documents")),
        "op12_vector_codes": lambda s, d: code_books.codes_report(table(s, d, "embeddings")),
        "op13_source_divergence": lambda s, d: divergence.divergence_report(table(s, d, "documents")),
        "pipeline": pipeline,
    }


_WS = r"[\x20\x09-\x0D]"
_SOLID = rf"length(regexp_replace({{}}, '{_WS}', '', 'g'))"
_WORDS = rf"list_filter(regexp_split_to_array({{}}, '{_WS}+'), lambda x: x <> '')"

LINE_RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
lw AS (SELECT *, {_SOLID.format("line")} AS solid, {_WORDS.format("line")} AS w FROM l),
lo AS (SELECT *, len(w) > 0 AND NOT regexp_matches(line, '{line_rules.TERMINAL}') AS unended FROM lw),
sh AS (SELECT *, unended AND len(w) <= {line_rules.SHORT} AND length(line) <= {40 * line_rules.SHORT} AS short, unended AND len(w) <= {line_rules.STOCK_WORDS} AND length(line) <= {40 * line_rules.STOCK_WORDS} AS stock FROM lo),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, short ORDER BY i) AS run FROM sh),
menu AS (SELECT *, short AND count(*) OVER (PARTITION BY doc_id, short, run) >= {line_rules.RUN} AS in_menu FROM runs),
held AS (SELECT line, count(DISTINCT t) AS n FROM menu WHERE stock GROUP BY 1),
common AS (SELECT line AS common_line FROM held WHERE n >= {line_rules.STOCK_TEXTS}),
bad AS (SELECT doc_id, sum(solid) AS n FROM menu WHERE len(w) > 0 AND (in_menu OR (stock AND line IN (SELECT common_line FROM common))
  OR len(regexp_extract_all(line, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]')) > {line_rules.MAX_MARKS} * solid
  OR (len(w) >= {line_rules.FEW_WORDS} AND len(regexp_extract_all(line, '[^\p{{L}}\p{{M}}\x20\x09-\x0D]')) > {line_rules.MAX_OTHERS} * solid)
  OR len(list_filter(w, lambda x: regexp_full_match(x, '[|>»·•/–—-]+'))) > {line_rules.MAX_SEPARATORS} * len(w)
  OR (len(w) <= {line_rules.PHRASE_WORDS} AND regexp_matches(line, '(?i){"|".join(line_rules.PHRASES).replace("'", "''")}'))) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw WHERE len(w) > 0 GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, {_SOLID.format("t")} AS word_chars, CAST(len(regexp_extract_all(t, '{line_rules.SYMBOLS}')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, CAST(coalesce(bad.n, 0) AS BIGINT) AS removed_chars
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN bad ON bad.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND removed_chars <= {line_rules.MAX_LOSS} * word_chars AS kept FROM b"""


def _rules_sql() -> tuple[str, str]:
    rule = verdict = "CASE"
    for say, host, path in sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = f" WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN "
        rule, verdict = rule + fits + f"'{host}{path}'", verdict + fits + f"'{say}'"
    return rule + " END", verdict + " END"


def _strength_sql(mean: str, source: str) -> str:
    rho = f"sum(pow(bad - n * {mean}, 2) - n * {mean} * (1 - {mean})) / nullif(sum(n * (n - 1) * {mean} * (1 - {mean})), 0)"
    return f"(SELECT round(1 / coalesce(least(greatest({rho}, 0.001), 0.5), 0.5) - 1, 6) FROM {source} WHERE n > 0)"


_SUFFIX = "CASE WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ({}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END".format(", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL))
URL_SQL = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id, max(1 - quality) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad, string_split(host, '.') AS parts FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY 1),
hs AS (SELECT host, n, bad, {_SUFFIX} AS suffix, parts FROM h),
hd AS (SELECT host, n, bad, suffix, array_to_string(parts[-(len(string_split(suffix, '.')) + 1):], '.') AS domain FROM hs),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 1.0) / (sum(sum(n)) OVER () + 2.0) AS m0 FROM d GROUP BY 1),
k0 AS (SELECT {_strength_sql("m0", "s")} AS k), s1 AS (SELECT suffix, (bad + k * m0) / (n + k) AS m1 FROM s, k0),
d0 AS (SELECT d.*, m1 FROM d JOIN s1 ON s1.suffix = d.suffix), k1 AS (SELECT {_strength_sql("m1", "d0")} AS k), d1 AS (SELECT suffix, domain, (bad + k * m1) / (n + k) AS m2 FROM d0, k1),
h0 AS (SELECT hd.*, m2 FROM hd JOIN d1 ON d1.suffix = hd.suffix AND d1.domain = hd.domain), k2 AS (SELECT {_strength_sql("m2", "h0")} AS k),
ab AS (SELECT host, bad + k * m2 AS a, n - bad + k * (1 - m2) AS b FROM h0, k2),
f AS (SELECT host, a / (a + b) - {url_filter.Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > {url_filter.MAX_BAD} AS blocked FROM ab)
SELECT u.page_id, u.host, u.path, {_rules_sql()[0].replace("host", "u.host").replace("(path", "(u.path")} AS rule,
  coalesce({_rules_sql()[1].replace("host", "u.host").replace("(path", "(u.path")}, CASE WHEN f.blocked THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f ON f.host = u.host"""


def oracle_sql() -> dict[str, str]:
    """The other operators draw, iterate or tokenise; tests hold them against plain Python."""
    return {
        "op4_quality_rules": LINE_RULES_SQL,
        "op7_url_filter": URL_SQL,
        "op11_license_scan": audit_sql.license_sql(),
        "op12_vector_codes": audit_sql.codes_sql(),
        "op13_source_divergence": audit_sql.divergence_sql(),
    }
