"""DuckDB SQL for the license scan, the vector codes and the source audit."""

from __future__ import annotations

import math

from sparkburst.llm import code_books, divergence, license_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    rows = [t for t in license_scan.TEMPLATES if t.in_a_row]
    phrases = ", ".join(f"({quoted(t.words)}, '{t.label}', {str(t.base).lower()})" for t in rows)
    sets = [(sorted(set(t.words)), t, license_scan.stride_of(len(t.words))) for t in license_scan.TEMPLATES if not t.in_a_row]
    notices = ", ".join(f"({quoted(words)}, '{t.label}', {step}, {math.ceil(t.containment * len(words) - 1e-9)})" for words, t, step in sets)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(words, label, base) AS (VALUES {phrases}), notices(words, label, step, need) AS (VALUES {notices}),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
places AS (SELECT r, i - 1 AS first, label, base FROM (SELECT e.r, e.i, p.label, p.base, p.words, d.w[e.i:e.i + len(p.words) - 1] AS found FROM each e JOIN phrases p ON p.words[1] = e.word JOIN d ON d.r = e.r) WHERE found = words),
steps AS (SELECT DISTINCT step FROM notices),
blocks AS (SELECT r, step, list_distinct(w[b * step + 1:b * step + 2 * step]) AS held FROM (SELECT d.r, d.w, s.step, unnest(range(0, CAST(ceil(len(d.w) / CAST(s.step AS DOUBLE)) AS BIGINT))) AS b FROM d, steps s)),
met AS (SELECT r, label, common / CAST(n AS DOUBLE) AS containment FROM (SELECT b.r, n.label, n.need, len(n.words) AS n, len(list_intersect(b.held, n.words)) AS common FROM blocks b JOIN notices n ON n.step = b.step) WHERE common >= need),
found AS (SELECT r, label, base, first, 1.0 AS containment FROM places UNION ALL SELECT r, label, false, NULL, containment FROM met),
told AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN told ON told.r = d.r"""


def codes_sql() -> str:
    """The rounds one after the other, for vectors of one length that the parts divide; plain comparisons with all entries."""
    k, n = code_books.PARTS, code_books.ENTRIES
    steps = []
    for t in range(code_books.ROUNDS + 1):
        steps.append(f"""n{t} AS (SELECT j, e, sum(x * x) AS s FROM c{t} GROUP BY 1, 2),
dot{t} AS (SELECT p.r, p.j, c.e, sum(p.x * c.x) AS s FROM p JOIN c{t} c ON c.j = p.j AND c.i = p.i GROUP BY 1, 2, 3),
a{t} AS (SELECT r, j, e, d FROM (SELECT q.r, q.j, q.e, n.s - 2 * q.s AS d, row_number() OVER (PARTITION BY q.r, q.j ORDER BY n.s - 2 * q.s, q.e) AS k FROM dot{t} q JOIN n{t} n ON n.j = q.j AND n.e = q.e) WHERE k = 1)""")
        if t < code_books.ROUNDS:
            steps.append(f"""m{t} AS (SELECT a.j, a.e, p.i, sum(p.x) AS s, count(*) AS n FROM a{t} a JOIN p ON p.r = a.r AND p.j = a.j GROUP BY 1, 2, 3),
c{t + 1} AS (SELECT c.j, c.e, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{t} c LEFT JOIN m{t} m ON m.j = c.j AND m.e = c.e AND m.i = c.i)""")
    last = code_books.ROUNDS
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
u AS (SELECT r, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {k} AS w FROM v),
p AS (SELECT r, i // w AS j, i % w AS i, CAST(floor({code_books.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
c0 AS (SELECT j, r - 1 AS e, i, x FROM p WHERE r <= {n}),
{", ".join(steps)},
own AS (SELECT r, sum(x * x) AS s FROM p GROUP BY 1),
codes AS (SELECT a.r, string_agg(printf('%02x', a.e), '' ORDER BY a.j) AS code, CAST(sum(a.d) + any_value(own.s) AS BIGINT) AS error FROM a{last} a JOIN own ON own.r = a.r GROUP BY 1),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j, e, i)) AS codebooks_sha256 FROM c{last})
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, digest.codebooks_sha256 FROM v JOIN codes c ON c.r = v.r, digest"""


def divergence_sql() -> str:
    share = lambda n, total, v: f"(1 + ({divergence.UNIT} * (CAST({n} AS HUGEINT) + {divergence.PRIOR})) // ({total} + {divergence.PRIOR} * {v}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3, 4),
q AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM q GROUP BY 1),
n AS (SELECT c.lang, c.source, c.term, CAST(sum(c.n) AS BIGINT) AS n FROM c JOIN q ON q.lang = c.lang AND q.term = c.term GROUP BY 1, 2, 3),
g AS (SELECT o.lang, o.source, coalesce(CAST(sum(n.n) AS BIGINT), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN n ON n.lang = o.lang AND n.source = o.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, q.term, coalesce(n.n, 0) AS n, {share("coalesce(n.n, 0)", "g.total", "l.v")} AS p, {share("q.n", "l.total", "l.v")} AS q
  FROM g JOIN q ON q.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = q.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""
