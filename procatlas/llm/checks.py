"""Check SQL that is too long to stand beside its query."""

from __future__ import annotations

_BLANK = "[^\\x20\\x09-\\x0D]"
_BLANKS = "[\\x20\\x09-\\x0D]"


def host_quality() -> str:
    rules = {
        "short": "n_words < 50",
        "repeats": "100 * n_repeat_words > 50 * n_words",
        "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
        "symbols": "10 * n_symbols > n_words",
        "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    }
    each = lambda form, sep=", ": sep.join(form.format(r=r, test=t) for r, t in rules.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
parts AS MATERIALIZED (
  SELECT rid, regexp_extract_all(t, '{_BLANK}+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_BLANK}')) AS lines FROM d),
tokens AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM parts),
windows AS (SELECT rid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY i)),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM seen WHERE n > 1) GROUP BY rid),
counts AS MATERIALIZED (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_BLANKS}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN parts USING (rid) LEFT JOIN covered USING (rid)),
hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {each("CAST(count(*) FILTER ({test}) AS DOUBLE) AS k_{r}")} FROM counts WHERE host IS NOT NULL GROUP BY host),
total AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, {each("sum(k_{r}) / sum(n) AS m_{r}, sum(k_{r} * k_{r} / n) AS kk_{r}")} FROM hosts),
alike AS (
  SELECT *, {each("CASE WHEN m_{r} * (1 - m_{r}) = 0 OR n - hosts + 1 - nn / n <= 0 THEN NULL ELSE ((kk_{r} - m_{r} * m_{r} * n) / (m_{r} * (1 - m_{r})) - (hosts - 1)) / (n - hosts + 1 - nn / n) END AS g_{r}")}
  FROM total),
strength AS (SELECT *, {each("CASE WHEN g_{r} IS NULL THEN 1 WHEN g_{r} > 1 / (1 + 1e6) THEN greatest(least(1e6, 1 / g_{r} - 1), 1) ELSE 1e6 END AS s_{r}")} FROM alike),
rates AS (
  SELECT h.host, {each("(h.k_{r} + m_{r} * s_{r}) / (h.n + s_{r}) AS p_{r}, h.n + s_{r} AS w_{r}")} FROM hosts h, strength),
bad AS (SELECT host FROM rates WHERE {each("p_{r} - 2.0 * sqrt(p_{r} * (1 - p_{r}) / (w_{r} + 1)) > 0.5", " OR ")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.host IS NULL AS kept
FROM counts LEFT JOIN bad ON counts.host = bad.host"""


def clusters(rounds: int = 10) -> str:
    """One table of distances and one of centroids per round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, c, d FROM (
    SELECT y.vec_id, c{k}.c, sum((y.x - c{k}.x) * (y.x - c{k}.x)) AS d FROM y JOIN c{k} ON y.i = c{k}.i GROUP BY y.vec_id, c{k}.c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""
m{k} AS MATERIALIZED (
  SELECT a{k}.c, y.i, (sum(y.x) - ((sum(y.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{k} JOIN y USING (vec_id) GROUP BY a{k}.c, y.i),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, c{k}.i, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} ON c{k}.c = m{k}.c AND c{k}.i = m{k}.i)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
y AS MATERIALIZED (SELECT vec_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM v),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8),
c0 AS MATERIALIZED (SELECT s.c, y.i, y.x FROM s JOIN y USING (vec_id)),{",".join(steps)},
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c)"""
