"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Windows of 200 bytes as 400 hexadecimal digits, cut from pieces that begin every 1000 bytes; removed runs are islands of window starts at most 200 apart.
OP3 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(hex(encode(text)), '') AS x FROM documents),
c AS (SELECT r, q, substring(x, CAST(2000 * q + 1 AS BIGINT), 2398) AS y FROM d, unnest(generate_series(0, CAST((length(x) // 2 - 200) // 1000 AS BIGINT))) AS t(q) WHERE length(x) >= 400),
w AS (SELECT r, 1000 * q + j AS p, md5(substring(y, CAST(2 * j - 1 AS BIGINT), 400)) AS k FROM c, unnest(generate_series(1, least(1000, CAST(length(y) // 2 - 199 AS BIGINT)))) AS t(j)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM w WHERE k IN (SELECT k FROM twice)),
island AS (SELECT r, p, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS i FROM hit),
span AS (SELECT r, i, min(p) AS a, max(p) + 199 AS b FROM island GROUP BY r, i),
piece AS (
  SELECT r, i, substring(x, CAST(2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY i), 0) + 1 AS BIGINT), CAST(2 * (a - 1 - coalesce(lag(b) OVER (PARTITION BY r ORDER BY i), 0)) AS BIGINT)) AS y
  FROM span JOIN d USING (r)),
cut AS (SELECT r, sum(b - a + 1) AS n, count(*) AS s, max(b) AS z FROM span GROUP BY r),
kept AS (SELECT r, string_agg(y, '' ORDER BY i) AS y FROM piece GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE y || substring(x, CAST(2 * z + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 49)) AS t(p) WHERE doc_id IS NOT NULL),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(generate_series(p, p + 49)) AS i FROM win JOIN least USING (k) WHERE m < doc_id)),
word AS (SELECT r, i, w[i] AS x FROM d, unnest(generate_series(1, len(w))) AS t(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS x, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: All pairs of rows, by a number of their own; components by repeated least labels over links.
OP8 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (
  SELECT u, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM ok a JOIN ok b ON a.u <> b.u AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT u AS a, u AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS u, min(vec_id) AS component_id FROM reach JOIN v ON b = u GROUP BY a),
n AS (SELECT a AS u, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN low USING (u) LEFT JOIN n USING (u)
"""

#: Rows by a number of their own; products are exact in double precision for whole numbers of this size.
OP12 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: coalesce(floor(256 * x), 0)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pair AS (
  SELECT a.u AS a, a.vec_id AS anchor_id, b.u AS b, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.u <> b.u AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
pos AS (SELECT a, anchor_id, b, vec_id, score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT pos.anchor_id, pos.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY pair.score DESC, pair.vec_id NULLS LAST) AS INT) AS rank,
  pair.vec_id AS negative_id, pos.score AS positive_score, pair.score AS negative_score
FROM pos JOIN pair ON pair.a = pos.a AND NOT pair.same AND 50 * pos.score <= 100 * pair.score AND 100 * pair.score <= 95 * pos.score QUALIFY rank <= 3
"""


def op13(rounds: int = 10) -> str:
    """Rounds of assignment and whole means one after another, each a table of its own."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"n{i} AS MATERIALIZED (SELECT u, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (SELECT u, c, CAST(list_dot_product(v.q, v.q) - 2 * list_dot_product(v.q, k{i}.q) + list_dot_product(k{i}.q, k{i}.q) AS BIGINT) AS d FROM v, k{i}) GROUP BY u)"
        )
        if i < rounds:
            steps.append(
                f"k{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, k{i}.q) AS q FROM k{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS q FROM "
                f"(SELECT c, i, sum(CAST(v.q[i] AS BIGINT)) AS s, count(*) AS n FROM n{i} JOIN v USING (u), range(1, 65) AS t(i) GROUP BY c, i) GROUP BY c) m USING (c))"
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS INT) AS c, q FROM v QUALIFY c < 8),
{(","+chr(10)).join(steps)}
SELECT v.vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(k{rounds}.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM n{rounds} JOIN v USING (u) JOIN k{rounds} USING (c)
"""


OP13 = op13()
