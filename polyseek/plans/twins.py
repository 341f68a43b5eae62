"""DuckDB SQL for the catalogue's inputs, as named parts that a twin's text refers to."""

from __future__ import annotations

import re

PARTS = {
    "tok": "SELECT vec_id, vec_id // 5 AS doc_id, vec_id % 5 AS pos, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "cen": "SELECT vec_id AS centroid_id, v AS cv FROM tok WHERE vec_id < 16",
    "qtok": "SELECT vec_id // 80 AS query_id, (vec_id // 20) % 4 AS q_token_id, v AS qv, label FROM tok WHERE vec_id % 20 = 0",
    "asg": "SELECT * EXCLUDE rn FROM (SELECT t.*, c.centroid_id, c.cv, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, cv), 9) DESC, centroid_id) AS rn FROM tok t CROSS JOIN cen c) WHERE rn = 1",
    "res": "SELECT vec_id, centroid_id, list_transform(list_zip(v, cv), lambda x: x[1] - x[2]) AS r FROM asg",
    "codec": "SELECT quantile_cont(x, [i / 16.0 FOR i IN range(1, 16)]) AS cutoffs, quantile_cont(x, [(i + 0.5) / 16.0 FOR i IN range(16)]) AS weights, avg(abs(x)) AS avg_residual FROM (SELECT unnest(r) AS x FROM res)",
    "cells": "SELECT centroid_id, cv, size, coalesce(sum(size) OVER (ORDER BY centroid_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT c.centroid_id, any_value(c.cv) AS cv, count(a.vec_id) AS size FROM cen c LEFT JOIN asg a USING (centroid_id) GROUP BY 1)",
    "post": "SELECT row_number() OVER (ORDER BY a.centroid_id, doc_id, pos) - 1 AS embedding_pos, a.vec_id, a.centroid_id, doc_id, pos, label, cv, list_transform(r, lambda y: len(list_filter(cutoffs, lambda c: c < y))) AS codes FROM asg a JOIN res USING (vec_id) CROSS JOIN codec",
    "postw": "SELECT post.*, list_transform(codes, lambda c: weights[c + 1]) AS w FROM post CROSS JOIN codec",
    "csc": "SELECT query_id, q_token_id, centroid_id, size, list_dot_product(qv, cv) AS score FROM qtok CROSS JOIN cells",
    "ranked": "SELECT *, row_number() OVER w AS rank, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM csc WINDOW w AS (PARTITION BY query_id, q_token_id ORDER BY round(score, 9) DESC, centroid_id)",
    "routed": "SELECT query_id, q_token_id, centroid_id, size, score, rank FROM ranked WHERE rank <= 4",
    "missing": "SELECT query_id, q_token_id, coalesce(arg_min(score, rank) FILTER (WHERE cum >= 40), arg_max(score, rank)) AS mse FROM ranked GROUP BY ALL",
    "tsc": "SELECT r.query_id, r.q_token_id, doc_id, embedding_pos, rank, r.score AS cs, r.score + list_dot_product(qv, w) AS score FROM routed r JOIN postw USING (centroid_id) JOIN qtok USING (query_id, q_token_id)",
    "won": "SELECT query_id, q_token_id, doc_id, embedding_pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_token_id, doc_id ORDER BY round(score, 9) DESC, rank, embedding_pos) AS n FROM tsc) WHERE n = 1",
    "docs": "SELECT query_id, doc_id, sum(coalesce(score, mse)) AS score, count(score) AS influential FROM (SELECT DISTINCT query_id, doc_id FROM won) JOIN missing USING (query_id) LEFT JOIN won USING (query_id, q_token_id, doc_id) GROUP BY ALL",
    "top": "SELECT query_id, doc_id, score, influential, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM docs QUALIFY rank <= 10",
    "qrels": "SELECT query_id, doc_id, count(*) AS relevance FROM tok JOIN (SELECT DISTINCT query_id, label FROM qtok) USING (label) GROUP BY ALL HAVING count(*) >= 3",
    "m1": "SELECT query_id, q_token_id, centroid_id, size AS num_token_token_sims FROM routed WHERE size > 0",
    "r0": "SELECT query_id, q_token_id, centroid_id, rank - 1 AS rank, score AS centroid_score FROM routed",
    "m3": "SELECT query_id, q_token_id, doc_id, embedding_pos AS winner_embedding_pos, won.score AS winner_score FROM won SEMI JOIN top USING (query_id, doc_id)",
    "orc": "SELECT query_id, q_token_id, doc_id, embedding_pos, centroid_id, list_dot_product(qv, cv) + list_dot_product(qv, w) AS score FROM (SELECT DISTINCT query_id, doc_id FROM won) JOIN postw USING (doc_id) JOIN qtok USING (query_id)",
    "m4": "SELECT query_id, q_token_id, doc_id, embedding_pos AS oracle_embedding_pos, score AS oracle_score, centroid_id AS oracle_centroid_id FROM orc QUALIFY row_number() OVER (PARTITION BY query_id, q_token_id, doc_id ORDER BY round(score, 9) DESC, embedding_pos) = 1",
    "m5": "SELECT m4.*, NOT EXISTS (SELECT 1 FROM r0 WHERE r0.query_id = m4.query_id AND r0.q_token_id = m4.q_token_id AND r0.centroid_id = m4.oracle_centroid_id) AS is_miss, winner_embedding_pos AS observed_embedding_pos, winner_score AS observed_score, oracle_score - coalesce(winner_score, oracle_score) AS score_delta FROM m4 LEFT JOIN m3 USING (query_id, q_token_id, doc_id)",
    "m6": "SELECT oracle_centroid_id, count(*) FILTER (WHERE is_miss) AS miss_count, count(*) AS oracle_win_count, count(*) FILTER (WHERE is_miss) / count(*) AS miss_rate FROM m5 GROUP BY 1",
    "dstat": "SELECT doc_id, count(*) AS num_doc_embeddings, count(DISTINCT centroid_id) AS num_doc_centroids FROM post GROUP BY 1",
    "reach": "SELECT query_id, doc_id, count(DISTINCT centroid_id) AS num_accessible_centroids FROM post JOIN (SELECT DISTINCT query_id, centroid_id FROM r0) USING (centroid_id) GROUP BY ALL",
    "m4r": "SELECT m4.*, num_doc_embeddings, num_doc_centroids, coalesce(num_accessible_centroids, 0) AS num_accessible_centroids, EXISTS (SELECT 1 FROM r0 WHERE r0.query_id = m4.query_id AND r0.q_token_id = m4.q_token_id AND r0.centroid_id = m4.oracle_centroid_id) AS oracle_is_accessible, coalesce(num_accessible_centroids, 0) > 0 AS any_embedding_accessible FROM m4 SEMI JOIN qrels USING (query_id, doc_id) JOIN dstat ON dstat.doc_id = m4.doc_id LEFT JOIN reach ON reach.query_id = m4.query_id AND reach.doc_id = m4.doc_id",
    "status": "SELECT *, CASE WHEN NOT any_embedding_accessible THEN 'mse_only' WHEN oracle_hits = num_tokens THEN 'fully_optimal' ELSE 'partial' END AS routing_status, oracle_hits / num_tokens AS oracle_hit_rate, least(1.0, num_accessible_centroids / num_doc_centroids) AS centroid_coverage FROM (SELECT query_id, doc_id, count(*) FILTER (WHERE oracle_is_accessible) AS oracle_hits, count(*) AS num_tokens, bool_or(any_embedding_accessible) AS any_embedding_accessible, max(num_doc_embeddings) AS num_doc_embeddings, max(num_doc_centroids) AS num_doc_centroids, max(num_accessible_centroids) AS num_accessible_centroids FROM m4r GROUP BY ALL)",
    "dcnt": "SELECT centroid_id, doc_id, count(*) AS n FROM post GROUP BY ALL",
    "shares": "SELECT centroid_id, sum(n) FILTER (WHERE r <= 1) / sum(n) AS top_1_doc_share, sum(n) FILTER (WHERE r <= 5) / sum(n) AS top_5_doc_share, sum(n) FILTER (WHERE r <= 10) / sum(n) AS top_10_doc_share FROM (SELECT *, row_number() OVER (PARTITION BY centroid_id ORDER BY n DESC, doc_id) AS r FROM dcnt) GROUP BY 1",
    "dgini": "SELECT centroid_id, 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS gini_coefficient FROM (SELECT *, row_number() OVER (PARTITION BY centroid_id ORDER BY n) AS i FROM dcnt) GROUP BY 1",
    "disp": "SELECT centroid_id, avg(list_dot_product(w, w)) AS dispersion FROM postw GROUP BY 1",
    "isol": "SELECT centroid_id, 1 - avg(s) AS isolation, max(s) AS nearest_neighbor_sim, avg(s) AS mean_neighbor_sim FROM (SELECT a.centroid_id, list_dot_product(a.cv, b.cv) AS s, row_number() OVER (PARTITION BY a.centroid_id ORDER BY round(list_dot_product(a.cv, b.cv), 9) DESC, b.centroid_id) AS r FROM cen a JOIN cen b ON a.centroid_id <> b.centroid_id) WHERE r <= 10 GROUP BY 1",
    "sized": "SELECT centroid_id, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM post GROUP BY 1",
    "offline": "SELECT * FROM sized JOIN shares USING (centroid_id) JOIN dgini USING (centroid_id) JOIN disp USING (centroid_id) JOIN isol USING (centroid_id)",
    "freq": "SELECT centroid_id, count(m1.query_id) AS sel_freq FROM cen LEFT JOIN m1 USING (centroid_id) GROUP BY 1",
    "yld": "SELECT centroid_id, coalesce(computed, 0) AS computed, coalesce(influential, 0) AS influential, coalesce(influential, 0) / nullif(computed, 0) AS yield FROM (SELECT centroid_id, sum(num_token_token_sims) AS computed FROM m1 GROUP BY 1) FULL JOIN (SELECT centroid_id, count(*) AS influential FROM m3 JOIN post ON winner_embedding_pos = embedding_pos GROUP BY 1) USING (centroid_id)",
    "hub": "SELECT centroid_id, sel_freq, yield, share AS traffic_share, share * (1 - coalesce(yield, 0)) AS bad_hubness, share * coalesce(yield, 0) AS good_hubness, CASE WHEN share <= (SELECT quantile_cont(share, 0.95) FROM hub0) THEN 'normal' WHEN coalesce(yield, 0) < 0.1 THEN 'bad_hub' WHEN coalesce(yield, 0) > 0.3 THEN 'good_hub' ELSE 'normal' END AS hub_type FROM hub0",
    "hub0": "SELECT centroid_id, sel_freq, yield, sel_freq / (SELECT sum(sel_freq) FROM freq) AS share FROM freq LEFT JOIN yld USING (centroid_id)",
    "load": "SELECT query_id, centroid_id, count(*) AS n FROM m1 GROUP BY ALL",
    "loadp": "SELECT *, n / sum(n) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY n) AS i, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, centroid_id) AS r, count(*) OVER (PARTITION BY query_id) AS g FROM load",
    "activ": "SELECT query_id, count(*) AS unique_centroids, stddev_pop(n) / avg(n) AS load_cv, -sum(p * ln(p)) AS activation_entropy, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(greatest(count(*), 2)) ELSE -sum(p * ln(p)) END AS normalized_activation_entropy, 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS load_gini, sum(n) FILTER (WHERE r <= greatest(1, g // 20)) / sum(n) AS top_5_centroid_share FROM loadp GROUP BY 1",
    "m2": "SELECT query_id, m1_total_sims, coalesce(k, 0) AS m3_influential_pairs, m1_total_sims - coalesce(k, 0) AS m2_redundant_sims, (m1_total_sims - coalesce(k, 0)) / m1_total_sims AS redundancy_rate FROM (SELECT query_id, sum(num_token_token_sims) AS m1_total_sims FROM m1 GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS k FROM m3 GROUP BY 1) USING (query_id)",
    "frame0": "SELECT o.*, sel_freq, yield, traffic_share, bad_hubness, good_hubness, hub_type, coalesce(miss_count, 0) AS miss_count, coalesce(oracle_win_count, 0) AS oracle_win_count, miss_rate AS m6_miss_rate, coalesce(sims, 0) AS m1_sims, 1 - yield AS redundancy, log10(greatest(n_tokens, 1)) AS log_n_tokens, sel_freq = 0 AS is_anti_hub FROM offline o LEFT JOIN hub USING (centroid_id) LEFT JOIN m6 ON oracle_centroid_id = o.centroid_id LEFT JOIN (SELECT centroid_id, sum(num_token_token_sims) AS sims FROM m1 GROUP BY 1) s ON s.centroid_id = o.centroid_id",
    "frame": "SELECT *, greatest(1, len(list_filter((SELECT list_distinct(quantile_cont(sel_freq, [0, 0.25, 0.5, 0.75, 1])) FROM frame0), lambda e: e < sel_freq))) AS traffic_quartile FROM frame0",
    "words": r"SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents",
}


def _uses(text: str) -> list[str]:
    return [n for n in PARTS if re.search(rf"\b{n}\b", text)]


def twin(final: str, spec: str) -> str:
    """The whole statement: the parts that ``final`` needs, then its columns as ``spec`` types them."""
    need: list[str] = []

    def visit(name: str) -> None:
        if name in need:
            return
        for n in _uses(PARTS[name]):
            if n != name:
                visit(n)
        need.append(name)

    for n in _uses(final):
        visit(n)
    form = {"i": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
    cols = ", ".join(f'{form[t].format(chr(34) + c + chr(34))} AS "{c}"' for c, t in (x.split(":") for x in spec.split()))
    head = "WITH " + ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in need) + " " if need else ""
    return f"{head}SELECT {cols} FROM ({final})"
