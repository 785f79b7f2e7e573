"""The registered queries of this package."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import centroids, languages, licenses, near_dups, nearest, packing, pages, pieces, private, quality, runs, topk, vector_dups

_QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_license_scan": licenses.op2_license_scan,
    "op8_private_data": private.op8_private_data,
    "op9_quality": quality.op9_quality,
    "op10_html_text": pages.op10_html_text,
    "pipeline": corpus_pipeline.run,
    "op3_nearest_neighbours": nearest.op3_nearest_neighbours,
    "op4_embedding_near_dups": vector_dups.op4_embedding_near_dups,
    "op5_language_id": languages.op5_language_id,
    "op6_minhash_near_dups": near_dups.op6_minhash_near_dups,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_exact_top_k": topk.op12_exact_top_k,
    "op13_centroid_clusters": centroids.op13_centroid_clusters,
}


#: Vectors with a norm: null, zero and non-finite ones take no part, nor do vectors of different lengths meet.
_VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0)"
_DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), lambda s, c: s + c)"

_NEAREST = f"""WITH {_VECTORS}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_DOT} AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20"""

_REACHED = "r AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other), c AS (SELECT node, min(other) AS component FROM r GROUP BY node)"

_VECTOR_LINKS = f"""WITH RECURSIVE {_VECTORS}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9), {_REACHED},
n AS (SELECT a, count(*) AS n FROM l GROUP BY a) SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id"""

_SHINGLE_LINKS = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) AS m, any_value(y.n) AS n FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (m + n - shared)), {_REACHED} SELECT s.doc_id AS doc_id, len(s) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept FROM s LEFT JOIN c ON c.node = s.doc_id"""

_TEMPLATE_ROWS = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{label}', {words.split()})" for words, label in licenses.PHRASES.items())
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows that begin with a word of a template are as long as it with a tenth of other words between; the scan's share is 0.9.
_LICENSES = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT t, label, {_WORDS} AS u FROM (VALUES {_TEMPLATE_ROWS}) v(t, label, text)),
t2 AS (SELECT t, label, list_distinct(u) AS s, ceil(0.9 * len(list_distinct(u)) - 1e-9) AS need, ceil(len(u) / 0.9 - 1e-9) AS wide FROM t), tw AS (SELECT t, label, need, wide, len(s) AS size, unnest(s) AS word FROM t2),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM w), h AS (SELECT doc_id, place, word, t, label, need, wide, size FROM p JOIN tw USING (word)),
m AS (SELECT doc_id, t FROM h GROUP BY doc_id, t HAVING count(DISTINCT word) >= any_value(need)), k AS (SELECT h.* FROM h JOIN m USING (doc_id, t)),
c AS (SELECT a.doc_id AS doc_id, a.t, a.place, any_value(a.label) AS label, any_value(a.need) AS need, count(DISTINCT b.word) / any_value(a.size) AS held, count(DISTINCT b.word) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.t = b.t AND b.place >= a.place AND b.place < a.place + a.wide GROUP BY a.doc_id, a.t, a.place),
b AS (SELECT doc_id, f.label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(f.words) - 1] = f.words)) - 1 AS place FROM w, (VALUES {_PHRASE_ROWS}) f(label, words)),
b2 AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(held) AS score FROM (SELECT doc_id, label, held FROM c WHERE n >= need UNION ALL SELECT doc_id, label, 1.0 FROM b) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM w LEFT JOIN b2 USING (doc_id) LEFT JOIN a USING (doc_id)"""

#: crc32 bit by bit over the decimal id; -1 stands for a step of one bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, c: CASE WHEN c >= 0 THEN xor(s, c) ELSE xor(s >> 1, 3988292384 * (s & 1)) END))"

#: Equal five words at a distance q, in stretches, give q + 4 and more words of period q; of stretches within each other the one with the smaller period counts.
_RUNS = rf"""WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {_CRC} AS h FROM documents), b1 AS (SELECT *, len(o) AS n, h // 10 AS g FROM b),
b2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM b1), b3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b2),
v AS MATERIALIZED (SELECT doc_id, n, list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) AS w FROM b3),
t AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM v), f AS MATERIALIZED (SELECT doc_id, n, i, lead(x, 4) OVER d AS last, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS five FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT a.doc_id AS doc_id, b.i - a.i AS q, a.i AS i FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.five = b.five AND a.i < b.i AND 4 * (b.i - a.i) <= a.n WHERE a.last IS NOT NULL AND b.last IS NOT NULL),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM m), l AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY doc_id, q, stretch),
c AS (SELECT * FROM l WHERE length >= 6 AND length >= 4 * q), r AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.doc_id = c.doc_id AND k.q < c.q AND k.start <= c.start AND k.start + k.length >= c.start + c.length)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS collapsed FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.q AND t.i < r.start + r.length) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY doc_id),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) AS place FROM r)
SELECT v.doc_id AS doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM v LEFT JOIN e ON e.doc_id = v.doc_id LEFT JOIN k ON k.doc_id = v.doc_id LEFT JOIN z ON z.doc_id = v.doc_id AND z.place = 1"""

#: Vectors without null and non-finite components, as whole numbers.
_WHOLE = "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)"

_TOP_K = f"""WITH {_WHOLE}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 10"""


def _clusters_sql(rounds: int = 10, k: int = 8) -> str:
    """Every round as two tables: the nearest centroid of each vector, and the centroids after it."""
    parts = [
        f"{_WHOLE}, u AS MATERIALIZED (SELECT vec_id, x FROM v WHERE len(x) = 64), p AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS k, unnest(x) AS y FROM u)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM u ORDER BY c LIMIT {k})",
    ]
    squared = "CAST(list_sum(list_transform(list_zip(u.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT vec_id, c.c AS c, {squared} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c.c) AS place FROM u, c{r} c), a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} WHERE place = 1)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT c, k, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y FROM a{r} JOIN p USING (vec_id) GROUP BY c, k), n{r} AS (SELECT c, list(y ORDER BY k) AS x FROM m{r} GROUP BY c), c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} USING (c))")
    return "WITH " + ",\n".join(parts) + f" SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; models, tokenizers, packing, discovered spans and page trees have tests instead."""
    return {"op2_license_scan": _LICENSES, "op3_nearest_neighbours": _NEAREST, "op4_embedding_near_dups": _VECTOR_LINKS, "op6_minhash_near_dups": _SHINGLE_LINKS, "op11_periodic_runs": _RUNS, "op12_exact_top_k": _TOP_K, "op13_centroid_clusters": _clusters_sql()}
