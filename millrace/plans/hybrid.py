"""Hybrid search, chunks and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunks, ranking, similarity
from millrace.plans.registry import query
from millrace.plans.search import _KEYWORD, _now, _recency
from millrace.sources.views import table, view, with_views

_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_PLAIN = _KEYWORD.replace("2.0 WHEN contains(lower(category)", "1.0 WHEN contains(lower(category)")


@query("hybrid_search", with_views(f"SELECT id, project, round((0.75 * (1 + {_COS}) / 2 + 0.25 * ({_PLAIN})) * 0.8 + {_recency('created_at')} * 0.05 + importance / 10.0 * 0.15, 6) AS score FROM memories_v m JOIN embeddings e ON m.id = concat('mem_', CAST(e.vec_id AS VARCHAR)), (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, id LIMIT 10"))
def hybrid_search(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id = 7").select("embedding").first()[0]
    rows = view(spark, sf, "memories_v").join(vectors.select(F.concat(F.lit("mem_"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vec")), "id")
    return ranking.hybrid_search(rows, "the fr", asked, "memory", ["content", "category"], _now()).select("id", "project", "score")


_SETS = r"list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), lambda x: x <> ''))"


@query("route_prompt", with_views(rf"WITH m AS (SELECT concat('mem_', CAST(doc_id AS VARCHAR)) AS id, {_SETS} AS w FROM documents WHERE doc_id % 2 = 0), p AS (SELECT doc_id AS prompt_id, lower(text) AS low, {_SETS} AS v FROM documents WHERE doc_id % 2 = 1), s AS (SELECT prompt_id, id, len(list_intersect(v, w)) / CAST(len(v) + len(w) - len(list_intersect(v, w)) AS DOUBLE) AS score FROM p JOIN m ON len(v) * 0.85 <= len(w) AND len(w) * 0.85 <= len(v)), b AS (SELECT prompt_id, arg_min(id, (-score, id)) AS target FROM s WHERE score >= 0.85 GROUP BY prompt_id) SELECT p.prompt_id AS prompt_id, CASE WHEN target IS NOT NULL THEN 'update_memory' WHEN contains(low, 'remember') THEN 'create_memory' WHEN contains(low, 'skill') THEN 'create_skill' ELSE 'create_memory' END AS op, target, CASE WHEN target IS NULL AND contains(low, 'remember') THEN 5 WHEN target IS NULL AND NOT contains(low, 'skill') THEN 4 END AS importance FROM p LEFT JOIN b ON p.prompt_id = b.prompt_id"))
def route_prompt(spark, sf):
    docs = table(spark, sf, "documents")
    memories = docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("mem_"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"))
    return ranking.route_prompts(docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt")), memories)


_WORDS = "list_distinct(list_filter(list_transform(string_split_regex(lower(content), '\\s+'), lambda x: regexp_replace(x, '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g')), lambda x: x <> ''))"


@query("best_text_match", with_views(f"WITH w AS (SELECT id, {_WORDS} AS x, ['the', 'and', 'of', 'to', 'in'] AS y FROM memories_v), s AS (SELECT id, round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS score FROM w) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 1"))
def best_text_match(spark, sf):
    return similarity.best_text_match(view(spark, sf, "memories_v"), "the and of to in", 0.01)


@query("chunk_sentences")
def chunk_sentences(spark, sf):
    return chunks.chunk_sentences(table(spark, sf, "documents"), 500)


@query("rag_chunks")
def rag_chunks(spark, sf):
    return chunks.rag_chunks(table(spark, sf, "documents"), "the and of to", 1000, 3)
