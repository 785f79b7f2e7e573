"""Lists, filters, search and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import lists, ranking
from millrace.operators.trigrams import TrigramIndex
from millrace.plans.registry import query
from millrace.sources.shared import new_folder
from millrace.sources.views import table, view, with_views

AS_OF = "2024-02-15 00:00:00"


def _now():
    return F.to_timestamp(F.lit(AS_OF))


def _recency(ts: str) -> str:
    return f"coalesce(pow(0.5, greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({ts}), 0) / 1e6 / (30.0 * 86400.0)), 0.0)"


@query("list_memories", with_views("SELECT id, category, importance FROM memories_v WHERE project = 'src3' ORDER BY created_at DESC, id LIMIT 200"))
def list_memories(spark, sf):
    return lists.list_rows(view(spark, sf, "memories_v"), "src3").select("id", "category", "importance")


@query("list_skills", with_views("SELECT id, project, name FROM skills_v ORDER BY name DESC, id LIMIT 200"))
def list_skills(spark, sf):
    return lists.list_rows(view(spark, sf, "skills_v"), newest="name").select("id", "project", "name")


@query("list_nodes", with_views("SELECT uri, name, abstract FROM nodes_v WHERE parent_uri = 'node://tpch/ASIA' ORDER BY uri LIMIT 200"))
def list_nodes(spark, sf):
    return lists.list_nodes(view(spark, sf, "nodes_v"), "node://tpch/ASIA").select("uri", "name", "abstract")


@query("filter_project", with_views("SELECT id, project, owner FROM memories_v WHERE project = 'src7'"))
def filter_project(spark, sf):
    return lists.by_project(view(spark, sf, "memories_v"), "src7").select("id", "project", "owner")


@query("filter_search_flags", with_views("SELECT id, owner, category FROM memories_v WHERE owner = 'agent' AND category = 'fr' AND created_at >= TIMESTAMP '2024-01-03 00:00:00' AND created_at <= TIMESTAMP '2024-02-01 00:00:00'"))
def filter_search_flags(spark, sf):
    rows = lists.search_filters(view(spark, sf, "memories_v"), "agent", "fr", "2024-01-03 00:00:00", "2024-02-01 00:00:00")
    return rows.select("id", "owner", "category")


@query("substring_filter", with_views("SELECT id, name FROM skills_v WHERE contains(lower(name), 'part 1') OR contains(lower(description), 'brand#1')"))
def substring_filter(spark, sf):
    return lists.quick_filter(view(spark, sf, "skills_v"), "Brand#1", ["description"]).unionByName(
        lists.quick_filter(view(spark, sf, "skills_v"), "part 1", ["name"])).dropDuplicates(["id"]).select("id", "name")


@query("distinct_tokens", with_views("SELECT id, len(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> ''))) AS n_tokens FROM memories_v"))
def distinct_tokens(spark, sf):
    return view(spark, sf, "memories_v").select("id", F.size(ranking.distinct_tokens("content")).alias("n_tokens"))


_KEYWORD = "(CASE WHEN contains(lower(content), 'the') THEN 2.0 WHEN contains(lower(category), 'the') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(content), 'fr') THEN 2.0 WHEN contains(lower(category), 'fr') THEN 1.0 ELSE 0.0 END) / 2.0"


@query("keyword_score", with_views(f"SELECT id, round({_KEYWORD}, 6) AS score FROM memories_v"))
def keyword_score(spark, sf):
    score = ranking.keyword_score(["content", "category"], ["the", "fr"], {"content": 2.0, "category": 0.0})
    return view(spark, sf, "memories_v").select("id", F.round(score, 6).alias("score"))


@query("recency_score", with_views(f"SELECT id, round({_recency('created_at')}, 6) AS score FROM memories_v"))
def recency_score(spark, sf):
    return view(spark, sf, "memories_v").select("id", F.round(ranking.recency_score("created_at", _now()), 6).alias("score"))


@query("importance_score", with_views("SELECT id, CASE WHEN importance > 0 THEN importance / 10.0 ELSE 0.0 END AS score FROM memories_v"))
def importance_score(spark, sf):
    return view(spark, sf, "memories_v").select("id", ranking.importance_score("importance").alias("score"))


@query("effective_weights", with_views("SELECT store, n, CASE store WHEN 'memory' THEN 0.6 / 1.3 WHEN 'skill' THEN 0.7 / 1.2 ELSE 0.6 / 1.2 END AS vector, CASE store WHEN 'memory' THEN 0.5 / 1.3 ELSE 0.5 / 1.2 END AS keyword FROM (SELECT 'memory' AS store, count(*) AS n FROM memories_v UNION ALL SELECT 'skill', count(*) FROM skills_v UNION ALL SELECT 'context', count(*) FROM nodes_v)"))
def effective_weights(spark, sf):
    out = None
    for store, name in (("memory", "memories_v"), ("skill", "skills_v"), ("context", "nodes_v")):
        w = ranking.effective_weights(store, {"keyword": 0.5, "recency": -1})
        one = view(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(store).alias("store"), "n", F.lit(w["vector"]).alias("vector"), F.lit(w["keyword"]).alias("keyword"))
        out = one if out is None else out.unionAll(one)
    return out


@query("hybrid_keyword_score", with_views(f"SELECT id, round({_KEYWORD} * 0.2 + {_recency('created_at')} * 0.05 + importance / 10.0 * 0.15, 6) AS score FROM memories_v"))
def hybrid_keyword_score(spark, sf):
    keyword = ranking.keyword_score(["content", "category"], ["the", "fr"], {"content": 2.0})
    score = ranking.hybrid_keyword_score(keyword, ranking.recency_score("created_at", _now()), ranking.importance_score("importance"), F.lit(0.0), ranking.WEIGHTS["memory"])
    return view(spark, sf, "memories_v").select("id", F.round(score, 6).alias("score"))


@query("hybrid_rerank", with_views(f"SELECT id, round(0.5 * 0.8 + {_recency('created_at')} * 0.05 + importance / 10.0 * 0.15, 6) AS score FROM memories_v"))
def hybrid_rerank(spark, sf):
    score = ranking.hybrid_rerank(F.lit(0.5), ranking.recency_score("created_at", _now()), ranking.importance_score("importance"), F.lit(0.0), ranking.WEIGHTS["memory"])
    return view(spark, sf, "memories_v").select("id", F.round(score, 6).alias("score"))


@query("topk_minscore", with_views("SELECT id, score FROM (SELECT id, project, importance / 10.0 AS score, row_number() OVER (PARTITION BY project ORDER BY importance DESC, id) AS r FROM memories_v WHERE importance / 10.0 >= 0.3) WHERE r <= 5"))
def topk_minscore(spark, sf):
    rows = view(spark, sf, "memories_v").withColumn("score", F.col("importance") / 10.0)
    return lists.topk_minscore(rows, 5, 0.3, by=["project"]).select("id", "score")


@query("candidate_limit", with_views("SELECT id, created_at FROM memories_v WHERE contains(lower(content), 'tion') ORDER BY created_at DESC, id LIMIT 50"))
def candidate_limit(spark, sf):
    return ranking.candidate_limit(view(spark, sf, "memories_v").filter(F.lower("content").contains("tion")), 10).select("id", "created_at")


_TEXT = f"""SELECT id, project, round(1.0 * 0.2 + {_recency('created_at')} * 0.05 + importance / 10.0 * 0.15, 6) AS score
FROM (SELECT * FROM memories_v WHERE contains(lower(content), 'tion') ORDER BY created_at DESC, id LIMIT 50) ORDER BY score DESC, id LIMIT 10"""


@query("text_search", with_views(_TEXT))
def text_search(spark, sf):
    return ranking.text_search(view(spark, sf, "memories_v"), "tion", "memory", ["content"], _now(), 10).select("id", "project", "score")


def _indexed(df, columns, key="id"):
    return TrigramIndex.build(df, new_folder(df.sparkSession, "trigrams"), columns, key, per_block=64)


@query("indexed_text_search", with_views(_TEXT))
def indexed_text_search(spark, sf):
    """text_search over the rows that an index of trigrams leaves."""
    index = _indexed(view(spark, sf, "memories_v"), ["content"])
    return ranking.text_search(index.containing("tion", ["content"], "id"), "tion", "memory", ["content"], _now(), 10).select("id", "project", "score")


@query("indexed_substring_filter", with_views("SELECT id, name FROM skills_v WHERE contains(lower(name), 'part 1') OR contains(lower(description), 'brand#1')"))
def indexed_substring_filter(spark, sf):
    index = _indexed(view(spark, sf, "skills_v"), ["name", "description"])
    return index.containing("Brand#1", ["description"], "id").unionByName(index.containing("part 1", ["name"], "id")).dropDuplicates(["id"]).select("id", "name")


@query("indexed_grep_lines", with_views(r"SELECT doc_id, line_no, replace(line, chr(9), '  ') AS line FROM lines_v WHERE regexp_matches(line, '(?i)(?:license|licen[cs]ed) under|[0-9]+ token')"))
def indexed_grep_lines(spark, sf):
    index = _indexed(table(spark, sf, "documents"), ["text"], "doc_id")
    return index.grep("(?:license|licen[cs]ed) under|[0-9]+ token", ignore_case=True).select("doc_id", "line_no", "line")


@query("highlight", with_views("SELECT id, CASE WHEN strpos(lower(name), 'zz') > 0 THEN 'never' WHEN strpos(lower(name), 'art') > 0 THEN substr(name, 1, strpos(lower(name), 'art') - 1) || '<mark>' || substr(name, strpos(lower(name), 'art'), 3) || '</mark>' || substr(name, strpos(lower(name), 'art') + 3) ELSE name END AS marked FROM skills_v"))
def highlight(spark, sf):
    return view(spark, sf, "skills_v").select("id", ranking.highlight("name", ["zz", "art"]).alias("marked"))


_STORES = f"""SELECT 'memory' AS store, id, 0.2 AS score FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM memories_v WHERE contains(lower(content), 'er')) WHERE r <= 5
UNION ALL SELECT 'skill', id, 0.3 FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM skills_v WHERE contains(lower(name), 'er') OR contains(lower(description), 'er')) WHERE r <= 5
UNION ALL SELECT 'context', uri, 0.3 FROM (SELECT uri, row_number() OVER (ORDER BY uri) AS r FROM nodes_v WHERE contains(lower(name), 'er') OR contains(lower(abstract), 'er')) WHERE r <= 5"""


@query("multi_store_search", with_views(_STORES))
def multi_store_search(spark, sf):
    out = None
    for store, name, fields, key in (("memory", "memories_v", ["content"], "id"), ("skill", "skills_v", ["name", "description"], "id"), ("context", "nodes_v", ["name", "abstract"], "uri")):
        score = ranking.keyword_score(fields, ["er"]) * ranking.WEIGHTS[store]["keyword"]
        rows = view(spark, sf, name).select(F.lit(store).alias("store"), F.col(key).alias("id"), score.alias("score")).filter("score > 0")
        out = rows if out is None else out.unionByName(rows)
    return lists.topk_minscore(out, 5, by=["store"])


@query("fuzzy_terms", with_views("SELECT id, round((CASE WHEN len(list_filter(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: levenshtein(x, 'stel') <= 1)) > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN len(list_filter(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: levenshtein(x, 'brnd') <= 1)) > 0 THEN 1.0 ELSE 0.0 END) / 2 + CASE WHEN contains(lower(description), 'brand#1') THEN 0.5 ELSE 0.0 END, 6) AS score FROM skills_v"))
def fuzzy_terms(spark, sf):
    return ranking.fuzzy_terms(view(spark, sf, "skills_v"), "description", ["stel", "brnd"], 1, "Brand#1", 0.5).select("id", "score")


@query("code_search", with_views("SELECT regexp_replace(uri, '^node://tpch/?', '') AS path FROM nodes_v WHERE starts_with(uri, 'node://tpch') AND contains(lower(name), 'a') ORDER BY uri LIMIT 100"))
def code_search(spark, sf):
    rows = view(spark, sf, "nodes_v").filter(F.col("uri").startswith("node://tpch") & F.lower("name").contains("a"))
    return rows.orderBy("uri").limit(100).select(F.regexp_replace("uri", "^node://tpch/?", "").alias("path"))


@query("find_symbol_rows", with_views("SELECT uri, name FROM nodes_v WHERE contains(lower(name), 'customer#00000001') OR lower(name) = 'china' ORDER BY CASE WHEN lower(name) = 'china' THEN 0 ELSE 1 END, name, uri LIMIT 10"))
def find_symbol_rows(spark, sf):
    low = F.lower("name")
    rows = view(spark, sf, "nodes_v").filter(low.contains("customer#00000001") | (low == "china"))
    return rows.orderBy(F.when(low == "china", 0).otherwise(1), "name", "uri").limit(10).select("uri", "name")


@query("union_stores", with_views("SELECT id, store FROM (SELECT id, store, row_number() OVER (PARTITION BY id ORDER BY store) AS r FROM (SELECT id, 'memory' AS store FROM memories_v WHERE importance > 3 UNION ALL SELECT id, 'other' FROM memories_v WHERE owner = 'user' UNION ALL SELECT id, 'skill' FROM skills_v)) WHERE r = 1"))
def union_stores(spark, sf):
    memories = view(spark, sf, "memories_v")
    groups = [(memories.filter("importance > 3"), "memory"), (memories.filter("owner = 'user'"), "other"), (view(spark, sf, "skills_v"), "skill")]
    rows = None
    for df, store in groups:
        one = df.select("id", F.lit(store).alias("store"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.min("store").alias("store"))


@query("router_candidates", "SELECT a.doc_id AS doc_id, CASE WHEN a.n_chars >= 3000 THEN 'update' ELSE 'create' END AS action FROM documents a")
def router_candidates(spark, sf):
    docs = table(spark, sf, "documents")
    candidates = docs.filter("n_chars >= 3000").select("doc_id", F.lit(0.8).alias("score")).filter("score >= 0.75")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score")))
    kept = candidates.withColumn("place", place).filter("place <= 4").select("doc_id").distinct().withColumn("action", F.lit("update"))
    return docs.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("action", F.lit("create")).alias("action"))
