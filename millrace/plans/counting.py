"""Aggregates and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import counting, lists, state
from millrace.plans.registry import query
from millrace.sources.shared import new_folder
from millrace.sources.views import table, view, with_views
from millrace.streaming.jobs import index_table, project

AS_OF = "2024-01-20 00:00:00"


def _now():
    return F.to_timestamp(F.lit(AS_OF))


def _stores(spark, sf):
    return {"memory": view(spark, sf, "memories_v"), "skill": view(spark, sf, "skills_v")}


@query("shell_stats", with_views("SELECT command, count(*) AS n, CAST(floor(avg(duration_ms)) AS BIGINT) AS avg_ms, round(avg(CASE WHEN exit_code = 0 THEN 1.0 ELSE 0.0 END), 6) AS success FROM shell_v GROUP BY command ORDER BY n DESC, command LIMIT 20"))
def shell_stats(spark, sf):
    return counting.shell_stats(view(spark, sf, "shell_v"))


@query("dashboard_counts", with_views("SELECT 'memory' AS store, least(count(*), 200) AS n FROM memories_v UNION ALL SELECT 'skill', least(count(*), 200) FROM skills_v"))
def dashboard_counts(spark, sf):
    return counting.row_counts(_stores(spark, sf), 200)


@query("store_stats", with_views("SELECT 'memory' AS store, count(*) AS n FROM memories_v UNION ALL SELECT 'skill', count(*) FROM skills_v"))
def store_stats(spark, sf):
    return counting.row_counts(_stores(spark, sf))


@query("overview_distributions", with_views("SELECT 'category' AS kind, category AS value, count(*) AS n FROM memories_v GROUP BY category UNION ALL SELECT 'importance', CAST(importance AS VARCHAR), count(*) FROM memories_v GROUP BY importance UNION ALL SELECT 'owner', owner, count(*) FROM memories_v GROUP BY owner UNION ALL SELECT 'all', '', count(*) FROM memories_v"))
def overview_distributions(spark, sf):
    return counting.overview(view(spark, sf, "memories_v"))


@query("budget_check", with_views("SELECT project, 'memory' AS store, count(*) AS n FROM memories_v GROUP BY project HAVING count(*) > 40 UNION ALL SELECT project, 'skill', count(*) FROM skills_v GROUP BY project HAVING count(*) > 75"))
def budget_check(spark, sf):
    return counting.over_budget(_stores(spark, sf) | {"context": view(spark, sf, "nodes_v").withColumn("project", F.lit("tpch"))}, {"memory": 40, "skill": 75})


@query("corpus_info", "WITH r AS (SELECT lang AS ext, greatest(octet_length(encode(text)) // 4, 1) AS tokens, len(string_split(text, chr(10))) AS lines FROM documents) SELECT coalesce(ext, '*') AS ext, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(lines) AS BIGINT) AS lines, round(100.0 * sum(tokens) / (SELECT sum(tokens) FROM r), 2) AS share FROM r GROUP BY ROLLUP (ext)")
def corpus_info(spark, sf):
    return counting.corpus_info(table(spark, sf, "documents").withColumnRenamed("lang", "ext"))


@query("dir_rollup", with_views("WITH p AS (SELECT uri, length(abstract) AS tokens, string_split(uri, '/') AS parts FROM nodes_v), x AS (SELECT tokens, array_to_string(parts[1:n], '/') AS dir FROM p, (SELECT unnest(range(1, 12)) AS n) WHERE n < len(parts)) SELECT dir, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files FROM x GROUP BY dir"))
def dir_rollup(spark, sf):
    return counting.dir_rollup(view(spark, sf, "nodes_v").select(F.col("uri").alias("path"), F.length("abstract").alias("tokens")))


@query("churn", with_views(f"SELECT file, count(*) AS total, count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL '10' DAY) AS recent, round(least(count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL '10' DAY) / 10.0, 1.0), 6) AS score, CASE WHEN count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL '10' DAY) / 10.0 >= 0.5 THEN 'volatile' WHEN count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL '10' DAY) / 10.0 >= 0.1 THEN 'moderate' ELSE 'stable' END AS label FROM commits_v GROUP BY file"))
def churn(spark, sf):
    return counting.churn(view(spark, sf, "commits_v"), _now(), 10)


_RECENT = r"r AS (SELECT *, CASE WHEN regexp_matches(subject, '^(\w+)(?:\(.+?\))?:\s+(.+)') THEN lower(regexp_extract(subject, '^(\w+)(?:\(.+?\))?:\s+(.+)', 1)) ELSE '' END AS prefix, CASE WHEN regexp_matches(subject, '^(\w+)(?:\(.+?\))?:\s+(.+)') THEN regexp_extract(subject, '^(\w+)(?:\(.+?\))?:\s+(.+)', 2) ELSE subject END AS what FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, hash) AS place FROM commits_v) WHERE place <= 20)"


@query("commit_prefixes", with_views(f"WITH {_RECENT} SELECT file, prefix, count(*) AS n FROM r WHERE prefix <> '' GROUP BY file, prefix"))
def commit_prefixes(spark, sf):
    return counting.commit_prefixes(view(spark, sf, "commits_v"))


@query("commit_intent", with_views(f"WITH {_RECENT}, k AS (SELECT file, string_agg(n || ' ' || prefix, ', ' ORDER BY prefix) AS kinds FROM (SELECT file, prefix, count(*) AS n FROM r WHERE prefix <> '' GROUP BY file, prefix) GROUP BY file), w AS (SELECT file, count(*) AS n, string_agg(what, '; ' ORDER BY place) FILTER (WHERE place <= 5) AS newest FROM r GROUP BY file) SELECT w.file AS file, 'Commit history (' || n || ' commits): ' || coalesce(kinds, '') || '. Recent: ' || newest AS intent FROM w LEFT JOIN k ON w.file = k.file"))
def commit_intent(spark, sf):
    return counting.commit_intent(view(spark, sf, "commits_v"))


@query("diff_stats", "SELECT doc_id, len(list_filter(string_split('+' || replace(text, '. ', chr(10) || '-'), chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS additions, len(list_filter(string_split('+' || replace(text, '. ', chr(10) || '-'), chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS deletions FROM documents")
def diff_stats(spark, sf):
    diffs = table(spark, sf, "documents").withColumn("diff", F.concat(F.lit("+"), F.replace("text", F.lit(". "), F.lit("\n-"))))
    return counting.diff_stats(diffs).select("doc_id", "additions", "deletions")


@query("session_stats", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, count(*) FILTER (WHERE role = 'system') AS n_system, CAST(sum(octet_length(encode(text))) AS BIGINT) AS chars, CAST(ceil(sum(octet_length(encode(text))) / 4) AS BIGINT) AS tokens, round(ceil(sum(octet_length(encode(text))) / 4) / 8000.0, 6) AS share FROM conversations GROUP BY conv_id")
def session_stats(spark, sf):
    return counting.session_stats(table(spark, sf, "conversations"))


@query("top_tools", with_views("SELECT tool, count(*) AS n FROM calls_v GROUP BY tool ORDER BY n DESC, tool LIMIT 5"))
def top_tools(spark, sf):
    return counting.top_values(view(spark, sf, "calls_v"), "tool")


@query("merge_last_wins", with_views("WITH k AS (SELECT key, value, f || key AS pos FROM (SELECT 1 AS f, key, value FROM kv_a_v UNION ALL SELECT 2, key, value FROM kv_b_v)) SELECT key, max_by(value, pos) AS value, min(pos) AS pos FROM k GROUP BY key"))
def merge_last_wins(spark, sf):
    both = view(spark, sf, "kv_a_v").withColumn("f", F.lit("1")).union(view(spark, sf, "kv_b_v").withColumn("f", F.lit("2")))
    return counting.merge_last_wins(both.withColumn("pos", F.concat("f", "key")).drop("f"))


@query("crawl_report", "SELECT count(*) AS pages, count(*) FILTER (WHERE html LIKE '%<article>%') AS stored, count(*) FILTER (WHERE url LIKE '%#%') AS skipped, count(*) FILTER (WHERE html IS NULL) AS errors FROM pages")
def crawl_report(spark, sf):
    return counting.flags(table(spark, sf, "pages"), {"pages": F.lit(True), "stored": F.col("html").contains("<article>"), "skipped": F.col("url").contains("#"), "errors": F.col("html").isNull()})


@query("distinct_first_hash", with_views("SELECT id, command FROM (SELECT id, command, row_number() OVER (PARTITION BY sha256(command) ORDER BY created_at, id) AS r FROM shell_v) WHERE r = 1"))
def distinct_first_hash(spark, sf):
    return counting.distinct_first(view(spark, sf, "shell_v"), "command", ["created_at", "id"]).select("id", "command")


@query("largest_files", "SELECT doc_id, octet_length(encode(text)) // 4 AS tokens FROM documents ORDER BY tokens DESC, doc_id LIMIT 25")
def largest_files(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.octet_length("text") / 4).cast("long").alias("tokens"))
    return rows.orderBy(F.desc("tokens"), "doc_id").limit(25)


@query("match_limits", with_views("SELECT doc_id, line_no FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines_v WHERE contains(line, 'th')) WHERE r <= 2 ORDER BY doc_id, line_no LIMIT 500"))
def match_limits(spark, sf):
    return lists.match_limits(view(spark, sf, "lines_v").filter(F.col("line").contains("th")), 2, 500).select("doc_id", "line_no")


@query("token_budget", with_views("SELECT doc_id, line_no, running FROM (SELECT doc_id, line_no, CAST(sum(octet_length(encode(line)) + 30) OVER (ORDER BY doc_id, line_no) AS BIGINT) AS running FROM lines_v) WHERE running <= 400000"))
def token_budget(spark, sf):
    return lists.token_budget(view(spark, sf, "lines_v"), 100_000, F.octet_length("line") + 30).select("doc_id", "line_no", "running")


_PATCH = "(SELECT id, CASE WHEN importance > 5 THEN '' ELSE 'new' END AS content, importance - 4 AS importance FROM memories_v WHERE owner = 'user')"


@query("partial_update", with_views(f"SELECT m.id AS id, sha256(coalesce(nullif(p.content, ''), m.content)) AS content, CASE WHEN p.importance > 0 THEN p.importance ELSE m.importance END AS importance FROM memories_v m LEFT JOIN {_PATCH} p ON m.id = p.id"))
def partial_update(spark, sf):
    rows = view(spark, sf, "memories_v").select("id", "content", "importance", "owner")
    patch = rows.filter("owner = 'user'").select("id", F.when(F.col("importance") > 5, "").otherwise("new").alias("content"), (F.col("importance") - 4).alias("importance"))
    return state.partial_update(rows, patch, "id", ["content"], ["importance"]).select("id", F.sha2("content", 256).alias("content"), "importance")


@query("upsert_nodes", with_views("SELECT uri, CASE WHEN starts_with(name, 'A') THEN 'changed' ELSE abstract END AS abstract, CAST(CASE WHEN starts_with(name, 'A') THEN 2 ELSE 1 END AS BIGINT) AS version FROM nodes_v UNION ALL SELECT uri || '/new', 'changed', 1 FROM nodes_v WHERE starts_with(name, 'E')"))
def upsert_nodes(spark, sf):
    nodes = view(spark, sf, "nodes_v")
    current = nodes.select("uri", "abstract", F.lit(1).alias("version"))
    incoming = nodes.filter("name like 'A%'").select("uri", F.lit("changed").alias("abstract")).union(nodes.filter("name like 'E%'").select(F.concat("uri", F.lit("/new")), F.lit("changed")))
    return state.upsert(current, incoming, "uri")


@query("delete_keys", with_views("SELECT id FROM memories_v WHERE importance <> 3"))
def delete_keys(spark, sf):
    rows = view(spark, sf, "memories_v")
    return state.delete_keys(rows, rows.filter("importance = 3"), "id").select("id")




@query("feedback_update", with_views(f"SELECT m.id AS id, list_reduce(list_prepend(any_value(m.importance), list(f.reward ORDER BY f.ts, f.event_id)), lambda o, r: least(greatest(CAST(floor(o + 0.5 * (r - o) + 0.5) AS INT), 1), 10)) AS importance, CAST(count(*) AS INT) AS feedback_count FROM memories_v m JOIN feedback_v f ON m.id = f.id WHERE f.kind = 'feedback' GROUP BY m.id"))
def feedback_update(spark, sf):
    return state.feedback_update(view(spark, sf, "memories_v").select("id", "importance"), view(spark, sf, "feedback_v").filter("kind = 'feedback'"))


_DECAY = """WITH RECURSIVE e AS (SELECT m.id AS id, m.importance AS importance, f.kind AS kind, row_number() OVER (PARTITION BY m.id ORDER BY f.ts, f.event_id) AS k FROM memories_v m JOIN feedback_v f ON m.id = f.id),
s(id, k, imp, got, fed) AS (SELECT DISTINCT id, CAST(0 AS BIGINT), importance, 0, 0 FROM e
UNION ALL SELECT s.id, e.k, CASE WHEN e.kind = 'retrieval' AND s.imp > 3 AND s.got + 1 - 10 * s.fed > 0 AND (s.got + 1 - 10 * s.fed) % 10 = 0 THEN greatest(CAST(floor(s.imp + 0.1 * (3 - s.imp) + 0.5) AS INT), 1) ELSE s.imp END,
s.got + CASE WHEN e.kind = 'retrieval' THEN 1 ELSE 0 END, s.fed + CASE WHEN e.kind = 'retrieval' THEN 0 ELSE 1 END FROM s JOIN e ON e.id = s.id AND e.k = s.k + 1)
SELECT id, max_by(imp, k) AS importance, max_by(got, k) AS retrieval_count, max_by(fed, k) AS feedback_count FROM s GROUP BY id"""


@query("retrieval_decay", with_views(_DECAY))
def retrieval_decay(spark, sf):
    return state.retrieval_decay(view(spark, sf, "memories_v").select("id", "importance"), view(spark, sf, "feedback_v"))


@query("outbox_backlog", with_views(f"SELECT id, op_type, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 >= 8 THEN 'dead' ELSE 'pending' END AS state, CAST(pow(2, least(6, retry_count + 1)) AS INT) AS delay_s FROM outbox_v WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '{AS_OF}' ORDER BY id LIMIT 50"))
def outbox_backlog(spark, sf):
    return state.outbox_backlog(view(spark, sf, "outbox_v"), _now())


_ATTEMPTS = "SELECT id, id % 3 <> 0 AS ok, CASE WHEN id % 3 = 0 THEN repeat('no answer ', 90 + id % 5) END AS error FROM outbox_v WHERE id % 4 <> 1"


@query("outbox_effects", with_views(f"SELECT o.id AS id, CASE WHEN ok THEN 'done' WHEN NOT ok AND retry_count + 1 >= 8 THEN 'dead_letter' ELSE 'pending' END AS status, retry_count + CASE WHEN NOT ok THEN 1 ELSE 0 END AS retry_count, CASE WHEN NOT ok THEN TIMESTAMP '{AS_OF}' + to_seconds(CAST(pow(2, least(6, retry_count + 1)) AS INT)) ELSE CAST(next_attempt_at AS TIMESTAMP) END AS next_attempt_at, CASE WHEN NOT ok THEN length(left(error, 800)) END AS error_length FROM outbox_v o LEFT JOIN ({_ATTEMPTS}) a ON a.id = o.id"))
def outbox_effects(spark, sf):
    box = view(spark, sf, "outbox_v")
    results = box.filter("id % 4 <> 1").selectExpr("id", "id % 3 <> 0 as ok", "case when id % 3 = 0 then repeat('no answer ', cast(90 + id % 5 as int)) end as error")
    return state.outbox_effects(box, results, _now()).select("id", "status", "retry_count", F.col("next_attempt_at").cast("timestamp"), F.length("last_error").alias("error_length"))


@query("outbox_counts", with_views(f"SELECT status, count(*) AS n, max(retry_count) AS most_retries FROM (SELECT CASE WHEN ok THEN 'done' WHEN NOT ok AND retry_count + 1 >= 8 THEN 'dead_letter' ELSE 'pending' END AS status, retry_count + CASE WHEN NOT ok THEN 1 ELSE 0 END AS retry_count FROM outbox_v o LEFT JOIN ({_ATTEMPTS}) a ON a.id = o.id) GROUP BY status"))
def outbox_counts(spark, sf):
    box = view(spark, sf, "outbox_v")
    results = box.filter("id % 4 <> 1").selectExpr("id", "id % 3 <> 0 as ok", "cast(null as string) as error")
    return state.outbox_counts(state.outbox_effects(box, results, _now()))


@query("cdc_latest_state", with_views("SELECT entity_type, entity_id, payload, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id DESC) AS r FROM outbox_v) WHERE r = 1 AND op_type <> 'delete'"))
def cdc_latest_state(spark, sf):
    return state.cdc_latest_state(view(spark, sf, "outbox_v"))


@query("projected_index", with_views("SELECT entity_type, CAST(entity_id AS VARCHAR) AS entity_id, payload, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id DESC) AS r FROM outbox_v) WHERE r = 1 AND op_type <> 'delete'"))
def projected_index(spark, sf):
    """The index after three batches of the outbox, the last of them sent twice: parts of rows by bucket instead of one replay."""
    box = view(spark, sf, "outbox_v")
    index = index_table(spark, new_folder(spark, "index"), buckets=8, most_parts=2)
    for number, part in enumerate((0, 2, 1, 1)):
        project(index, box.filter(F.col("id") % 3 == part), min(number, 2))
    return index.rows()


@query("payload_hash", with_views("SELECT id, md5(payload) AS payload_hash, coalesce(lag(md5(payload)) OVER (PARTITION BY entity_id ORDER BY id) = md5(payload), false) AS noop FROM outbox_v"))
def payload_hash(spark, sf):
    return state.payload_changes(view(spark, sf, "outbox_v")).select("id", "payload_hash", "noop")


@query("audit_trail", with_views("SELECT 'create' AS action, 'agent' AS actor, id AS entity_id, '{\"id\":\"' || id || '\"}' AS details FROM memories_v"))
def audit_trail(spark, sf):
    return state.audit_trail(view(spark, sf, "memories_v"), "create", "agent")


_OPS = "SELECT user_id AS plan, event_id AS pos, CASE event_type WHEN 'view' THEN 'create_memory' WHEN 'click' THEN 'update_node' WHEN 'error' THEN 'format_disk' ELSE 'delete_skill' END AS op, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE props END AS description FROM events"


@query("mutation_plan_filter", f"SELECT plan, pos, op FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY pos) AS r FROM ({_OPS}) WHERE op <> 'format_disk' AND trim(description) <> '') WHERE r <= 10")
def mutation_plan_filter(spark, sf):
    op = F.when(F.col("event_type") == "view", "create_memory").when(F.col("event_type") == "click", "update_node").when(F.col("event_type") == "error", "format_disk").otherwise("delete_skill")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("plan"), F.col("event_id").alias("pos"), op.alias("op"), F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("props")).alias("description"))
    return state.mutation_plan_filter(rows, 10).select("plan", "pos", "op")


_MUTATIONS = "SELECT entity_id AS id, CASE op_type WHEN 'delete' THEN 'delete' WHEN 'upsert' THEN CASE WHEN id % 2 = 0 THEN 'create' ELSE 'update' END END AS op, payload AS content, id AS pos FROM outbox_v"


@query("apply_mutations", with_views(f"WITH o AS ({_MUTATIONS}), l AS (SELECT id, max_by(op, pos) AS op, max_by(content, pos) AS content FROM o GROUP BY id) SELECT coalesce(m.id, l.id) AS id, sha256(coalesce(nullif(l.content, ''), m.content)) AS content FROM memories_v m FULL JOIN l ON m.id = l.id WHERE coalesce(l.op <> 'delete', true) AND (m.content IS NOT NULL OR coalesce(l.op = 'create', false))"))
def apply_mutations(spark, sf):
    box = view(spark, sf, "outbox_v")
    op = F.when(F.col("op_type") == "delete", "delete").when(F.col("id") % 2 == 0, "create").otherwise("update")
    ops = box.select(F.col("entity_id").alias("id"), op.alias("op"), F.col("payload").alias("content"), F.col("id").alias("pos"))
    return state.apply_mutations(view(spark, sf, "memories_v").select("id", "content"), ops).select("id", F.sha2("content", 256).alias("content"))


@query("read_kv_files", "SELECT s_suppkey AS line_no, s_name AS key, CAST(s_nationkey AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 3 <> 0")
def read_kv_files(spark, sf):
    from millrace.sources.logs import parse_kv

    name, value = F.col("s_name"), F.col("s_nationkey").cast("string")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("# "), name)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("export "), name, F.lit("='"), value, F.lit("'"))).otherwise(F.concat(name, F.lit("="), value))
    return parse_kv(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line_no"), line.alias("line"))).select("line_no", "key", "value")
