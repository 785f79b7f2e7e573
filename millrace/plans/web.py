"""Pages, histories, snapshots and sessions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.redact import SECRET_NAMES
from millrace.operators import code, history, sessions, similarity, web
from millrace.plans.registry import query
from millrace.sources import issues, logs
from millrace.sources.views import table, view, with_views

_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)'"
_SLUG = f"regexp_replace(regexp_replace(lower(regexp_extract(url, {_U}, 2)), '^www\\.', ''), '[.:]', '-', 'g')"
_LINK = r"l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query("domain_slug", f"SELECT page_id, {_SLUG} AS slug FROM pages")
def domain_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.domain_slug(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("slug"))


@query("normalize_url", f"SELECT page_id, regexp_replace(regexp_extract(url, {_U}, 1) || '://' || regexp_extract(url, {_U}, 2) || regexp_extract(url, {_U}, 3), '/$', '') AS clean FROM pages")
def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.normalize_url("url").alias("clean"))


_URI = f"'node://scraped/' || {_SLUG} || list_aggregate(list_prepend('', list_transform(list_filter(string_split(regexp_extract(url, {_U}, 3), '/'), lambda p: p <> ''), lambda p: '/' || url_encode(lower(p)))), 'string_agg', '')"


@query("url_to_uri", f"SELECT page_id, {_URI} AS uri FROM pages")
def url_to_uri(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_to_uri("url").alias("uri"))


@query("url_parent_uri", f"WITH u AS (SELECT page_id, {_URI} AS uri FROM pages) SELECT page_id, CASE WHEN len(string_split(uri, '/')) > 4 THEN regexp_replace(uri, '/[^/]*$', '') END AS parent FROM u")
def url_parent_uri(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.parent_uri(text.url_to_uri("url")).alias("parent"))


@query("resolve_links", f"WITH {_LINK} SELECT DISTINCT page_id, regexp_replace(CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END, '#.*$', '') AS link FROM l")
def resolve_links(spark, sf):
    return web.resolve_links(table(spark, sf, "pages")).select("page_id", "link")


@query("link_filter", f"WITH {_LINK} SELECT DISTINCT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href AS link FROM l WHERE regexp_matches(href, '^/[a-z]')")
def link_filter(spark, sf):
    pages = table(spark, sf, "pages")
    links = web.resolve_links(pages).join(pages.select("page_id", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("host")), "page_id")
    return web.keep_links(links, F.col("host"), "^/[a-z]").select("page_id", "link")


_MINIFY = "html"
for _t in ("script", "style", "svg", "noscript", "iframe"):
    _MINIFY = rf"regexp_replace({_MINIFY}, '(?is)<{_t}\b[^>]*>.*?</{_t}\s*>', '', 'g')"


@query("minify_html", rf"SELECT page_id, md5(replace(regexp_replace(regexp_replace({_MINIFY}, '(?i)<(?:meta|link|path)\b[^>]*>', '', 'g'), '\s+', ' ', 'g'), '> <', '><')) AS small FROM pages")
def minify_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(web.minify_html("html")).alias("small"))


@query("page_metadata", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
def page_metadata(spark, sf):
    return web.page_metadata(table(spark, sf, "pages")).select("page_id", "title", "lang")


@query("html_sections")
def html_sections(spark, sf):
    return web.html_sections(table(spark, sf, "pages"))


@query("sync_payload")
def sync_payload(spark, sf):
    pages = table(spark, sf, "pages")
    return web.sync_payload(pages, web.html_sections(pages))


@query("page_rank_lookup")
def page_rank_lookup(spark, sf):
    pages = table(spark, sf, "pages")
    return web.page_rank_lookup(pages.select("page_id", F.length("html").alias("score")), pages, web.html_sections(pages))


#: Sections of the whole page by tags: kind and expression.
_SECTION_FORMS = {"heading": r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", "code": r"(?is)<pre\b[^>]*>(.*?)</pre>", "list": r"(?is)<li\b[^>]*>(.*?)</li>", "paragraph": r"(?is)<p\b[^>]*>(.*?)</p>"}
_PARTS = "(" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(html, '{form}', 1)) AS text FROM pages" for k, form in _SECTION_FORMS.items()) + ")"


@query("page_importance", f"WITH s AS (SELECT page_id, least(sum(octet_length(encode(text))) / 2500.0, 2.0) + least(sum(CASE kind WHEN 'heading' THEN 0.3 WHEN 'code' THEN 0.5 WHEN 'list' THEN 0.2 ELSE 0 END), 1.5) AS content FROM {_PARTS} GROUP BY page_id) SELECT p.page_id AS page_id, round(least(coalesce(content, 0) + CASE WHEN p.page_id % 2 = 0 THEN 2.0 ELSE 0 END + CASE WHEN p.page_id % 3 = 0 THEN 1.0 ELSE 0 END + least(p.page_id * 900 / 1000.0 / 40.0, 1.5) + least(p.page_id % 30 / 20.0, 1.0), 10.0), 6) AS importance FROM pages p LEFT JOIN s ON p.page_id = s.page_id")
def page_importance(spark, sf):
    pages = table(spark, sf, "pages")
    each = [pages.select("page_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(form), 1)).alias("text")) for kind, form in _SECTION_FORMS.items()]
    sections = functools.reduce(DataFrame.unionByName, each)
    p = F.col("page_id")
    signals = pages.select("page_id", (p % 2 == 0).alias("selection"), F.lit(False).alias("active"), (p % 3 == 0).alias("console_errors"), F.lit(None).cast("boolean").alias("network_errors"), (p * 900).alias("dwell_ms"), (p % 30).alias("interactions"))
    return web.page_importance(sections, signals)


@query("evict_oldest", with_views("SELECT page_id FROM (SELECT page_id, row_number() OVER w AS r, sum(length(html)) OVER w AS b FROM sessions_v WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, page_id DESC)) WHERE r <= 8 AND b <= 30000"))
def evict_oldest(spark, sf):
    return web.evict_oldest(view(spark, sf, "sessions_v").withColumn("bytes", F.length("html")), 8, 30000).select("page_id")


@query("latest_page_per_url", with_views("SELECT session_id, url, max_by(page_id, ts) AS page_id, count(*) AS revision FROM sessions_v GROUP BY session_id, url"))
def latest_page_per_url(spark, sf):
    return web.latest_page_per_url(view(spark, sf, "sessions_v"))


@query("nav_history", with_views("SELECT session_id, page_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, page_id) AS seq, url, lag(url) OVER (PARTITION BY session_id ORDER BY ts, page_id) AS referrer FROM sessions_v"))
def nav_history(spark, sf):
    return web.nav_history(view(spark, sf, "sessions_v"))


def _visits(spark, sf):
    """Pages of a session over and over: the same addresses with other contents, other addresses with the same ones."""
    pages = view(spark, sf, "sessions_v")
    url = F.concat("url", F.lit("#"), (F.col("page_id") % 7).cast("string"))
    prints = similarity.simhash64(pages, "html")
    return prints.select((F.col("page_id") % 5).alias("session_id"), "page_id", url.alias("url"), "ts", "simhash", F.octet_length("html").alias("bytes"))


@query("session_events")
def session_events(spark, sf):
    return sessions.session_events(_visits(spark, sf), 20, 200_000)


_VISITS = "v AS (SELECT page_id % 5 AS session_id, page_id, url || '#' || (page_id % 7) AS url, ts FROM sessions_v)"


@query("session_open_pages", with_views(f"WITH {_VISITS} SELECT session_id, url, max_by(page_id, ts) AS page_id, CAST(count(*) AS INT) AS revision FROM v GROUP BY session_id, url"))
def session_open_pages(spark, sf):
    """Without bounds and near-duplicates: the latest page of each address, its revision the number of visits."""
    return sessions.open_pages(sessions.session_events(_visits(spark, sf), 10**9, 10**15, -1))


@query("session_navigation", with_views(f"WITH {_VISITS}, f AS (SELECT session_id, url, min_by(page_id, ts) AS page_id, min(ts) AS ts FROM v GROUP BY session_id, url) SELECT session_id, page_id, CAST(row_number() OVER w AS INT) AS seq, url, lag(url) OVER w AS referrer FROM f WINDOW w AS (PARTITION BY session_id ORDER BY ts)"))
def session_navigation(spark, sf):
    """An event for newly added pages alone."""
    return sessions.navigation(sessions.session_events(_visits(spark, sf), 10**9, 10**15, -1))


@query("summary_per_session", with_views("SELECT session_id, min(ts) AS started, count(*) AS pages, string_agg(url, ' ' ORDER BY ts, page_id) AS urls FROM sessions_v GROUP BY session_id"))
def summary_per_session(spark, sf):
    return web.summary_per_session(view(spark, sf, "sessions_v"))


@query("stream_minute_dedup", with_views("SELECT max(page_id) AS page_id, url, date_trunc('minute', ts) AS minute FROM sessions_v GROUP BY url, sha1(html), date_trunc('minute', ts)"))
def stream_minute_dedup(spark, sf):
    return web.minute_dedup(view(spark, sf, "sessions_v"))


@query("unchanged_pages", "WITH p AS (SELECT page_id, url || '#' || page_id AS url, html FROM pages), c AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN 'other' ELSE sha1(html) END AS sha1 FROM p WHERE page_id % 7 <> 0) SELECT p.page_id AS page_id, p.url AS url FROM p JOIN c ON p.url = c.url WHERE sha1(p.html) = c.sha1")
def unchanged_pages(spark, sf):
    pages = table(spark, sf, "pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    cache = pages.filter("page_id % 7 <> 0").select("url", F.when(F.col("page_id") % 3 == 0, F.lit("other")).otherwise(F.sha1("html")).alias("sha1"))
    return web.unchanged_pages(pages, cache)


@query("pending_sync", with_views("SELECT page_id FROM sessions_v WHERE md5(html) NOT IN (SELECT md5(html) FROM sessions_v WHERE page_id % 4 = 0)"))
def pending_sync(spark, sf):
    pages = view(spark, sf, "sessions_v").withColumn("print", F.md5("html"))
    return pages.join(pages.filter("page_id % 4 = 0").select("print"), "print", "left_anti").select("page_id")


_RUNS = "WITH r AS (SELECT actor, {call} AS tool, row_number() OVER (PARTITION BY actor ORDER BY seq DESC) AS back FROM calls_v), w AS (SELECT * FROM r WHERE back <= 20), f AS (SELECT actor, max(CASE WHEN back = 1 THEN tool END) AS a, max(CASE WHEN back = 2 THEN tool END) AS b, max(back) AS n FROM w GROUP BY actor), g AS (SELECT w.actor AS actor, a, b, n, coalesce(min(CASE WHEN tool <> a THEN back - 1 END), n) AS run, coalesce(min(CASE WHEN tool <> CASE WHEN back % 2 = 1 THEN a ELSE b END THEN back - 1 END), n) // 2 * 2 AS pairs FROM w JOIN f ON w.actor = f.actor GROUP BY w.actor, a, b, n), v AS (SELECT actor, CAST(run AS INT) AS run, CAST(CASE WHEN a = b THEN 0 ELSE pairs END AS INT) AS alternating FROM g) SELECT *, CASE WHEN run >= 8 THEN 'stop' WHEN run >= 4 THEN 'nudge' WHEN alternating >= 8 THEN 'stop' WHEN alternating >= 6 THEN 'nudge' ELSE 'ok' END AS verdict FROM v"


@query("stuck_runs", with_views(_RUNS.format(call="tool")))
def stuck_runs(spark, sf):
    return history.stuck_runs(view(spark, sf, "calls_v"))


@query("stuck_runs_arguments", with_views(_RUNS.format(call="tool || ' ' || (seq // 5)")))
def stuck_runs_arguments(spark, sf):
    return history.stuck_runs(view(spark, sf, "calls_v").withColumn("args_hash", F.floor(F.col("seq") / 5).cast("string")))


_FILES = "SELECT p_partkey, 'f' || p_partkey AS path, p_size AS f, p_type AS h FROM part"


@query("incremental_diff", f"WITH c AS (SELECT * FROM ({_FILES}) WHERE p_partkey % 5 <> 0), o AS (SELECT path, CASE WHEN p_partkey % 3 = 0 THEN f + 1 ELSE f END AS f0, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE h END AS h0 FROM ({_FILES}) WHERE p_partkey % 7 <> 0) SELECT coalesce(c.path, o.path) AS path, CASE WHEN f0 IS NULL THEN 'new' WHEN f IS NULL THEN 'deleted' WHEN f = f0 THEN 'unchanged' WHEN h = h0 THEN 'touched' ELSE 'changed' END AS status FROM c FULL JOIN o ON c.path = o.path")
def incremental_diff(spark, sf):
    files = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("fingerprint"), F.col("p_type").alias("content_hash"))
    old = files.filter("p_partkey % 7 <> 0")
    old = old.withColumn("fingerprint", F.when(F.col("p_partkey") % 3 == 0, F.col("fingerprint") + 1).otherwise(F.col("fingerprint"))).withColumn("content_hash", F.when(F.col("p_partkey") % 6 == 0, "x").otherwise(F.col("content_hash")))
    return history.incremental_diff(files.filter("p_partkey % 5 <> 0").drop("p_partkey"), old.drop("p_partkey"))


def _masked(key: str, value: str) -> str:
    secret = " OR ".join(f"contains(lower({key}), '{n}')" for n in SECRET_NAMES)
    safe = f"lower(trim({value})) IN ('true', 'false', '1', '0') OR starts_with(lower(trim({value})), 'http://localhost') OR starts_with(lower(trim({value})), 'http://127.0.0.1') OR octet_length(encode({value})) < 8"
    return f"CASE WHEN {value} IS NULL OR NOT ({secret}) AND ({safe}) THEN {value} ELSE '***HIDDEN***' END"


@query("kv_diff", with_views(f"WITH a AS (SELECT CASE WHEN hash_bit = 0 THEN 'API_KEY_' ELSE '' END || key AS key, value FROM (SELECT key, value, ascii(right(key, 1)) % 2 AS hash_bit FROM kv_a_v)), b AS (SELECT CASE WHEN ascii(right(key, 1)) % 2 = 0 THEN 'API_KEY_' ELSE '' END || key AS key, CASE WHEN value = 'x' THEN 'a longer value' ELSE value END AS value FROM kv_b_v) SELECT coalesce(a.key, b.key) AS key, {_masked('coalesce(a.key, b.key)', 'a.value')} AS before, {_masked('coalesce(a.key, b.key)', 'b.value')} AS after, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.key = b.key"))
def kv_diff(spark, sf):
    secret = F.when(F.ascii(F.right("key", F.lit(1))) % 2 == 0, "API_KEY_").otherwise("")
    a, b = (view(spark, sf, v).withColumn("key", F.concat(secret, "key")) for v in ("kv_a_v", "kv_b_v"))
    return history.kv_diff(a, b.withColumn("value", F.when(F.col("value") == "x", "a longer value").otherwise(F.col("value"))))


@query("snapshot_reuse", with_views("SELECT hash, file FROM commits_v WHERE hash || file NOT IN (SELECT hash || file FROM commits_v WHERE author % 3 = 0)"))
def snapshot_reuse(spark, sf):
    files = view(spark, sf, "commits_v").select("hash", "file", "author")
    return files.join(files.filter("author % 3 = 0").select("hash", "file"), ["hash", "file"], "left_anti").select("hash", "file")


@query("commit_file_cap", with_views("SELECT file, hash FROM (SELECT file, hash, row_number() OVER (PARTITION BY author ORDER BY hash) AS r FROM commits_v) WHERE r <= 50"))
def commit_file_cap(spark, sf):
    place = F.row_number().over(Window.partitionBy("author").orderBy("hash"))
    return view(spark, sf, "commits_v").withColumn("place", place).filter("place <= 50").select("file", "hash")


@query("git_nodes", with_views("SELECT 'node://p/git/commit/' || hash AS uri, 'node://p/git' AS parent_uri FROM commits_v UNION ALL SELECT 'node://p/git/snapshot/' || hash || '/' || file, 'node://p/git/commit/' || hash FROM commits_v"))
def git_nodes(spark, sf):
    commits = view(spark, sf, "commits_v")
    commit = F.concat(F.lit("node://p/git/commit/"), "hash")
    snapshot = F.concat(F.lit("node://p/git/snapshot/"), "hash", F.lit("/"), "file")
    return commits.select(commit.alias("uri"), F.lit("node://p/git").alias("parent_uri")).union(commits.select(snapshot, commit))


_DIFF = "CASE WHEN ascii(right(hash, 1)) % 4 <> 0 THEN '--- a' || chr(10) || '+++ b' || chr(10) || '+' || subject || chr(10) || '-x' || chr(10) || '+y' END"
_HEAD = "SELECT hash, file, subject, ts, 'package ' || author AS content, " + _DIFF + " AS diff FROM commits_v"


@query("git_diff_nodes", with_views(f"WITH h AS ({_HEAD}) SELECT 'node://p/git/commit/' || hash AS uri, 'node://p/git' AS parent_uri, 'git_commit' AS kind, left(hash, 7) AS name, subject AS abstract, left(subject, 40) AS content, NULL AS additions, NULL AS deletions FROM h UNION ALL SELECT 'node://p/git/snapshot/' || hash || '/' || file, 'node://p/git/commit/' || hash, 'git_snapshot', string_split(file, '/')[-1], subject, content, NULL, NULL FROM h UNION ALL SELECT 'node://p/git/diff/' || hash || '/' || file, 'node://p/git/commit/' || hash, 'git_diff', string_split(file, '/')[-1], 'Changed ' || file || ': ' || subject, CASE WHEN length(c) > 60 THEN left(c, 60) || chr(10) || chr(10) || '...TRUNCATED' ELSE c END, CASE WHEN diff IS NULL THEN 0 ELSE 2 END, CASE WHEN diff IS NULL THEN 0 ELSE 1 END FROM (SELECT *, coalesce(diff, '') || chr(10) || chr(10) || '--- AST Summary ---' || chr(10) || chr(10) || content AS c FROM h)"))
def git_diff_nodes(spark, sf):
    """Commits, files and diffs as nodes; a diff in four is missing, and contents are cut at 60 characters."""
    commits = view(spark, sf, "commits_v")
    files = commits.select("hash", "file", F.concat(F.lit("package "), F.col("author").cast("string")).alias("content"))
    diffs = commits.filter(F.ascii(F.substring("hash", -1, 1)) % 4 != 0).select("hash", "file", F.concat(F.lit("--- a\n+++ b\n+"), "subject", F.lit("\n-x\n+y")).alias("diff"))
    return history.git_nodes(commits.select("hash", "subject", "ts"), files, diffs, "p", 60).drop("created_at").withColumn("content", F.when(F.col("kind") == "git_commit", F.substring("content", 1, 40)).otherwise(F.col("content")))


@query("resolve_project", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'work' WHEN user_id % 3 = 1 THEN 'u' || user_id ELSE 'deep' END AS project FROM events")
def resolve_project(spark, sf):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    n = F.col("user_id") % 3
    cwd = F.when(n == 0, F.concat(F.lit("/home/work/"), user, F.lit("/src"))).when(n == 1, F.concat(F.lit("/home/git/"), user, F.lit("/src/deep"))).otherwise(F.lit("/tmp/deep"))
    records = table(spark, sf, "events").select("event_id", cwd.alias("cwd"))
    roots = table(spark, sf, "events").filter("user_id % 3 = 1").select(F.concat(F.lit("/home/git/"), user).alias("root")).distinct().withColumn("marker", F.lit("git"))
    markers = roots.union(spark.createDataFrame([("/home/work", "primary")], "root string, marker string"))
    return history.resolve_project(records, markers).select("event_id", "project")


@query("context_budget", with_views("SELECT id FROM (SELECT id, place, sum(n) OVER (PARTITION BY project ORDER BY created_at, id) AS running FROM (SELECT id, project, created_at, length(content) AS n, row_number() OVER (PARTITION BY project ORDER BY created_at, id) AS place FROM memories_v) WHERE place <= 20) WHERE running <= 24000"))
def context_budget(spark, sf):
    return history.context_budget(view(spark, sf, "memories_v"), "project", ["created_at", "id"], F.length("content")).select("id")


@query("read_history_zsh", "SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS ts, event_type || chr(10) || props AS command FROM events")
def read_history_zsh(spark, sf):
    events = table(spark, sf, "events")
    head = F.concat(F.lit(": "), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(":3;"), "event_type", F.lit("\\"))
    lines = events.select("user_id", F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") * 2).alias("line_no"), head.alias("line"))
    lines = lines.union(events.select("user_id", F.concat(F.lit("f"), F.col("user_id").cast("string")), F.col("event_id") * 2 + 1, "props"))
    parsed = logs.parse_zsh(lines.drop("user_id"))
    return parsed.select(F.substring("file", 2, 20).cast("long").alias("user_id"), (F.col("line_no") / 2).cast("long").alias("event_id"), "ts", "command")


@query("read_history_bash", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN floor(epoch(ts))::BIGINT END AS ts, props AS command FROM events")
def read_history_bash(spark, sf):
    events = table(spark, sf, "events")
    file = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    stamps = events.filter("event_id % 2 = 0").select(file.alias("file"), (F.col("event_id") * 2).alias("line_no"), F.concat(F.lit("#"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).alias("line"))
    parsed = logs.parse_bash(stamps.union(events.select(file, F.col("event_id") * 2 + 1, "props")))
    return parsed.select(F.floor(F.col("line_no") / 2).cast("long").alias("event_id"), "ts", "command")


@query("read_git_log", with_views("SELECT hash, subject FROM commits_v WHERE author % 10 <> 0"))
def read_git_log(spark, sf):
    commits = view(spark, sf, "commits_v")
    date = F.when(F.col("author") % 10 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    record = F.concat_ws("\u0000", "hash", date, F.col("author").cast("string"), "subject", F.lit("body"))
    return logs.parse_git_log(commits.select(record.alias("record"))).select("hash", "subject")


@query("source_files", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0 AND p_size * 20000 <= 524288")
def source_files(spark, sf):
    from millrace.sources.files import eligible_files

    key = F.col("p_partkey").cast("string")
    path = F.concat(F.when(F.col("p_partkey") % 4 == 0, "a/node_modules/").otherwise("a/b/"), key, F.when(F.col("p_partkey") % 3 == 0, ".go").otherwise(".txt"))
    return eligible_files(table(spark, sf, "part").select("p_partkey", path.alias("path"), (F.col("p_size") * 20000).alias("size"))).select("p_partkey")


@query("ignore_rules", "SELECT p_partkey FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 5 = 0)")
def ignore_rules(spark, sf):
    from millrace.sources.files import apply_ignore

    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "a/b/").otherwise("c/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".log").otherwise(".go"))
    rules = spark.createDataFrame([("a", r"\.log$")], "dir string, regex string")
    return apply_ignore(table(spark, sf, "part").select("p_partkey", path.alias("path")), rules).select("p_partkey")


@query("project_promote_metadata", "SELECT s_suppkey, s_name AS enrichment_intent FROM supplier")
def project_promote_metadata(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("enrichment_intent"), F.lit(1).alias("x"))).alias("metadata"))
    return rows.select("s_suppkey", F.get_json_object("metadata", "$.enrichment_intent").alias("enrichment_intent"))


@query("stream_shell_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_shell_windows(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


_ISSUES = "SELECT doc_id AS number, 'Doc ' || doc_id AS title, text AS body, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END AS state, doc_id % 3 = 0 AS pr, source, lang FROM documents"


@query("read_issues_github", f"SELECT 'node://p/github/issues/' || number AS uri, CASE WHEN pr THEN 'PR' ELSE 'Issue' END || ' #' || number || ': ' || title AS name, 'GitHub ' || CASE WHEN pr THEN 'PR' ELSE 'Issue' END || ' [' || state || '] | Labels: ' || lang || ', all' AS abstract, md5(CASE WHEN length(body) > 5000 THEN left(body, 5000) || chr(10) || '...(truncated)' ELSE body END) AS content FROM ({_ISSUES} WHERE lang IS NOT NULL)")
def read_issues_github(spark, sf):
    d = table(spark, sf, "documents").filter("lang is not null")
    exported = F.to_json(F.struct(
        F.col("doc_id").alias("number"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("closed").alias("state"),
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"), F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("all").alias("name"))).alias("labels"),
    ))
    rows = d.select(F.from_json(exported, issues.GITHUB).alias("x")).select("x.*")
    return issues.issues_to_nodes(rows, "p").select("uri", "name", "abstract", F.md5("content").alias("content"))


@query("read_issues_linear", f"SELECT 'node://p/linear/issues/D-' || number AS uri, 'Issue D-' || number || ': ' || title AS name, 'Linear Issue [open]' || CASE WHEN number % 5 > 0 THEN ' | Priority: ' || (number % 5) ELSE '' END AS abstract, md5(CASE WHEN length(body) > 5000 THEN left(body, 5000) || chr(10) || '...(truncated)' ELSE body END) AS content FROM ({_ISSUES}) WHERE state = 'open'")
def read_issues_linear(spark, sf):
    key = F.col("doc_id").cast("string")
    exported = F.to_json(F.struct(
        F.concat(F.lit("D-"), key).alias("identifier"), F.concat(F.lit("Doc "), key).alias("title"), F.col("text").alias("description"), F.struct(F.when(F.col("doc_id") % 2 == 0, "open").otherwise("closed").alias("name")).alias("state"),
        (F.col("doc_id") % 5).alias("priority"),
    ))
    rows = table(spark, sf, "documents").select(F.from_json(exported, issues.LINEAR).alias("x")).select("x.*")
    return issues.linear_to_nodes(rows, "p", "Open").select("uri", "name", "abstract", F.md5("content").alias("content"))


def _sources(spark, sf):
    key = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("class C"), key, F.lit(" {\n  m"), key, F.lit("() {}\n  private x() {}\n}\nfunction f"), key, F.lit("() { if (g()) return h(1); }\ndef _d"), key, F.lit("(a): pass\n"))
    return table(spark, sf, "part").select(F.concat(F.lit("src/"), key, F.lit(".ts")).alias("path"), source.alias("source"))


_SYMBOLS = "SELECT 'src/' || k || '.ts' AS path, CASE kind WHEN 'mtd' THEN 'mtd:C' || k || '.' || name ELSE kind || ':' || name END AS id, kind, name FROM (SELECT p_partkey AS k, unnest(['cls', 'fn', 'fn', 'mtd', 'mtd']) AS kind, unnest(['C' || p_partkey, 'f' || p_partkey, '_d' || p_partkey, 'm' || p_partkey, 'x']) AS name FROM part)"


@query("extract_symbols", _SYMBOLS)
def extract_symbols(spark, sf):
    return code.extract_symbols(_sources(spark, sf))


@query("outline_symbols", f"WITH s AS ({_SYMBOLS}) SELECT path, id, kind, name, CASE WHEN kind = 'cls' THEN 'm' || substr(name, 2) || ',x' ELSE '' END AS methods FROM s WHERE kind <> 'mtd' AND NOT starts_with(name, '_')")
def outline_symbols(spark, sf):
    return code.outline(code.extract_symbols(_sources(spark, sf)), exports_only=True).withColumn("methods", F.array_join("methods", ","))


@query("file_summary_text", "SELECT 'src/' || p_partkey || '.ts' AS path, 'File: src/' || p_partkey || '.ts' || chr(10) || 'Language: ts' || chr(10) || 'Symbols: 5' || chr(10) || 'Edges: 1' || chr(10) || 'cls:C' || p_partkey || ', fn:_d' || p_partkey || ', fn:f' || p_partkey || ', mtd:C' || p_partkey || '.m' || p_partkey || ', mtd:C' || p_partkey || '.x' AS overview, '## [cls] C' || p_partkey || chr(10) || '## [fn] _d' || p_partkey || chr(10) || '## [fn] f' || p_partkey || chr(10) || '## [mtd] m' || p_partkey || chr(10) || '## [mtd] x' || chr(10) || 'f' || p_partkey || ' -> g' AS content FROM part")
def file_summary_text(spark, sf):
    files = _sources(spark, sf)
    edges = files.select("path", F.concat(F.lit("f"), F.regexp_extract("path", "([0-9]+)", 1)).alias("src"), F.lit("g").alias("dst"))
    return code.file_summary_text(files, code.extract_symbols(files), edges)
