"""Adapter views: the library's row shapes on top of the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "memories_v": """
SELECT concat('mem_', CAST(doc_id AS STRING)) AS id, source AS project, text AS content, lang AS category, CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' ELSE 'system' END AS owner, CAST(1 + doc_id % 10 AS INT) AS importance, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS created_at
FROM documents""",
    "skills_v": """
SELECT concat('skill_', CAST(p_partkey AS STRING)) AS id, p_brand AS project, p_name AS name, concat(p_type, ' ', p_brand) AS description
FROM part""",
    "nodes_v": """
SELECT 'node://tpch' AS uri, CAST(NULL AS STRING) AS parent_uri, 'tpch' AS name, 'root' AS abstract
UNION ALL SELECT concat('node://tpch/', r_name), 'node://tpch', r_name, concat('region ', r_name)
FROM region
UNION ALL SELECT concat('node://tpch/', r_name, '/', n_name), concat('node://tpch/', r_name), n_name, concat('nation ', n_name)
FROM nation
JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('node://tpch/', r_name, '/', n_name, '/', c_name), concat('node://tpch/', r_name, '/', n_name), c_name, concat('customer ', c_mktsegment)
FROM customer
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""",
    "shell_v": """
SELECT concat('bash_', CAST(event_id AS STRING)) AS id, concat('p', CAST(user_id % 5 AS STRING)) AS project, concat(event_type, ' ', CAST(user_id % 7 AS STRING)) AS command, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, CAST(floor(value * 100) AS INT) AS duration_ms, props AS output, ts AS created_at
FROM events""",
    "commits_v": """
SELECT md5(CAST(event_id AS STRING)) AS hash, concat('src/f', CAST(user_id % 40 AS STRING), '.go') AS file, user_id AS author, CASE event_type WHEN 'error' THEN concat('fix: ', props) WHEN 'purchase' THEN concat('feat(core): ', props) WHEN 'signup' THEN concat('docs: ', props) ELSE props END AS subject, ts
FROM events""",
    "calls_v": """
SELECT user_id AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS tool, ts
FROM events""",
    "edges_v": """
SELECT DISTINCT concat('part:', CAST(l_partkey AS STRING)) AS src, concat('supp:', CAST(l_suppkey AS STRING)) AS dst
FROM lineitem
WHERE l_linenumber = 1 AND l_quantity >= 50""",
    "flow_edges_v": """
SELECT concat('cust:', CAST(c_custkey AS STRING)) AS src, concat('nation:', CAST(c_nationkey AS STRING)) AS dst
FROM customer
UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), concat('region:', CAST(n_regionkey AS STRING))
FROM nation""",
    "feedback_v": """
SELECT concat('mem_', CAST(user_id AS STRING)) AS id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'feedback' ELSE 'retrieval' END AS kind, CAST(1 + event_id % 10 AS INT) AS reward
FROM events
WHERE event_type IN ('purchase', 'view')""",
    "outbox_v": """
SELECT event_id AS id, 'memory' AS entity_type, concat('mem_', CAST(user_id AS STRING)) AS entity_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op_type, props AS payload, 'pending' AS status, CAST(event_id % 9 AS INT) AS retry_count, ts AS next_attempt_at
FROM events""",
    "kv_a_v": """
SELECT s_name AS key, CAST(s_nationkey AS STRING) AS value
FROM supplier
WHERE s_suppkey % 10 < 7""",
    "kv_b_v": """
SELECT s_name AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE CAST(s_nationkey AS STRING) END AS value
FROM supplier
WHERE s_suppkey % 10 > 2""",
    "sessions_v": """
SELECT page_id % 20 AS session_id, page_id, url, html, TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '20' SECOND AS ts
FROM pages""",
    "queries_v": """
SELECT vec_id AS case_id, embedding AS query_vec, label
FROM embeddings
WHERE vec_id % 50 = 0""",
}
# Fixed SQL that differs: numbered lines of the documents.
_LINES = {
    "spark": "SELECT doc_id, pos + 1 AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, line",
    "duckdb": "SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of that name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = _LINES["spark"] if name == "lines_v" else VIEWS[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put in front."""
    both = VIEWS | {"lines_v": _LINES["duckdb"]}
    used = [f"{v} AS ({q.strip()})" for v, q in both.items() if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + body[len("WITH RECURSIVE") :]
    return "WITH " + ", ".join(used) + (", " + body[4:] if body.upper().startswith("WITH") else " " + body)
