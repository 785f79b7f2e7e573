
import functools

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import evaluation, ranking, similarity

# The texts, queries and expected results of the cases.
TEXTS = [
    ("memory", "auth", "Use JWT tokens with 1-hour expiry for session authentication. Refresh tokens are stored server-side and rotated on each use."),
    ("memory", "testing", "All unit tests use table-driven test patterns in Go. Each test function covers a single behaviour and uses t.Run for subtests."),
    ("memory", "db", "Database connections use a connection pool with max 20 connections. Queries timeout after 5 seconds."),
    ("memory", "perf", "Cache API responses in Redis with 5-minute TTL to reduce latency. Use cache-aside pattern and invalidate on write."),
    ("memory", "style", "Code formatting follows gofmt conventions. All exported functions must have a doc comment."),
    ("memory", "scraper-1", "The web scraper uses Puppeteer for dynamic pages and cheerio for static HTML. Rate limiting is set to 1 request per second."),
    ("memory", "scraper-2", "Use Markdown extraction when scraping documentation pages. Convert all code blocks to properly fenced markdown blocks."),
    ("skill", "auth-handler", "auth-handler Handles JWT token creation, validation, and refresh for user authentication flows."),
    ("skill", "semantic-search", "semantic-search Hybrid vector and keyword search for knowledge retrieval with re-ranking."),
    ("skill", "db-migrator", "db-migrator Manages database schema migrations, connection pooling, and query timeouts."),
    ("context", "backend", "Backend Architecture Core backend services including API gateway, authentication middleware, and database layer. The backend is structured around three layers: API gateway handles routing and rate limiting, auth middleware validates JWT tokens, and the data layer uses SQLite with a connection pool."),
    ("context", "backend/auth", "Auth Module JWT-based authentication using RSA-256 signatures with refresh token rotation. Tokens are issued with a 1-hour expiry. Refresh tokens are stored in a server-side store keyed by user ID and rotated on each use to prevent replay attacks."),
]
CASES = [
    ("auth-mem", "memory", "JWT authentication tokens", ["auth"]),
    ("testing-mem", "memory", "how to write Go tests", ["testing"]),
    ("db-mem", "memory", "database connection pool", ["db"]),
    ("auth-skill", "skill", "token validation and authentication", ["auth-handler"]),
    ("auth-ctx", "context", "authentication architecture", ["backend/auth", "backend"]),
    ("scraper-mem", "memory", "web page scraping dynamic content puppeteer markdown", ["scraper-1", "scraper-2"]),
]
PUBLISHED = {"mrr": 0.833, "recall": 0.75, "precision": 0.2, "ndcg": 0.769, "average_precision": 0.75}


def light(texts, query):
    return similarity.tfidf_stemmed(texts, ranking.query_tokens(query))


@pytest.mark.parametrize("find", [light, similarity.stemmed_search])
def test_published_figures(spark, find):
    texts = spark.createDataFrame(TEXTS, "store string, doc_id string, text string")
    cases = spark.createDataFrame([c[:3] for c in CASES], "case_id string, store string, query string")
    expected = spark.createDataFrame([(c[0], x) for c in CASES for x in c[3]], "case_id string, id string")

    def search(cases: DataFrame, k: int) -> DataFrame:
        each = [
            find(texts.filter(F.col("store") == c.store), c.query).select(F.lit(c.case_id).alias("case_id"), F.col("doc_id").alias("id"), "score")
            for c in cases.collect()
        ]
        order = Window.partitionBy("case_id").orderBy(F.desc("score"), "id")
        return functools.reduce(DataFrame.unionByName, each).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    got = evaluation.summary(evaluation.evaluate(cases, expected, search, 5), 0.8, 0.75).first()
    assert got.cases == 6 and got.passed
    assert all(got[name] >= figure for name, figure in PUBLISHED.items()), got
    print(got)
