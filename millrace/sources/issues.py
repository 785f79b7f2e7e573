"""Issue exports of two trackers as node rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GITHUB = (
    "number int, title string, body string, state string, html_url string, pull_request struct<url: string>, user struct<login: string>, "
    "assignees array<struct<login: string>>, labels array<struct<name: string>>, created_at string, updated_at string"
)
LINEAR = (
    "identifier string, title string, description string, url string, state struct<name: string>, priority int, assignee struct<name: string>, "
    "labels struct<nodes: array<struct<name: string>>>, createdAt string, updatedAt string"
)


def _names(c: Column, field: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x[field]), ", ")


def _optional(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _body(c: str) -> Column:
    return F.when(F.length(c) > 5000, F.concat(F.substring(c, 1, 5000), F.lit("\n...(truncated)"))).otherwise(F.col(c))


def issues_to_nodes(issues: DataFrame, project: str) -> DataFrame:
    """Rows read with the GITHUB schema; pull requests are told apart."""
    kind = F.when(F.col("pull_request").isNotNull(), "PR").otherwise("Issue")
    root = f"node://{project}/github"
    overview = F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("URL: "), "html_url"), F.concat(F.lit("Author: "), "user.login"), F.concat(F.lit("Created: "), "created_at"), F.concat(F.lit("Updated: "), "updated_at"), _optional("Assignees: ", _names(F.col("assignees"), "login")))
    return issues.select(
        F.concat(F.lit(f"{root}/issues/"), F.col("number").cast("string")).alias("uri"), F.lit(root).alias("parent_uri"),
        F.concat(kind, F.lit(" #"), F.col("number").cast("string"), F.lit(": "), "title").alias("name"),
        F.concat_ws(" | ", F.concat(F.lit("GitHub "), kind, F.lit(" ["), "state", F.lit("]")), _optional("Labels: ", _names(F.col("labels"), "name"))).alias("abstract"),
        overview.alias("overview"), _body("body").alias("content"),
    )


def linear_to_nodes(issues: DataFrame, project: str, state: str = "") -> DataFrame:
    """Rows read with the LINEAR schema; an empty state keeps all."""
    rows = issues.filter(F.lower("state.name") == state.lower()) if state else issues
    root = f"node://{project}/linear"
    priority = F.when(F.col("priority") > 0, F.concat(F.lit("Priority: "), F.col("priority").cast("string")))
    overview = F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("Created: "), "createdAt"), F.concat(F.lit("Updated: "), "updatedAt"), _optional("Assignee: ", F.col("assignee.name")))
    return rows.select(
        F.concat(F.lit(f"{root}/issues/"), "identifier").alias("uri"), F.lit(root).alias("parent_uri"), F.concat(F.lit("Issue "), "identifier", F.lit(": "), "title").alias("name"),
        F.concat_ws(" | ", F.concat(F.lit("Linear Issue ["), "state.name", F.lit("]")), priority, _optional("Labels: ", _names(F.col("labels.nodes"), "name"))).alias("abstract"),
        overview.alias("overview"), _body("description").alias("content"),
    )
