"""Lists, filters and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import stored


def by_project(df: DataFrame, project: str = "") -> DataFrame:
    """An empty project is no filter."""
    return df.filter(F.col("project") == project) if project else df


def list_rows(df: DataFrame, project: str = "", limit: int = 200, newest: str = "created_at", key: str = "id") -> DataFrame:
    """The newest rows of a project."""
    return by_project(df, project).orderBy(F.desc(newest), key).limit(limit)


def list_nodes(df: DataFrame, parent_uri: str | None = None, limit: int = 200, order: str = "uri") -> DataFrame:
    return (df.filter(F.col("parent_uri") == parent_uri) if parent_uri else df).orderBy(order).limit(limit)


def search_filters(df: DataFrame, owner: str = "", category: str = "", date_from: str = "", date_to: str = "") -> DataFrame:
    for value, test in ((owner, F.col("owner") == owner), (category, F.col("category") == category)):
        df = df.filter(test) if value else df
    df = df.filter(F.col("created_at") >= F.to_timestamp(F.lit(date_from))) if date_from else df
    return df.filter(F.col("created_at") <= F.to_timestamp(F.lit(date_to))) if date_to else df


def quick_filter(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of the columns contains the text, case apart."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.filter(test)


def topk_minscore(df: DataFrame, k: int, min_score: float = 0.0, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The k best by score, overall or per group; a positive minimum drops lower scores first."""
    df = df.filter(F.col("score") >= min_score) if min_score > 0 else df
    if not by:
        return df.orderBy(F.desc("score"), key).limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
    return df.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def match_limits(df: DataFrame, per_file: int, total: int, file: str = "doc_id", order: str = "line_no") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return df.withColumn("__place", place).filter(F.col("__place") <= per_file).drop("__place").orderBy(file, order).limit(total)


def running(df: DataFrame, size: Column, group: str, order: str, name: str, parts: int = 32) -> DataFrame:
    """Running sum of size over the whole table in the order of (group, order), without one task for all rows.

    Sums per group are summed up over groups of groups by range, so only one number per range meets in one place.
    """
    df = df.withColumn("__size", size)
    sums = df.groupBy(group).agg(F.sum("__size").alias("__sum"))
    ranged = stored(sums.repartitionByRange(parts, group).withColumn("__part", F.spark_partition_id()))
    starts = ranged.groupBy("__part").agg(F.sum("__sum").alias("__whole"))
    starts = starts.select("__part", (F.sum("__whole").over(Window.orderBy("__part")) - F.col("__whole")).alias("__start"))
    inner = F.sum("__sum").over(Window.partitionBy("__part").orderBy(group)) - F.col("__sum")
    before = ranged.withColumn("__inner", inner).join(F.broadcast(starts), "__part").select(group, (F.col("__inner") + F.col("__start")).alias("__before"))
    own = F.sum("__size").over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("__own", own).join(before, group).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__size")


def token_budget(df: DataFrame, budget: int, size: Column, group: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Rows in order while the running size stays within budget * 4 bytes."""
    return running(df, size, group, order, "running").filter(F.col("running") <= budget * 4)
