"""Aggregates over commands, stores, files, commits and conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shell_stats(df: DataFrame, limit: int = 20) -> DataFrame:
    """Per command: runs, mean duration cut to a whole number, share of runs that ended well."""
    stats = df.groupBy("command").agg(F.count("*").alias("n"), F.floor(F.avg("duration_ms")).cast("long").alias("avg_ms"), F.round(F.avg(F.when(F.col("exit_code") == 0, 1.0).otherwise(0.0)), 6).alias("success"))
    return stats.orderBy(F.desc("n"), "command").limit(limit)


def row_counts(stores: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """(store, n): rows of each store, at most the list limit if there is one."""
    out = None
    for name, df in stores.items():
        rows = df.limit(limit) if limit else df
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def overview(df: DataFrame) -> DataFrame:
    """Counts by category, importance and owner, and of all rows, in one pass."""
    rows = df.select(F.coalesce("category", F.lit("other")).alias("category"), F.when(F.coalesce("importance", F.lit(0)) == 0, 1).otherwise(F.col("importance")).alias("importance"), F.coalesce("owner", F.lit("any")).alias("owner"))
    c, i, o = F.col("category"), F.col("importance"), F.col("owner")
    grouped = rows.groupingSets([(c,), (i,), (o,), ()], c, i, o).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "importance").when(F.col("g") == 6, "owner").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce("category", F.col("importance").cast("string"), "owner", F.lit("")).alias("value"), "n")


def over_budget(stores: dict[str, DataFrame], budget: dict[str, int]) -> DataFrame:
    """Projects with more rows of a store than its budget; a budget of 0 has no limit."""
    out = None
    for name, df in stores.items():
        limit = budget.get(name, 0)
        one = df.groupBy("project").agg(F.count("*").alias("n")).filter((F.col("n") > limit) & F.lit(limit > 0)).select("project", F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def corpus_info(df: DataFrame, text: str = "text", kind: str = "ext") -> DataFrame:
    """Per kind and for all: files, tokens (bytes / 4, at least 1), lines and share of tokens."""
    rows = df.select(F.col(kind).alias("ext"), F.greatest((F.octet_length(text) / 4).cast("long"), F.lit(1)).alias("tokens"), F.size(F.split(text, "\n")).alias("lines"))
    sums = rows.rollup("ext").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines"))
    sums = sums.withColumn("ext", F.coalesce("ext", F.lit("*")))
    whole = F.max(F.when(F.col("ext") == "*", F.col("tokens"))).over(Window.partitionBy(F.lit(1)))  # one row for each kind
    return sums.withColumn("share", F.round(100.0 * F.col("tokens") / whole, 2))


def dir_rollup(df: DataFrame, path: str = "path", tokens: str = "tokens") -> DataFrame:
    """Token totals of every ancestor directory of the paths."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return df.filter(F.size(parts) > 1).select(F.explode(ancestors).alias("dir"), tokens).groupBy("dir").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("files"))


def churn(commits: DataFrame, as_of: Column, lookback: int = 180) -> DataFrame:
    """Per file: commits, recent commits, score and label."""
    recent = F.count_if(F.col("ts") > as_of - F.expr(f"INTERVAL '{lookback}' DAY"))
    rows = commits.groupBy("file").agg(F.count("*").alias("total"), recent.alias("recent"))
    score = F.least(F.col("recent") / F.lit(float(lookback)), F.lit(1.0))
    label = F.when(score >= 0.5, "volatile").when(score >= 0.1, "moderate").otherwise("stable")
    return rows.select("file", "total", "recent", F.round(score, 6).alias("score"), label.alias("label"))


PREFIX = r"^(\w+)(?:\(.+?\))?:\s+(.+)"


def recent_commits(commits: DataFrame, n: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("ts"), "hash"))
    rows = commits.withColumn("place", place).filter(F.col("place") <= n)
    prefix = F.lower(F.regexp_extract("subject", PREFIX, 1))
    return rows.withColumn("prefix", prefix).withColumn("what", F.when(prefix != "", F.regexp_extract("subject", PREFIX, 2)).otherwise(F.col("subject")))


def commit_prefixes(commits: DataFrame, n: int = 20) -> DataFrame:
    return recent_commits(commits, n).filter("prefix <> ''").groupBy("file", "prefix").agg(F.count("*").alias("n"))


def commit_intent(commits: DataFrame, n: int = 20) -> DataFrame:
    """A sentence per file: how many commits of which kinds, and the newest subjects."""
    rows = recent_commits(commits, n)
    kinds = rows.filter("prefix <> ''").groupBy("file", "prefix").agg(F.count("*").alias("n")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["prefix"])), ", ").alias("kinds"))
    whole = rows.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "what"))).alias("w"))
    newest = F.array_join(F.transform(F.slice("w", 1, 5), lambda x: x["what"]), "; ")
    text = F.concat(F.lit("Commit history ("), F.col("n").cast("string"), F.lit(" commits): "), F.coalesce("kinds", F.lit("")), F.lit(". Recent: "), newest)
    return whole.join(kinds, "file", "left").select("file", text.alias("intent"))


def diff_stats(df: DataFrame, diff: str = "diff") -> DataFrame:
    """Added and deleted lines, without the file headers."""
    lines = F.split(diff, "\n")
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    gone = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return df.withColumns({"additions": added, "deletions": gone})


def session_stats(df: DataFrame, window: int = 8000) -> DataFrame:
    """Per conversation: messages by role, bytes, tokens and share of the context window."""
    size = F.sum(F.octet_length("text"))
    counts = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")]
    rows = df.groupBy("conv_id").agg(*counts, size.alias("chars"))
    tokens = F.ceil(F.col("chars") / 4)
    return rows.withColumn("tokens", tokens.cast("long")).withColumn("share", F.round(F.col("tokens") / F.lit(float(window)), 6))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def merge_last_wins(df: DataFrame) -> DataFrame:
    """(key, value, pos) in order of pos: the value of the last sighting, the place of the first."""
    return df.groupBy("key").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))


def flags(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row that counts the rows passing each test."""
    return df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def distinct_first(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The first row for each SHA-256 of a column."""
    place = F.row_number().over(Window.partitionBy(F.sha2(column, 256)).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")
