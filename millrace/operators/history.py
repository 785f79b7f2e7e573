"""Shell and tool-call histories, file snapshots and projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.redact import mask_secret_keys
from millrace.operators.counting import diff_stats

# Beginnings of commands that need care.
DANGEROUS = ("rm -rf", "rm -r ", "rm ", "mv ", "cp ", "wget", "curl", "chmod", "chown", "sudo", "docker run", "docker exec", "docker rm", "docker rmi", "docker stop", "kill", "pkill")


def flag_dangerous(command: Column, blocked: Sequence[str] = ()) -> Column:
    """Whether a part between pipes and separators begins dangerously, or a blocked text occurs."""
    starts = F.exists(F.split(F.lower(command), r"[|&;]"), lambda p: F.trim(p).rlike("^(?:" + "|".join(DANGEROUS) + ")"))
    for b in blocked:
        starts = starts | command.contains(b)
    return starts


def stuck_runs(calls: DataFrame, window: int = 20, nudge: int = 4, stop: int = 8, alternate: int = 6) -> DataFrame:
    """Per actor over its last calls: length of the closing run of one call, of the closing alternation, and the verdict.

    Calls are the same if their tools are, and the hashes of their arguments where rows have a column args_hash.
    """
    calls = calls.withColumn("tool", F.concat_ws(" ", "tool", "args_hash")) if "args_hash" in calls.columns else calls
    last = F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("seq")))
    rows = calls.withColumn("back", last).filter(F.col("back") <= window)
    order = Window.partitionBy("actor").orderBy("back")
    rows = rows.withColumn("first", F.first("tool").over(order)).withColumn("second", F.max(F.when(F.col("back") == 2, F.col("tool"))).over(Window.partitionBy("actor")))
    same = F.min(F.when(F.col("tool") != F.col("first"), F.col("back") - 1)).over(Window.partitionBy("actor"))
    size = F.max("back").over(Window.partitionBy("actor"))
    expected = F.when(F.col("back") % 2 == 1, F.col("first")).otherwise(F.col("second"))
    broken = F.min(F.when(F.col("tool") != expected, F.col("back") - 1)).over(Window.partitionBy("actor"))
    rows = rows.withColumn("run", F.coalesce(same, size)).withColumn("pairs", F.floor(F.coalesce(broken, size) / 2) * 2)
    one = rows.filter("back = 1")
    alternating = F.when(F.col("first") == F.col("second"), 0).otherwise(F.coalesce("pairs", F.lit(0)))
    verdict = F.when(F.col("run") >= stop, "stop").when(F.col("run") >= nudge, "nudge").when(alternating >= stop, "stop").when(alternating >= alternate, "nudge").otherwise("ok")
    return one.select("actor", F.col("run").cast("int").alias("run"), alternating.cast("int").alias("alternating"), verdict.alias("verdict"))


def incremental_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, fingerprint, content_hash) of two snapshots to (path, status)."""
    old = previous.select("path", F.col("fingerprint").alias("f0"), F.col("content_hash").alias("h0"))
    both = current.join(old, "path", "full_outer")
    status = F.when(F.col("f0").isNull(), "new").when(F.col("fingerprint").isNull(), "deleted").when(F.col("fingerprint") == F.col("f0"), "unchanged").when(F.col("content_hash") == F.col("h0"), "touched").otherwise("changed")
    return both.select("path", status.alias("status"))


def kv_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, value) sets to added, removed and changed keys, with values of secret names and long values masked."""
    both = a.select("key", F.col("value").alias("before")).join(b.select("key", F.col("value").alias("after")), "key", "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    shown = [mask_secret_keys("key", c).alias(c) for c in ("before", "after")]
    return both.withColumn("status", status).select("key", *shown, "status")


def resolve_project(records: DataFrame, markers: DataFrame) -> DataFrame:
    """The project of each cwd: nearest ancestor with the primary marker, else with .git, else the last part of the path."""
    parts = F.split("cwd", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = records.select("cwd").distinct().select("cwd", F.explode(ancestors).alias("root")).join(markers, "root")
    best = dirs.groupBy("cwd").agg(F.max_by("root", F.when(F.col("marker") == "primary", F.length("root"))).alias("p"), F.max_by("root", F.when(F.col("marker") == "git", F.length("root"))).alias("g"))
    named = F.element_at(F.split(F.coalesce("p", "g", "cwd"), "/"), -1)
    return records.join(best, "cwd", "left").withColumn("project", named).drop("p", "g")


# Marks in the contents of nodes.
SUMMARY_MARK, CUT_MARK = "\n\n--- AST Summary ---\n\n", "\n\n...TRUNCATED"


def git_nodes(commits: DataFrame, files: DataFrame, diffs: DataFrame, project: str, max_chars: int = 16000) -> DataFrame:
    """Nodes (uri, parent_uri, kind, name, abstract, content, additions, deletions, created_at) of a history.

    Of commits (hash, subject, ts) one each, and below it one for each of its files (hash, file, content) as it was then
    and one for each of its diffs (hash, file, diff), with lines added and deleted and the file's content after the
    patch. A file without a diff has a diff node without a text. Contents are cut to ``max_chars`` characters and say so.
    """
    root = f"node://{project}/git"
    cut_off = lambda c: F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit(CUT_MARK))).otherwise(c)
    commit = F.concat(F.lit(f"{root}/commit/"), "hash")
    place = lambda kind: F.concat(F.lit(f"{root}/{kind}/"), "hash", F.lit("/"), "file")
    nothing, name = F.lit(None).cast("int"), F.element_at(F.split("file", "/"), -1)
    of_commit = commits.select(commit.alias("uri"), F.lit(root).alias("parent_uri"), F.lit("git_commit").alias("kind"), F.substring("hash", 1, 7).alias("name"), F.col("subject").alias("abstract"), F.col("subject").alias("content"), nothing.alias("additions"), nothing.alias("deletions"), F.col("ts").alias("created_at"))
    whole = files.join(commits.select("hash", "subject", "ts"), "hash").join(diff_stats(diffs).select("hash", "file", "diff", "additions", "deletions"), ["hash", "file"], "left")
    patch = F.coalesce("diff", F.lit(""))
    both = F.when(F.coalesce("content", F.lit("")) != "", F.concat(patch, F.lit(SUMMARY_MARK), "content")).otherwise(patch)
    snapshot = whole.select(place("snapshot").alias("uri"), commit.alias("parent_uri"), F.lit("git_snapshot").alias("kind"), name.alias("name"), F.col("subject").alias("abstract"), cut_off(F.coalesce("content", F.lit(""))).alias("content"), nothing.alias("additions"), nothing.alias("deletions"), F.col("ts").alias("created_at"))
    changed = F.concat(F.lit("Changed "), "file", F.lit(": "), "subject")
    diff = whole.select(place("diff").alias("uri"), commit.alias("parent_uri"), F.lit("git_diff").alias("kind"), name.alias("name"), changed.alias("abstract"), cut_off(both).alias("content"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), F.col("ts").alias("created_at"))
    return of_commit.unionByName(snapshot).unionByName(diff)


def context_budget(items: DataFrame, group: str, order: Sequence[str], size: Column, max_items: int = 20, max_chars: int = 24000) -> DataFrame:
    """The first few items of each group whose running size stays within the budget; nothing after the first that doesn't."""
    by = Window.partitionBy(group).orderBy(*order)
    rows = items.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= max_items)
    return rows.withColumn("running", F.sum(size).over(by)).filter(F.col("running") <= max_chars)
