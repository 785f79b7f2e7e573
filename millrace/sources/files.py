"""Choice of source files from a table of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of source files, and folders that are never read.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "php", "md", "mdx", "svelte")
IGNORED = ("node_modules", "dist", "build")


def eligible_files(files: DataFrame, max_bytes: int = 512 * 1024) -> DataFrame:
    """(path, size): supported kinds that aren't too large, outside ignored and hidden folders."""
    hidden = F.exists(F.split("path", "/"), lambda s: s.isin(*IGNORED) | s.startswith("."))
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS) & ~hidden & (F.col("size") <= max_bytes))


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Without the paths that a rule (dir, regex) of one of their folders matches."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = files.select("path", F.explode(folders).alias("dir")).join(rules, "dir").filter(F.expr("path rlike regex")).select("path")
    return files.join(hit, "path", "left_anti")
