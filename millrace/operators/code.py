"""Symbols of source files, found by patterns, and what is told of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forms of declarations and the id prefixes of their kinds.
DECLARATIONS = [
    ("fn", r"(?m)(?:export\s+)?function\s+([A-Za-z_]\w*)\s*\("),
    ("cls", r"(?m)(?:export\s+)?class\s+([A-Za-z_]\w*)"),
    ("fn", r"(?m)^func\s+(?:\(\w+\s+\*?\w+\)\s*)?([A-Za-z_]\w*)\s*\("),
    ("fn", r"(?m)^\s*def\s+([A-Za-z_]\w*)\s*\("),
]
# The form of a method, words that look like one, and the form of a call.
METHOD = r"(?m)^\s*(?:public|private|protected)?\s*([A-Za-z_]\w*)\s*\("
NOT_METHODS = ("if", "for", "while", "switch", "catch", "function", "return")
CALL = r"([A-Za-z_]\w*)\s*\("


def extract_symbols(files: DataFrame) -> DataFrame:
    """(path, id, kind, name) of rows (path, source): one for each id."""
    found = [_found(kind, p) for kind, p in DECLARATIONS]
    classes = F.regexp_extract_all("source", F.lit(DECLARATIONS[1][1]), 1)
    last = F.element_at(F.filter(classes, lambda x: x != ""), -1)
    methods = F.filter(F.regexp_extract_all("source", F.lit(METHOD), 1), lambda n: ~n.isin(*NOT_METHODS))
    of_class = F.transform(methods, lambda n: F.struct(F.concat(F.lit("mtd:"), last, F.lit("."), n).alias("id"), F.lit("mtd").alias("kind"), n.alias("name")))
    every = F.concat(*found, F.when(F.size(classes) > 0, of_class).otherwise(F.array().cast("array<struct<id:string,kind:string,name:string>>")))
    return files.select("path", F.explode(every).alias("s")).select("path", "s.*").dropDuplicates(["path", "id"])


def _found(kind: str, pattern: str):
    return F.transform(F.regexp_extract_all("source", F.lit(pattern), 1), lambda n: F.struct(F.concat(F.lit(f"{kind}:"), n).alias("id"), F.lit(kind).alias("kind"), n.alias("name")))


def extract_calls(files: DataFrame) -> DataFrame:
    """(path, name) of everything that is called."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(CALL), 1))).alias("name"))


def outline(symbols: DataFrame, exports_only: bool = False, full: bool = False) -> DataFrame:
    """(path, id, kind, name, methods): top-level symbols with the methods of each class; plain values only if full.

    Exported are names with a capital in Go files and those without a leading underscore in Python files; elsewhere those
    that a column ``exported`` marks, or, without that column, those without a leading underscore.
    """
    rows = symbols if full else symbols.filter(~F.col("kind").isin("var", "const", "field", "prop"))
    if exports_only:
        marked = F.coalesce("exported", F.lit(False)) if "exported" in rows.columns else F.lit(False)
        plain, kind = ~F.col("name").startswith("_"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        rows = rows.filter(marked | F.when(kind == "go", F.col("name").rlike(r"^\p{Lu}")).when(kind == "py", plain).otherwise(F.lit("exported" not in rows.columns) & plain))
    inner = rows.filter("kind = 'mtd'").withColumn("owner", F.regexp_extract("id", r"^mtd:([^.]*)\.", 1))
    methods = inner.groupBy("path", "owner").agg(F.array_sort(F.collect_list("name")).alias("methods"))
    top = rows.filter("kind <> 'mtd'").withColumn("owner", F.when(F.col("kind") == "cls", F.col("name")))
    return top.join(methods, ["path", "owner"], "left").select("path", "id", "kind", "name", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def file_summary_text(files: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 16000) -> DataFrame:
    """(path, overview, content): counts and lists of symbols and edges, and a paragraph for each symbol."""
    line = lambda x: F.concat(F.lit("## ["), x["kind"], F.lit("] "), x["name"])
    of_file = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "name"))).alias("s"))
    links = edges.groupBy("path").agg(F.array_sort(F.collect_list(F.concat("src", F.lit(" -> "), "dst"))).alias("e"))
    rows = files.select("path").join(of_file, "path", "left").join(links, "path", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    overview = F.concat(
        F.lit("File: "), "path", F.lit("\nLanguage: "), F.regexp_extract("path", r"\.([^./]+)$", 1), F.lit("\nSymbols: "), n("s"), F.lit("\nEdges: "), n("e"),
        F.lit("\n"), F.coalesce(F.array_join(F.transform("s", lambda x: x["id"]), ", "), F.lit("")),
    )
    content = F.concat_ws("\n", F.array_join(F.transform("s", line), "\n"), F.array_join("e", "\n"))
    return rows.select("path", overview.alias("overview"), F.substring(content, 1, limit).alias("content"))
