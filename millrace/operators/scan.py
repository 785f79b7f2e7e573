"""Line-level scans: grep with context, headings, budgets, and digests of logs and Markdown."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File kinds that are never text.
BINARY_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "exe", "dll", "so", "dylib", "bin", "wasm", "woff", "woff2", "ttf", "mp3", "mp4")


def pattern_of(pattern: str, ignore_case: bool = False, smart_case: bool = False, fixed: bool = False, word: bool = False) -> str:
    """The regular expression for a pattern and its flags."""
    if smart_case and pattern == pattern.lower():
        ignore_case = True
    body = re.escape(pattern) if fixed else pattern
    body = rf"\b(?:{body})\b" if word else body
    return f"(?i){body}" if ignore_case else body


def line_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def grep(lines: DataFrame, pattern: str, invert: bool = False, **flags: bool) -> DataFrame:
    hit = F.col("line").rlike(pattern_of(pattern, **flags))
    return lines.filter(~hit if invert else hit).withColumn("line", F.replace("line", F.lit("\t"), F.lit("  ")))


def grep_documents(docs: DataFrame, pattern: str, also: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Lines of documents that hold all other patterns somewhere: whole documents are tested before they are split."""
    rows = docs
    for p in (pattern, *also):
        rows = rows.filter(F.col(text).rlike(p))
    return grep(line_table(rows, text), pattern)


def only_matching(lines: DataFrame, pattern: str) -> DataFrame:
    found = F.regexp_extract_all("line", F.lit(pattern), 0)
    return lines.withColumn("line", F.array_join(found, "\n")).filter(F.size(found) > 0)


def with_context(lines: DataFrame, pattern: str, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """Hunks of hits with lines around them; those that touch are one. (start, end, text)."""
    order = Window.partitionBy(key).orderBy("line_no")
    near = F.max(F.col("line").rlike(pattern).cast("int")).over(order.rowsBetween(-after, before))
    rows = lines.withColumn("__near", near).filter("__near = 1")
    rows = rows.withColumn("__hunk", F.col("line_no") - F.row_number().over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "__hunk").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"), text.alias("text")).drop("__hunk")


def with_heading(lines: DataFrame, heading: str, width: int = 80, key: str = "doc_id") -> DataFrame:
    """The nearest line at or before each line that is a heading, cut to a width."""
    order = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("heading", F.substring(F.last(F.when(F.col("line").rlike(heading), F.col("line")), ignorenulls=True).over(order), 1, width))


def files_with(lines: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    return lines.filter(F.col("line").rlike(pattern)).select(key).distinct()


def files_without(docs: DataFrame, lines: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    return docs.select(key).distinct().join(files_with(lines, pattern, key), key, "left_anti")


def glob_regex(glob: str) -> str:
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"^{out}$"


def eligible_paths(df: DataFrame, extensions: Sequence[str] = (), exclude: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Paths with one of the extensions, none of the excluded globs and no binary kind."""
    kind = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    rows = df.filter(~kind.isin(*BINARY_EXTENSIONS))
    rows = rows.filter(kind.isin(*extensions)) if extensions else rows
    for g in exclude:
        rows = rows.filter(~F.col(path).rlike(glob_regex(g)))
    return rows


def is_binary(column: str, n: int) -> Column:
    return F.instr(F.substring(column, 1, n), "\u0000") > 0


def tail_lines(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    parts = F.split(text, "\n")
    return docs.withColumn("tail", F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "\n"))


ERROR_LINE = r"(?i)(?:error|exception|fail|panic|traceback)|(?-i)[a-zA-Z0-9_/.-]+\.[a-zA-Z0-9]+:\d+"


def distill_errors(lines: DataFrame, tail: int = 30, pattern: str = ERROR_LINE, key: str = "doc_id") -> DataFrame:
    """Error lines and the indented lines next to them, without repeats in a row; else the last lines."""
    order = Window.partitionBy(key).orderBy("line_no")
    indented = F.col("line").startswith(" ")
    rows = lines.withColumn("__hit", F.col("line").rlike(pattern)).withColumn("__run", F.sum(F.when(indented, 0).otherwise(1)).over(order))
    block = Window.partitionBy(key, "__run")
    after = F.max(F.when(~indented | F.col("__hit"), F.col("__hit").cast("int")).otherwise(0)).over(block)
    rows = rows.withColumn("__after", after).withColumn("__last", F.max("__run").over(Window.partitionBy(key)))
    heads = rows.filter(~indented | (F.col("__run") == 0)).groupBy(key, "__run").agg(F.max(F.col("__hit").cast("int")).alias("__head"))
    following = heads.select(key, (F.col("__run") - 1).alias("__run"), F.col("__head").alias("__next"))
    rows = rows.join(following, [key, "__run"], "left")
    taken = (F.col("__after") == 1) | (indented & (F.coalesce("__next", F.lit(0)) == 1)) | F.col("__hit")
    found = rows.filter(taken & (F.trim("line") != "")).withColumn("__before", F.lag("line").over(order))
    found = found.filter(F.col("__before").isNull() | (F.col("__before") != F.col("line"))).select(key, "line_no", "line")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("line_no")))
    rest = lines.join(found.select(key).distinct(), key, "left_anti").withColumn("__place", place).filter(F.col("__place") <= tail)
    return found.unionByName(rest.select(key, "line_no", "line"))


def markdown_headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Heading rows with level, text, line and an id; repeated ones get a number."""
    form = r"^(#{1,6})\s+(.+?)\s*#*$"
    rows = lines.filter(F.col("line").rlike(form)).select(key, "line_no", F.length(F.regexp_extract("line", form, 1)).alias("level"), F.regexp_extract("line", form, 2).alias("title"))
    n = F.row_number().over(Window.partitionBy(key, "level", "title").orderBy("line_no"))
    base = F.concat(F.lit("h"), F.col("level").cast("string"), F.lit(":"), F.col("title"))
    return rows.withColumn("id", F.when(n > 1, F.concat(base, F.lit(":"), n.cast("string"))).otherwise(base))


def section_split(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections at headings of level 2 and 3; text before the first one goes."""
    heading = F.col("line").rlike(r"^#{2,3}\s+\S")
    rows = lines.withColumn("section", F.sum(heading.cast("int")).over(Window.partitionBy(key).orderBy("line_no"))).filter("section > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "section").agg(F.min_by("line", "line_no").alias("heading"), text.alias("text"))


def doc_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """First line that isn't blank, words and characters."""
    first = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    words = F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda x: x != ""))
    return docs.withColumns({"first_line": F.substring(F.trim(first), 1, 200), "words": words, "chars": F.length(text)})


def transcripts(turns: DataFrame, least: int = 20) -> DataFrame:
    """'[role]: text' lines of conversations that are long enough, in order."""
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(F.lit("["), x["role"], F.lit("]: "), x["text"]))
    return whole.filter(F.col("n") >= least).select("conv_id", "n", F.array_join(lines, "\n").alias("transcript"))


def markdown_summary(docs: DataFrame, text: str = "text", most: int = 200) -> DataFrame:
    """Adds summary: the first heading of level 1 and the first paragraph below it, without front matter, images and HTML lines."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = docs.withColumn("__l", F.transform(F.split(text, "\n"), trimmed))
    closed = F.array_position(F.slice("__l", 2, 1_000_000_000), "---").cast("int")
    rows = rows.withColumn("__l", F.when((F.col("__l")[0] == "---") & (closed > 0), F.slice("__l", closed + 2, F.lit(1_000_000_000))).otherwise(F.col("__l")))
    first = F.array_min(F.transform("__l", lambda x, i: F.when(x.startswith("# "), i)))
    rows = rows.withColumn("__h", first).withColumn("__title", trimmed(F.substring(F.get("__l", F.col("__h")), 2, 1_000_000_000)))
    below = F.when(F.col("__h").isNotNull(), F.slice("__l", F.col("__h") + 2, F.lit(1_000_000_000))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        done = s["done"] | x.startswith("#") | ((x == "") & (F.size(s["out"]) > 0))
        skipped = (x == "") | x.startswith("![") | x.startswith("<")
        return F.struct(done.alias("done"), F.when(done | skipped, s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"))

    told = F.array_join(F.aggregate(below, start, step, lambda s: s["out"]), " ")
    whole = F.concat_ws(": ", F.when(F.col("__title") != "", F.col("__title")), F.when(told != "", told))
    rows = rows.withColumn("summary", F.when(whole == "", "Markdown document").otherwise(whole))
    cut = F.when(F.length("summary") > most, F.concat(F.substring("summary", 1, most), F.lit("..."))).otherwise(F.col("summary"))
    return rows.withColumn("summary", cut).drop("__l", "__h", "__title")
