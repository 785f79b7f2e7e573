"""Readers for key-value files, shell histories and commit logs, as jobs over tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_kv(lines: DataFrame) -> DataFrame:
    """(key, value) of KEY=VALUE lines: blank and comment lines go, so do export and the quotes around a value."""
    line = F.regexp_replace(F.trim("line"), r"^export\s+", "")
    rows = lines.withColumn("__line", line).filter((F.col("__line") != "") & ~F.col("__line").startswith("#") & F.col("__line").contains("="))
    value = F.trim(F.regexp_extract("__line", r"^[^=]*=(.*)$", 1))
    bare = F.when(F.length(value) >= 2, F.regexp_replace(value, r"^(['\"])(.*)\1$", "$2")).otherwise(value)
    return rows.withColumn("key", F.trim(F.regexp_extract("__line", r"^([^=]*)=", 1))).withColumn("value", bare).drop("__line")


def parse_zsh(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) to commands: ': <ts>:<elapsed>;<cmd>', continued where the line before ends in a backslash."""
    order = Window.partitionBy("file").orderBy("line_no")
    goes_on = F.coalesce(F.lag("line").over(order).endswith("\\"), F.lit(False))
    rows = lines.withColumn("group", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    whole = rows.groupBy("file", "group").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.regexp_replace(x["line"], r"\\$", "")), "\n").alias("text"))
    head = r"^: (\d+):(\d+);(?s)(.*)$"
    good = whole.filter(F.col("text").rlike(head))
    return good.select("file", "line_no", F.regexp_extract("text", head, 1).cast("long").alias("ts"), (F.regexp_extract("text", head, 2).cast("long") * 1000).alias("duration_ms"), F.regexp_extract("text", head, 3).alias("command"))


def parse_bash(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) to commands: a '#<unix time>' line stamps the next command; blank lines go."""
    stamp = F.when(F.col("line").rlike(r"^#\d+$"), F.substring("line", 2, 20).cast("long"))
    rows = lines.filter(F.trim("line") != "").withColumn("stamp", stamp)
    before = F.lag("stamp").over(Window.partitionBy("file").orderBy("line_no"))
    return rows.withColumn("ts", before).filter("stamp is null").select("file", "line_no", "ts", F.col("line").alias("command"))


def parse_git_log(records: DataFrame) -> DataFrame:
    """Records of hash, author date, author, subject and body parted by NUL; too short ones and bad dates go."""
    parts = F.split("record", "\u0000", 5)
    rows = records.filter(F.size(parts) >= 4).select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("hash", "date", "author", "subject"))], F.coalesce(F.get(parts, F.lit(4)), F.lit("")).alias("body"))
    return rows.withColumn("ts", F.try_to_timestamp("date")).filter("ts is not null")


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_git_log(spark.read.option("lineSep", "\u0001").text(path).withColumnRenamed("value", "record"))
