"""Text, hash, JSON and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the form of terminal escape sequences.
_ANSI = r"[\u001B\u009B][\[\]()#;?]*(?:(?:(?:[a-zA-Z\d]*(?:;[a-zA-Z\d]*)*)?\u0007)|(?:(?:\d{1,4}(?:;\d{0,4})*)?[\dA-PRZcf-ntqry=><~]))"


def strip_ansi(text: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(text, _ANSI, "")


def hash_text(column: str, algorithm: str) -> Column:
    return {"sha1": F.sha1(column), "sha256": F.sha2(column, 256), "md5": F.md5(column)}[algorithm]


def chunk_fixed(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """One row for each piece of at most ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int"))
    pieces = F.transform(starts, lambda k: F.substr(F.col(text), k * size + 1, F.lit(size)))
    return df.select("*", F.posexplode(pieces).alias("idx", "chunk")).drop(text)


def truncate_head_tail(column: str, n: int) -> Column:
    """Three quarters of n from the front and the rest from the back, with the number of characters cut."""
    head = n * 3 // 4
    cut = F.length(column) - n
    marker = F.concat(F.lit("\n...["), cut.cast("string"), F.lit(" chars cut]...\n"))
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, head), marker, F.right(F.col(column), F.lit(n - head)))).otherwise(F.col(column))


def truncate_suffix(column: str, n: int, suffix: str) -> Column:
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, n), F.lit(suffix))).otherwise(F.col(column))


def sanitize_id(column: str) -> Column:
    """Characters outside letters, digits, - and _ as their hexadecimal bytes between underscores."""
    clean = F.transform(F.split(column, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9_-]$"), c).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit("_"))))
    return F.when(F.length(column) == 0, F.lit("")).otherwise(F.array_join(clean, ""))


def render_template(prompt: str, variables: str) -> Column:
    """{{key}} by the map's value."""
    return F.aggregate(F.map_entries(variables), F.col(prompt), lambda s, e: F.replace(s, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def strip_code_fences(column: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing more; parsing alone stops after the first value."""
    return F.try_parse_json(c).isNotNull() & (F.coalesce(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))), F.lit(0)) == 1)


def json_object_in_text(column: str) -> Column:
    """The outermost object in a text as JSON text, null if it doesn't parse."""
    found = F.regexp_extract(column, r"(?s)\{.*\}", 0)
    return F.when(is_json(found), found)


def json_array_in_text(column: str) -> Column:
    found = F.regexp_extract(column, r"(?s)\[.*\]", 0)
    return F.when(is_json(found), found)


def embed_text(kind: str) -> Column:
    """The text to embed of a memory, skill, node or shell row."""
    if kind == "memory":
        return F.col("content")
    if kind == "skill":
        return F.concat_ws(": ", "name", "description")
    if kind == "context":
        return F.concat_ws("\n", "name", "abstract", "content")
    return F.concat_ws("\n", "command", F.substring("output", 1, 4000))


def domain_slug(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"[.:]", "-")


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def normalize_url(url: str) -> Column:
    """Without query, fragment and trailing slash."""
    base = F.concat(F.regexp_extract(url, _URL, 1), F.lit("://"), F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3))
    return F.regexp_replace(base, "/$", "")


def url_to_uri(url: str, heading: str | None = None) -> Column:
    path = F.filter(F.split(F.regexp_extract(url, _URL, 3), "/"), lambda p: p != "")
    parts = F.transform(path, lambda p: F.url_encode(F.lower(p)))
    base = F.concat_ws("/", F.concat(F.lit("node://scraped/"), domain_slug(F.regexp_extract(url, _URL, 2))), parts)
    if heading is None:
        return base
    slug = F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.col(heading) != "", F.concat(base, F.lit("/"), slug)).otherwise(base)


def parent_uri(uri: Column) -> Column:
    """Null for four parts or fewer."""
    return F.when(F.size(F.split(uri, "/")) > 4, F.regexp_replace(uri, "/[^/]*$", ""))
