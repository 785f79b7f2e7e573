"""Chunks of texts, embedders and retrieval over chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import chunk_fixed
from millrace.operators.similarity import cosine


def sentence_chunks(text: str, max_bytes: int) -> list[str]:
    """Pieces of at most max_bytes of UTF-8: each ends after the last . ! or ? that fits, else before the last space, else hard."""
    data, out, at = text.strip().encode(), [], 0
    while at < len(data):
        end = at + max_bytes
        if end < len(data):
            while end > at and data[end] & 0xC0 == 0x80:  # not inside a character
                end -= 1
            if end == at:  # a character that is longer than a piece
                end = next((k for k in range(at + 1, len(data)) if data[k] & 0xC0 != 0x80), len(data))
            stop = max(data.rfind(c, at, end) for c in (b".", b"!", b"?")) + 1 or data.rfind(b" ", at, end)
            end = stop if stop > at else end if stop < 0 else at + 1
        out.append(data[at:end].decode().strip())
        at = end
    return [x for x in out if x]


def chunk_sentences(docs: DataFrame, max_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, idx, chunk)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, c) for k, t in zip(part[key], part[text]) for i, c in enumerate(sentence_chunks(t or "", max_bytes))]
            yield pd.DataFrame(rows, columns=[key, "idx", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, idx int, chunk string")


def hashing_vectors(texts: pd.Series, d: int = 64) -> pd.Series:
    """A deterministic stand-in for a model: words hashed to signed components, scaled to length one."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(d, np.float32)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % d] += 1 if h & 0x10000 else -1
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


def embed(df: DataFrame, text: str, model: Callable[[pd.Series], pd.Series] = hashing_vectors, into: str = "vec") -> DataFrame:
    """Adds the vectors that a function gives for batches of texts."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield model(part)

    return df.withColumn(into, vectors(F.col(text)))


def rag_chunks(docs: DataFrame, prompt: str, size: int = 4000, k: int = 5, model: Callable[[pd.Series], pd.Series] = hashing_vectors, key: str = "doc_id") -> DataFrame:
    """Per document the k fixed-size chunks that are nearest to a prompt, in the document's order."""
    asked = [float(x) for x in model(pd.Series([prompt]))[0]]
    rows = embed(chunk_fixed(docs.select(key, "text"), size), "chunk", model).withColumn("__q", F.array(*[F.lit(x) for x in asked]))
    rows = rows.withColumn("score", F.round(cosine("vec", "__q"), 6))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "idx"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select(key, "idx", "chunk", "score")


def register_tables(spark: SparkSession) -> None:
    """SQL table functions: LATERAL chunk_text(text, max_bytes), LATERAL page_sections(html) and LATERAL source_symbols(source)."""
    import re

    from pyspark.sql.functions import udtf

    from millrace.operators.code import DECLARATIONS
    from millrace.operators.web import sections_of

    class ChunkText:
        def eval(self, text: str, max_bytes: int):
            yield from enumerate(sentence_chunks(text or "", max_bytes))

    class PageSections:
        def eval(self, html: str):
            for i, (kind, _, text) in enumerate(sections_of(html)):
                yield i, kind, text

    class SourceSymbols:
        def eval(self, source: str):
            for kind, form in DECLARATIONS:
                for name in dict.fromkeys(re.findall(form, source or "")):
                    yield f"{kind}:{name}", kind, name

    spark.udtf.register("source_symbols", udtf(SourceSymbols, returnType="id string, kind string, name string"))
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="idx int, chunk string"))
    spark.udtf.register("page_sections", udtf(PageSections, returnType="pos int, kind string, text string"))


def enriched(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], columns: dict[str, str]) -> DataFrame:
    """Applies steps in order; a step that can't be planned leaves its columns null instead of stopping the rest."""
    from pyspark.errors import PySparkException

    for step in steps:
        try:
            df = step(df)
        except PySparkException:
            continue
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
