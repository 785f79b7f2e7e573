"""Search in texts by an index of their trigrams, so that only a few texts are read.

Texts lie in blocks, which are folders of a Parquet table. Each task that reads texts also writes the posting lists of
its own texts, sorted by trigram, so that statistics of row groups leave out the others. A pattern is turned into the
trigrams that every match must hold; their lists are joined, and the texts that remain are tested with the pattern
itself. A pattern that needs no trigram reads all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.patterns import Needs, grams, needs_of, number
from millrace.operators import scan
from millrace.operators.lists import quick_filter

#: Small blocks are no more than these; each is a folder, and many small folders take longer than their texts.
SMALL_BLOCKS = 256


def _postings(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blocks, texts = (batch.column(c) for c in ("id", "block", "low"))
            found, owner = [], []
            for k, text in enumerate(texts):
                text = text.as_py() or ""
                point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                own = np.unique(point[:-2] << 42 | point[1:-1] << 21 | point[2:]) if len(point) > 2 else np.zeros(0, np.int64)
                found.append(own)
                owner.append(np.full(len(own), k))
            gram, at = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(owner or [np.zeros(0, np.int64)])
            block = blocks.to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, np.int64)
            order = np.lexsort((at, block, gram))
            gram, at, block = gram[order], at[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])) if len(gram) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), ids.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(block[first].astype(np.int32)), lists], names=["gram", "block", "ids"])

    return run, f"gram long, block int, ids array<{kind}>"


class TrigramIndex:
    """The texts of a table in blocks, and the posting lists of their trigrams, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, texts: StructType | None = None):
        """``texts`` is the schema of the texts with their block; without it Spark reads it from the files, so an index of no rows needs it."""
        read = spark.read.schema(texts) if texts is not None else spark.read
        self.texts = read.parquet(f"{path}/texts")
        self.lists = spark.read.parquet(f"{path}/lists")

    @classmethod
    def build(cls, df: DataFrame, path: str, columns: Sequence[str], key: str = "doc_id", per_block: int = 65_536) -> TrigramIndex:
        """Writes the index. ``columns`` are searched; other columns are kept beside them.

        Rows are dealt to blocks by a hash of the key, about ``per_block`` to each, or more where that makes
        more than ``SMALL_BLOCKS`` of under 65,536 rows; the texts are shuffled once, posting lists are not. Null texts hold nothing. Keys should differ; rows of one key are found together, rows
        without a key only by patterns that need no trigram. A column named ``block`` is replaced.
        """
        spark = df.sparkSession
        rows = df.count()
        blocks = max(1, min(-(-rows // per_block), max(SMALL_BLOCKS, -(-rows // 65_536))))
        placed = df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block", key)
        placed.write.partitionBy("block").parquet(f"{path}/texts")
        held = spark.read.schema(placed.schema).parquet(f"{path}/texts")
        run, schema = _postings(df.schema[key].dataType.simpleString())
        low = F.lower(F.concat_ws("\n", *[F.col(c) for c in columns]))  # a match lies in one column; trigrams across the border do no harm
        held.select(F.col(key).alias("id"), "block", low.alias("low")).mapInArrow(run, schema).sortWithinPartitions("gram", "block").write.parquet(f"{path}/lists")
        return cls(spark, path, placed.schema)

    def candidates(self, needs: Needs) -> DataFrame:
        """(block, id) of the texts that hold the needed trigrams."""
        wanted = sorted(map(number, needs.trigrams()))
        rows = self.lists.filter(F.col("gram").isin(wanted)).select("gram", "block", F.explode("ids").alias("id"))
        held = rows.groupBy("block", "id").agg(F.collect_set("gram").alias("held"))  # no more than the pattern's trigrams
        return held.filter(needs.column(F.col("held"))).select("block", "id")

    def narrowed(self, needs: Needs, key: str = "doc_id") -> DataFrame:
        """The rows that may match. Only blocks with candidates are read: their numbers reach the driver, the candidates don't."""
        if not needs.of:
            return self.texts.drop("block")
        some = self.candidates(needs)
        blocks = [r["block"] for r in some.select("block").distinct().collect()]
        return self.texts.filter(F.col("block").isin(blocks)).join(some.withColumnRenamed("id", key), ["block", key], "left_semi").drop("block")

    def matching(self, pattern: str, column: str, key: str = "doc_id") -> DataFrame:
        """Rows whose column matches a regular expression somewhere."""
        return self.narrowed(needs_of(pattern), key).filter(F.col(column).rlike(pattern))

    def grep(self, pattern: str, text: str = "text", key: str = "doc_id", **flags: bool) -> DataFrame:
        """Lines that match, as ``scan.grep`` gives them."""
        whole = scan.pattern_of(pattern, **flags)
        return scan.grep(scan.line_table(self.narrowed(needs_of(whole), key), text, key), pattern, **flags)

    def containing(self, text: str, columns: Sequence[str], key: str = "doc_id") -> DataFrame:
        """Rows in one of whose columns the text stands, case apart, as ``lists.quick_filter`` gives them."""
        low = self.texts.sparkSession.range(1).select(F.lower(F.lit(text)).alias("low")).first()["low"]  # as Spark lower-cases
        return quick_filter(self.narrowed(grams(low), key), text, columns)
