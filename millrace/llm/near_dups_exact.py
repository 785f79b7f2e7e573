"""An exact second look at near duplicates: what sketches may have missed is found by prefixes of whole sets.

Two sets of m and n values that link at t share one of the m - ceil(t m) + 1 and n - ceil(t n) + 1 smallest hashes of
theirs. So documents meet in the lists of all these values, not of the few in a sketch, and whole sets are compared in
blocks. Documents that the quick search has joined already need not be compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, stored
from millrace.llm.near_dups import _block_links, near_duplicates
from millrace.llm.shingles import shingle_sets
from millrace.operators.graph import components


def _whole_sets(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, same, full) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            full, at = shingle_sets(part.column("text"), size)
            same = [xxhash.xxh128_hexdigest(full[a:b].tobytes()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(same, pa.string()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(full))], names=["doc_id", "n", "same", "full"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n long, same string, full array<long>")


def exact_near_duplicates(df: DataFrame, percent: int = 80, size: int = 5, block: int = 512, room: int = 1 << 20, **quick: int | float) -> DataFrame:
    """The rows of ``near_duplicates``, without the small chance of a missed link; other parameters go to its quick search.

    Every value that several documents have among the smallest ones of their sets brings together those that aren't in
    its largest component with all others, in blocks of about ``block`` documents or ``room`` values. That may take the
    square of a list's length: it is the price of having no chance left. Different texts of one id are documents of
    their own here, and their id is in the component of each; rows are as in ``near_duplicates`` otherwise.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = stored(near_duplicates(df, percent, size, **quick))
    sets = stored(_whole_sets(df, size).filter("n > 0 and doc_id is not null"))
    label = sets.select("doc_id", "same").join(rows.select("doc_id", "component_id").distinct(), "doc_id").groupBy("same").agg(F.min("component_id").alias("component"))
    nodes = stored(sets.groupBy("same").agg(F.min("n").alias("n"), F.min("full").alias("full")).join(label, "same"))

    prefix = F.slice("full", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    listed = nodes.select("same", "n", "component", F.explode(prefix).alias("value"))
    each = listed.groupBy("value", "component").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
    mains = each.groupBy("value").agg(F.max_by(F.struct("component", "count", "shingles"), F.struct("count", "component")).alias("main"), F.sum("count").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("components"))
    blocks = lambda rows, sizes: F.expr(f"cast(ceil(greatest(({rows}) / {block}, ({sizes}) / {room})) as int)")
    mains = stored(mains.filter("components > 1").select("value", F.col("main.component").alias("main"), blocks("members", "shingles").alias("parts"), blocks("members - main.count", "shingles - main.shingles").alias("asking")))
    dealt = listed.select("same", "component", "value").join(mains, "value").withColumn("part", F.expr("cast(pmod(xxhash64(same, value), parts) as int)")).withColumn("ask", F.expr("if(component = main, -1, cast(pmod(xxhash64(same, value, 1), asking) as int))"))
    as_other = dealt.select("value", "part", F.explode(F.expr("sequence(0, asking - 1)")).alias("i"), "same", "component", F.lit(False).alias("asks"))
    as_asking = dealt.filter("ask >= 0").select("value", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("ask").alias("i"), "same", "component", F.lit(True).alias("asks"))
    # a document that asks stands in its block once, as one that asks
    met = as_other.union(as_asking).groupBy("value", "part", "i", "same", "component").agg(F.max("asks").alias("asks")).join(nodes.select("same", "full"), "same")
    members = met.groupBy("value", "part", "i").agg(F.collect_list(F.struct("same", "asks", "component", "full")).alias("members"))
    links = stored(_block_links(members, percent, "string"))

    of = nodes.select("same", "component")
    across = links.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(across).withColumnRenamed("node", "component_id").withColumnRenamed("component", "__whole")
    out = rows.join(joined, "component_id", "left").withColumn("component_id", F.coalesce("__whole", "component_id").cast(kind))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
