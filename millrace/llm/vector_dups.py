"""Near-duplicate embeddings by a pigeonhole join over subspaces.

Unit vectors have a cosine of c or more if their squared distance is 2 - 2c or less. After a fixed random rotation the
components are split into blocks of equal variance; each block gets the share of the squared distance that its number
of components is of all. A pair within the whole budget is within that of a block at least. So the range join of each
block, along slabs of its first component, finds the pair; it counts in the first block in which it qualifies, and
its cosine is computed on the original vectors. Equal vectors are one from the start and count as often as they occur.
Slabs with many vectors are dealt in chunks, each pair of chunks being a task of bounded size; tasks emit counts and
local components for their vectors, never pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.vectors import dots, lengths, matrix, usable
from millrace.operators.graph import components

#: Rounding of coordinates and of block distances is far below this.
_SLACK = 1e-5


def _rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(20240229).standard_normal((d, d)))[0]


def _blocks(d: int, parts: int) -> list[tuple[int, int]]:
    cuts = [round(k * d / min(parts, d)) for k in range(min(parts, d) + 1)]
    return list(zip(cuts, cuts[1:]))


def _turned(x: np.ndarray) -> np.ndarray:
    return ((x / np.linalg.norm(x, axis=1)[:, None]) @ _rotation(x.shape[1])).astype(np.float32)


def _slabs(reps: DataFrame, d: int, cosine: float, parts: int) -> DataFrame:
    """Adds the number of the slab in which the vector is at home, for each block."""
    blocks = _blocks(d, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _turned(matrix(batch.column("embedding"), d)).astype(np.float64)
            homes = [np.floor(turned[:, lo] / (np.sqrt((2 - 2 * cosine) * (hi - lo) / d) + _SLACK)) for lo, hi in blocks]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(homes, axis=1).astype(np.int32).ravel()), len(blocks)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "slabs"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{fields}, slabs array<int>")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives both ends of each pair the same label, and all that had theirs; labels point to places at or before their own."""
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            return
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label[:] = label[label]


def _counted(d: int, cosine: float, parts: int):
    blocks = _blocks(d, parts)
    budgets = [(2 - 2 * cosine) * (hi - lo) / d + _SLACK for lo, hi in blocks]

    def run(table: pa.Table) -> pa.Table:
        b, i, j = (table.column(c)[0].as_py() for c in "bij")
        apart = i != j  # other than a chunk with itself
        lo, hi = blocks[b]
        table = table.sort_by("rep")
        role = table.column("role").to_numpy()
        ids, many = table.column("rep"), table.column("many").to_numpy()
        x = matrix(table.column("embedding"), d)
        turned, norm = _turned(x), np.sqrt(dots(x, x))
        inner, outer = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        part, length = turned[:, lo:hi], (turned[:, lo:hi] ** 2).sum(axis=1)
        _, name = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        first_at = np.full(name.max() + 1, len(name))
        np.minimum.at(first_at, name, np.arange(len(name)))
        label, links = np.arange(name.max() + 1), np.zeros(name.max() + 1, np.int64)
        step = max(1, (1 << 23) // max(1, len(outer)))
        theirs, their_length = np.ascontiguousarray(part[outer].T), length[outer]
        for at in range(0, len(inner), step):
            mine = inner[at : at + step]
            far = length[mine][:, None] + their_length - 2 * (part[mine] @ theirs)
            near = np.flatnonzero(far.ravel() <= budgets[b] + _SLACK)
            for k in range(0, len(near), 1 << 18):
                i, j = mine[near[k : k + (1 << 18)] // len(outer)], outer[near[k : k + (1 << 18)] % len(outer)]
                other = apart | (name[i] < name[j])
                i, j = i[other], j[other]
                for e, (p, q) in enumerate(blocks[: b + 1]):
                    gap = turned[i, p:q].astype(np.float64) - turned[j, p:q]
                    within = dots(gap, gap) <= budgets[e]
                    ok = within if e == b else ~within
                    i, j = i[ok], j[ok]
                if len(i):
                    ok = dots(x[i], x[j]) >= cosine * (norm[i] * norm[j])
                    i, j = i[ok], j[ok]
                    np.add.at(links, name[i], many[j])
                    np.add.at(links, name[j], many[i])
                    _joined(label, name[i], name[j])
        at = first_at[links > 0]
        return pa.table({"rep": ids.take(pa.array(at)), "links": pa.array(links[links > 0]), "root": ids.take(pa.array(first_at[label[links > 0]]))})

    return run


def _linked(reps: DataFrame, d: int, cosine: float, parts: int, chunk: int) -> DataFrame:
    """(rep, links, root): for vectors of length d that link in some task, how many rows they link with there, and a local component.

    In the slab in which it is at home a vector is a member (role 0); there it meets the members of its own slab that
    come after it (role 1) and all of the next one (role 2), so that each pair within reach meets once a block.
    """
    placed = stored(_slabs(reps, d, cosine, parts))
    keyed = placed.select("rep", "many", "embedding", F.posexplode("slabs").alias("b", "slab"))
    counts = keyed.groupBy("b", "slab").count()
    sizes = counts.join(counts.select("b", (F.col("slab") - 1).alias("slab"), F.col("count").alias("next")), ["b", "slab"], "left")
    chunks = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    sizes = stored(sizes.select("b", "slab", chunks("count").alias("own"), F.coalesce(chunks("next"), F.lit(0)).alias("next")))
    roles = keyed.select("*", F.explode(F.expr("array(struct(0 as role, slab as at), struct(1 as role, slab as at), struct(2 as role, slab - 1 as at))")).alias("x"))
    roles = roles.select("b", F.col("x.at").alias("slab"), "x.role", "rep", "many", "embedding").join(sizes, ["b", "slab"])
    part = "cast(pmod(xxhash64(rep), if(role = 2, next, own)) as int)"
    met = "case role when 0 then concat(sequence(part, own - 1), if(next = 0, array(), sequence(-next, -1))) when 1 then sequence(0, part) else sequence(0, own - 1) end"
    dealt = roles.withColumn("part", F.expr(part)).withColumn("other", F.explode(F.expr(met)))
    dealt = dealt.select("b", "slab", F.expr("if(role = 0, part, other)").alias("i"), F.expr("case role when 0 then other when 1 then part else part - next end").alias("j"), "role", "rep", "many", "embedding")
    kind = reps.schema["rep"].dataType.simpleString()
    return stored(dealt.groupBy("b", "slab", "i", "j").applyInArrow(_counted(d, cosine, parts), f"rep {kind}, links long, root {kind}"))


def vector_duplicates(df: DataFrame, cosine: float = 0.9, parts: int = 4, chunk: int = 16384) -> DataFrame:
    """One row for each row of (vec_id, embedding): n_links, component_id and kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths not with each other. Every row counts as a vector, repeated ones too. An empty table gives no rows. Other
    columns, also such as ``rep`` or ``links``, are not read.
    """
    rows = df.select("vec_id", F.when(F.expr(usable()), F.col("embedding")).alias("embedding"))
    reps = stored(rows.filter("embedding is not null and vec_id is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    each = [_linked(reps.filter(F.size("embedding") == d), d, cosine, parts, chunk) for d in lengths(reps)]
    if not each:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = functools.reduce(DataFrame.union, each)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.join(links, "rep", "left").join(whole, reps["rep"] == whole["node"], "left")
    known = stored(known.select(F.col("embedding").alias("same"), (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.join(known, rows["embedding"] == known["same"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
