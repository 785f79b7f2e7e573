"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch is its k smallest shingle hashes. Documents with the same shingle set are one from the start.
Inverted lists of retained values give pairs, the sketch of the union estimates their similarity, and full sets
confirm it. Only components are asked for, so lists are worked off in two rounds and never give all pairs of copies:

1. each document meets bounded chunks of the lists of its two smallest shared values, is paired with its few closest
   partners there, and confirmed pairs are joined to components. This round may miss links.
2. what may still link across components is looked at in full. Lists of two neighbouring retained values, which
   documents that merely share a passage seldom have in common, give pairs directly if they are short. "Warm"
   documents, with too few such lists, also meet in the lists of their ``first`` smallest values: those outside the
   list's largest component meet all others in blocks of bounded size, where full sets are compared at once and only
   links of a spanning forest come out.

A pair of similarity t shares each of the union's k smallest values with probability t at least, whatever the texts
are, since the hash is independent of them. Chances that a pair of similarity 0.8 (0.85) is missed, at k = 32, by exact
sums over the union's values: an estimate below ``floor`` 2e-7 (1e-9); under a tenth of its lists shared 6e-9 (5e-11);
none of 24 neighbour lists shared 2e-7 (5e-9); none of the 8 smallest values shared 3e-8 (2e-9). Every pair that is
found is confirmed on full sets; sets of no more than k values are their own sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, slices, stored
from millrace.llm.shingles import shingle_sets
from millrace.operators.graph import components


def sketches(df: DataFrame, k: int, size: int) -> DataFrame:
    """(doc_id, n, same, sketch) of each row; same is a 128-bit hash of the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            full, at = shingle_sets(part.column("text"), size)
            n = np.diff(at)
            kept = np.minimum(n, k)
            ends = np.concatenate([[0], np.cumsum(kept)])
            take = np.repeat(at[:-1] - ends[:-1], kept) + np.arange(ends[-1])
            same = [xxhash.xxh128_digest(full[a:b].tobytes()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(full[take]))],
                names=["doc_id", "n", "same", "sketch"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, same binary, sketch array<long>")


def full_sets(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, full): sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            full, at = shingle_sets(part.column("text"), size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(full))], names=["doc_id", "full"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, full array<long>")


def estimate(x: str, y: str, k: int) -> Column:
    """Share of the union's k smallest values that both sketches hold."""
    return F.expr(f"size(array_intersect(array_intersect({x}, {y}), slice(array_sort(array_union({x}, {y})), 1, {k}))) / least({k}, size(array_union({x}, {y})))")


def _likely(pairs: DataFrame, nodes: DataFrame, k: int, floor: float) -> DataFrame:
    x = nodes.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"))
    y = nodes.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(estimate("x", "y", k) >= floor).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                one, two = x[i].values.to_numpy(), y[i].values.to_numpy()
                at = np.searchsorted(two, one)
                both = int(np.count_nonzero(two[np.minimum(at, len(two) - 1)] == one)) if len(two) else 0
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("doc_id").alias("a"), F.col("full").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("full").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def _overlaps(owner: np.ndarray, values: np.ndarray, at: np.ndarray, n: int):
    """A function that gives, for member m, how many of its values each of the n members has."""
    _, group, size = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(group, kind="stable")
    start = np.cumsum(size) - size

    def counts(m: int) -> np.ndarray:
        g = group[at[m] : at[m + 1]]
        many = size[g]
        take = np.repeat(start[g] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.bincount(owner[order[take]], minlength=n)

    return counts


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and value of all entries, and where each list begins."""
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    return np.repeat(np.arange(len(column)), np.diff(at)), column.flatten().to_numpy(), at


def _closest(chunks: DataFrame, partners: int, kind: str) -> DataFrame:
    """(a, b): for each member of a chunk the few others that share most of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sketch = batch.column("members")[i].values.flatten()
                owner, values, at = _lists(sketch)
                length, n = np.diff(at), len(ids)
                counts = _overlaps(owner, values, at, n)
                p, q = [], []
                for m in range(n):
                    shared = counts(m)
                    shared[m] = 0
                    best = np.argsort(-shared, kind="stable")[:partners]
                    best = best[2 * shared[best] >= np.minimum(length[best], length[m])]
                    p += [m] * len(best)
                    q += best.tolist()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p, pa.int64())), ids.take(pa.array(q, pa.int64()))], names=["p", "q"])

    return chunks.select("members").mapInArrow(run, f"p {kind}, q {kind}").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a <> b").distinct()


def _block_links(blocks: DataFrame, percent: int, kind: str) -> DataFrame:
    """(a, b): a spanning forest of the confirmed links between the asking members of a block and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asks, component, full = batch.column("members")[i].values.flatten()
                asks = asks.to_numpy(zero_copy_only=False)
                _, component = np.unique(component.to_numpy(zero_copy_only=False), return_inverse=True)
                owner, values, at = _lists(full)
                size, n = np.diff(at), len(ids)
                counts = _overlaps(owner, values, at, n)
                p, q = [], []
                for m in np.flatnonzero(asks):
                    if (component == component[m]).all():
                        break
                    both = counts(m)
                    near = np.flatnonzero((100 * both >= percent * (size + size[m] - both)) & (component != component[m]))
                    _, one = np.unique(component[near], return_index=True)
                    for o in near[one]:
                        p.append(m)
                        q.append(o)
                        component[component == component[o]] = component[m]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p, pa.int64())), ids.take(pa.array(q, pa.int64()))], names=["p", "q"])

    return blocks.select("members").mapInArrow(run, f"p {kind}, q {kind}").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, percent: int = 80, size: int = 5, k: int = 32, short: int = 32, cold: int = 24, first: int = 8, floor: float = 0.38, partners: int = 3, block: int = 512, room: int = 1 << 20
) -> DataFrame:
    """One row for each row of (doc_id, text): n_shingles, component_id and whether the document is its component's first.

    Documents link if 100 * |A and B| >= percent * |A or B| for their sets of distinct word shingles. Null, empty and
    wordless texts have empty sets and link with nothing. Repeated rows give repeated rows, all of them kept or none;
    other columns are not read. A block holds about ``block`` documents or ``room`` shingles of either side, whichever
    are fewer; only a document that is longer by itself exceeds them.
    """
    df = df.select("doc_id", "text")
    kind = df.schema["doc_id"].dataType.simpleString()
    base = stored(sketches(df, k, size))
    nodes = stored(base.filter("n > 0 and doc_id is not null").groupBy("same").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x")).select("same", "x.*"))

    pairs_of = "if(size(sketch) < 2, array(xxhash64(sketch[0])), transform(sequence(0, size(sketch) - 2), i -> xxhash64(sketch[i], sketch[i + 1])))"
    keyed = nodes.select("doc_id", "n", F.expr(pairs_of).alias("keys"))
    lists = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("length")).filter("length > 1")
    postings = keyed.select("doc_id", "n", F.size("keys").alias("retained"), F.explode("keys").alias("key")).join(lists, "key")
    active = postings.groupBy("doc_id").agg(F.count("*").alias("shared"), F.count_if(F.col("length") <= short).alias("cold"), F.first("retained").alias("retained"))
    active = active.filter("shared * 10 >= retained").withColumn("warm", F.expr(f"retained - shared + cold < least({cold}, retained)"))
    few = stored(nodes.join(active.select("doc_id", "warm"), "doc_id").select("doc_id", "n", "sketch", "warm"))
    short_lists = stored(postings.filter(F.col("length") <= short).join(few.select("doc_id"), "doc_id").select("key", "doc_id", "n"))
    sets = stored(full_sets(df.join(few.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), size))

    values = few.select("doc_id", F.posexplode("sketch").alias("place", "value"))
    common = values.groupBy("value").agg(F.count("*").alias("length")).filter("length > 1")
    smallest = stored(values.join(common, "value").groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "value", "length"))), 1, 2).alias("v")))
    met = smallest.select("doc_id", F.explode("v").alias("v")).join(few.select("doc_id", "sketch"), "doc_id")
    met = met.groupBy("v.value", F.expr(f"pmod(xxhash64(doc_id), cast(ceil(v.length / {block}) as bigint))").alias("part"))
    near = _closest(met.agg(F.collect_list(F.struct("doc_id", "sketch")).alias("members")).filter("size(members) > 1"), partners, kind)
    links = stored(_confirmed(stored(near), sets, percent))
    known = stored(components(links).withColumnRenamed("node", "doc_id"))
    placed = stored(few.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))

    by_list = short_lists.join(placed.select("doc_id", "component"), "doc_id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n", "component"))).alias("m"))
    by_list = by_list.filter("exists(m, x -> x.component <> m[0].component)")
    agree = f"100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
    inner = f"transform(filter(m, y -> y.doc_id > x.doc_id and y.component <> x.component and {agree}), y -> named_struct('a', x.doc_id, 'b', y.doc_id))"
    direct = by_list.select(F.explode(F.expr(f"flatten(transform(m, x -> {inner}))")).alias("p")).select("p.*").distinct()
    links = links.union(stored(_confirmed(stored(_likely(stored(direct), few, k, floor)), sets, percent)))

    warm = placed.filter("warm").select("doc_id", "n", "component", F.explode(F.slice("sketch", 1, first)).alias("value"))
    each = warm.groupBy("value", "component").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
    mains = each.groupBy("value").agg(
        F.max_by(F.struct("component", "count", "shingles"), F.struct("count", "component")).alias("main"),
        F.sum("count").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("components"),
    )
    blocks = lambda rows, sizes: F.expr(f"cast(ceil(greatest(({rows}) / {block}, ({sizes}) / {room})) as int)")
    mains = mains.filter("components > 1").select(
        "value", "main.component", blocks("members", "shingles").alias("parts"), blocks("members - main.count", "shingles - main.shingles").alias("asking")
    )
    mains = stored(mains.withColumnRenamed("component", "main"))
    dealt = warm.join(mains, "value").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id, value), parts) as int)")).withColumn("ask", F.expr("if(component = main, -1, cast(pmod(xxhash64(doc_id, value, 1), asking) as int))"))
    as_other = dealt.select("value", "part", F.explode(F.expr("sequence(0, asking - 1)")).alias("i"), "doc_id", "component", F.lit(False).alias("asks"))
    as_asking = dealt.filter("ask >= 0").select("value", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("ask").alias("i"), "doc_id", "component", F.lit(True).alias("asks"))
    rows = as_other.union(as_asking).join(sets, "doc_id")
    blocks = rows.groupBy("value", "part", "i").agg(F.collect_list(F.struct("doc_id", "asks", "component", "full")).alias("members"))
    links = stored(links.union(_block_links(blocks, percent, kind)))

    final = components(links)
    named = stored(nodes.select("same", "doc_id").join(final, F.col("doc_id") == F.col("node"), "left").select("same", F.coalesce("component", "doc_id").alias("component")))
    out = base.drop("sketch").join(named, "same", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)
