"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are documents, dimensions are terms. Rows are put in order by the nearest of a few pivots and a hash,
and each range of that order is a block: the numbers of its rows, their ids and the largest and smallest value of each
dimension. A query's bound of a block is the sum of its terms' maxima: of a dimension where the query is negative the
block's smallest value counts. Each query first meets one block of its own pivot, which gives it a score that its k-th
best reaches at least. Shards of blocks then meet groups of queries; every query takes a shard's blocks by falling bound
and stops when the next bound is below its k-th score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.vectors import matrix

#: Scores up to here are exact sums of doubles.
_EXACT = 1 << 53


def finite(column: str = "embedding") -> str:
    """SQL: the vector isn't null and has neither null nor non-finite components. Unlike ``usable`` zero vectors count."""
    return f"coalesce({column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)"


def scaled(column: str = "embedding", factor: int = 1024) -> str:
    """SQL: the components times ``factor``, rounded down, as doubles that hold whole numbers."""
    return f"transform({column}, x -> cast(floor({factor} * cast(x as double)) as double))"


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    if queries.size and rows.size and rows.shape[1] * float(np.abs(queries).max()) * float(np.abs(rows).max()) >= _EXACT:
        raise ArithmeticError("inner products of these vectors don't fit exactly in a double; scale them by less")
    return queries @ rows.T


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    return np.concatenate([((pivots**2).sum(1) - 2 * x[k : k + 4096] @ pivots.T).argmin(1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _with_pivot(rows: DataFrame, pivots: np.ndarray, d: int) -> DataFrame:
    """Adds ``pivot``, the number of the nearest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _nearest_pivot(matrix(batch.column("v"), d), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32))], names=["vec_id", "v", "pivot"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<double>, pivot int")


def _block_of(cells: DataFrame, rows: DataFrame, seed: str) -> DataFrame:
    """Rows with the block of their cell: ranges of a hash cut a cell into as many blocks as it needs."""
    hashed = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(1 << 30))
    return rows.join(F.broadcast(cells), "pivot", "left").withColumn("block", (F.col("first") + F.floor(hashed * F.col("blocks") / (1 << 30))).cast("long")).drop("first", "blocks")


def _packed(table: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the vectors beside them."""
    table = table.sort_by("vec_id")
    return table.column("vec_id").to_numpy(), matrix(table.column("v"), d)


def _as_block(d: int):
    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        ids, x = _packed(table, d)
        kind = np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.float64
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(x)], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "rows": pa.array([x.astype(kind).tobytes()], pa.binary()), "wide": pa.array([kind is np.float64]), "high": pa.array([x.max(0).tolist()], pa.list_(pa.float64())),
                "low": pa.array([x.min(0).tolist()], pa.list_(pa.float64())),
            }
        )

    return run


class _Best:
    """The best (score, id) of each of a group of queries, and the score that a new one has to reach."""

    def __init__(self, names: np.ndarray, k: int, floor: np.ndarray):
        self.names, self.k, self.floor = names, k, floor.copy()
        self.query, self.ids, self.scores = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the queries ``who`` with all rows of a block."""
        scores = np.where(self.names[who][:, None] == ids[None, :], -np.inf, scores)
        least, n = self.floor[who][:, None], scores.shape[1]
        if n > self.k:  # of one block no more than its own k best and their ties
            least = np.maximum(least, np.partition(scores, n - self.k, axis=1)[:, n - self.k][:, None])
        at, row = np.nonzero((scores >= least) & (scores > -np.inf))
        if len(at):
            self.new.append((who[at], ids[row], scores[at, row]))

    def settle(self) -> None:
        if not self.new:
            return
        query, ids, scores = (np.concatenate(x) for x in zip((self.query, self.ids, self.scores), *self.new, strict=True))
        self.new = []
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], scores[full])
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]


def search_blocks(names: np.ndarray, queries: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], high: np.ndarray, low: np.ndarray, k: int) -> tuple[_Best, int]:
    """The best of the blocks for each query, and how many pairs of a query and a block were scored.

    Rounds take 1, 2, 4, ... further blocks of each query's own order, so that a round scores all queries of a block at once.
    """
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = _products(up, high) + _products(down, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    best, at, step, scored = _Best(names, k, floor), 0, 1, 0
    active = np.arange(len(queries))
    while at < len(blocks) and len(active):
        chosen = order[active, at : at + step]
        who = np.repeat(active, chosen.shape[1])
        block = chosen.ravel()
        wanted = bound[who, block] >= best.floor[who]
        who, block = who[wanted], block[wanted]
        by = np.argsort(block, kind="stable")
        who, block = who[by], block[by]
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if len(part):
                ids, rows = blocks[block[part[0]]]
                best.offer(who[part], ids, _products(queries[who[part]], rows))
                scored += len(part)
        best.settle()
        at, step = at + step, 2 * step
        if at < len(blocks):
            active = active[bound[active, order[active, at]] >= best.floor[active]]
    return best, scored


def _unpacked(table: pa.Table, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.frombuffer(i, np.int64), np.frombuffer(r, np.float64 if w else np.int16).reshape(n, d).astype(np.float64))
        for i, r, w, n in zip(*(table.column(c).to_pylist() for c in ("ids", "rows", "wide", "n")), strict=True)
    ]


def _searched(d: int, k: int, seed: bool):
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.is_valid(table.column("v")))
        held = table.filter(pc.is_valid(table.column("rows"))).sort_by("block")
        names, queries = asked.column("vec_id").to_numpy(), matrix(asked.column("v"), d)
        floor = pc.fill_null(asked.column("floor"), -np.inf).to_numpy()
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(names) and held.num_rows:
            blocks, high, low = _unpacked(held, d), matrix(held.column("high"), d), matrix(held.column("low"), d)
            parts = [search_blocks(names[a : a + 1024], queries[a : a + 1024], floor[a : a + 1024], blocks, high, low, k)[0] for a in range(0, len(names), 1024)]
            out = [np.concatenate(x) for x in zip(*((p.names[p.query], p.ids, p.scores) for p in parts), strict=True)]
            if seed:  # the k-th score of those that have k candidates in their block
                full = [(p.names, p.floor) for p in parts]
                out = [np.concatenate([n[f > -np.inf] for n, f in full]), np.zeros(sum((f > -np.inf).sum() for _, f in full), np.int64), np.concatenate([f[f > -np.inf] for _, f in full])]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 128, shard: int = 256, group: int = 16384, pivots: int = 256, sample: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all rows, ties to the smaller id.

    Both have (vec_id long, v array<double> of whole numbers); a row with the query's id is no candidate. All results are
    exact. A task holds ``shard`` blocks of about ``block`` rows and ``group`` queries. The pivots are vectors of a bounded
    ``sample`` by a hash of the id; they decide which rows share a block and nothing else. Vectors of each length are
    searched among themselves; an empty vector scores 0. Null vectors and null ids take no part. Query rows of one id count
    once, with the smallest of their vectors; repeated candidate rows count each. Numbers so large that a score would be
    inexact raise an ArithmeticError. Empty tables give no rows. Other columns aren't read.
    """
    rows, queries = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "v").filter("vec_id is not null and v is not null") for df in (rows, queries))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    # of rows of one id and one vector no more than k can be among the best
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", "v", F.explode(F.expr(f"sequence(1, int(least(n, {k})))")).alias("n")).drop("n")
    widths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    found = [_top_of(rows.filter(F.size("v") == d), queries.filter(F.size("v") == d), d, k, block, shard, group, pivots, sample) for d in widths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = functools.reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def blocked(rows: DataFrame, d: int, block: int, pivots: int, sample: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The stored blocks of all rows, the cells that the pivots make, and the pivots."""
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).select("v").toArrow()
    points = matrix(some.column("v"), d)
    points = np.unique(points, axis=0) if d else points[:1]
    centres = points[np.random.default_rng(5).permutation(len(points))[:pivots]]
    placed = stored(_with_pivot(rows, centres, d))
    cells = placed.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks"))
    counted = sorted((r["pivot"], r["blocks"]) for r in cells.collect())  # a row for each pivot
    ends = np.cumsum([0] + [b for _, b in counted]).tolist()
    cells = rows.sparkSession.createDataFrame([(p, at, b) for (p, b), at in zip(counted, ends, strict=False)], "pivot int, first long, blocks long")
    made = _block_of(cells, placed, "rows").groupBy("block").applyInArrow(_as_block(d), "block long, n int, ids binary, rows binary, wide boolean, high array<double>, low array<double>")
    return stored(made), cells, centres


def _top_of(rows: DataFrame, queries: DataFrame, d: int, k: int, block: int, shard: int, group: int, pivots: int, sample: int) -> DataFrame:
    held, cells, centres = blocked(rows, d, block, pivots, sample)
    columns = [f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in held.schema if f.name != "block"]
    as_held = held.selectExpr("*", "cast(null as long) as vec_id", "cast(null as array<double>) as v", "cast(null as double) as floor")
    posed = stored(_block_of(cells, _with_pivot(queries, centres, d), "asked"))
    first = as_held.join(posed.select("block").distinct(), "block", "left_semi").unionByName(posed.selectExpr("block", *columns, "vec_id", "v", "cast(null as double) as floor"))
    floors = first.groupBy("block").applyInArrow(_searched(d, k, True), "query_id long, vec_id long, score double")
    asked = stored(posed.join(floors.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")), "vec_id", "left"))
    shards, groups = max(1, -(-held.count() // shard)), max(1, -(-asked.count() // group))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    index = as_held.select(F.expr(f"cast(pmod(hash(block), {shards}) as int)").alias("s"), every(groups, "g"), "*")
    posed = asked.selectExpr("block", *columns, "vec_id", "v", "floor").select(every(shards, "s"), F.expr(f"cast(pmod(hash(vec_id), {groups}) as int)").alias("g"), "*")
    return index.unionByName(posed).groupBy("s", "g").applyInArrow(_searched(d, k, False), "query_id long, vec_id long, score double")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(finite()).select("vec_id", F.expr(scaled()).alias("v"))
    return top_k(rows, rows.filter("vec_id % 100 = 0"))
