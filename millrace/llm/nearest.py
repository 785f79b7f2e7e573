"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of several full-dimensional codebooks, found by beam search. The
codebooks are trained on a bounded sample: k-means on residuals, then least squares for all words at once. The index
holds, for every row, the codes and the norms of the vector and of its reconstruction. A query's table of inner
products with all words scores a row by adding looked-up entries; the best of each block of rows are scored again
exactly on the original vectors, and so is every other row that may still reach them: a code's score is off by the
query's length times the length of the row's coding error at most. Equal vectors are one row of the index, with the
few smallest ids that a query could ask for.
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
from millrace.llm.vectors import dots, lengths, matrix, usable


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = (centres**2).sum(1)
    return np.concatenate([(length - 2 * x[k : k + 2048] @ centres.T).argmin(1) for k in range(0, len(x), 2048)])


def _summed(own: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(own, weights=x[:, k], minlength=n) for k in range(x.shape[1])], axis=1)


class AdditiveQuantiser:
    """Codebooks of shape (books, words, dimension) and the beam search over them."""

    def __init__(self, books: np.ndarray, beam: int = 4):
        self.books, self.beam = books.astype(np.float32), beam

    @classmethod
    def trained(cls, sample: np.ndarray, books: int = 12, words: int = 256, beam: int = 4, rounds: int = 5, seed: int = 11) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        words = max(1, min(words, len(x)))
        made, left = [], x.copy()
        for _ in range(books):
            centres = left[rng.choice(len(left), words, replace=False)]
            for _ in range(rounds):
                own = _closest(left, centres)
                n = np.bincount(own, minlength=words)
                sums = _summed(own, left, words)
                centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], left[rng.choice(len(left), words)]).astype(np.float32)
            left -= centres[_closest(left, centres)]
            made.append(centres)
        coder = cls(np.stack(made), beam)
        for _ in range(2):  # all words at once, for the codes that beam search finds
            codes = coder.encode(x).astype(np.int64)
            ridge = np.eye(books * words)
            for m in range(books):
                for o in range(books):
                    met = np.bincount(codes[:, m] * words + codes[:, o], minlength=words * words).reshape(words, words)
                    ridge[m * words : (m + 1) * words, o * words : (o + 1) * words] += met
            rest = x - coder.decode(codes)
            change = np.concatenate([_summed(codes[:, m], rest, words) for m in range(books)])
            flat = coder.books.reshape(-1, x.shape[1])
            coder = cls((flat + np.linalg.solve(ridge, change)).reshape(coder.books.shape), beam)
        return coder

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._beamed(x[k : k + 1024].astype(np.float32)) for k in range(0, len(x), 1024)] or [np.zeros((0, len(self.books)), np.uint8)])

    def _beamed(self, x: np.ndarray) -> np.ndarray:
        books, words, _ = self.books.shape
        left, error = x[:, None, :], (x**2).sum(1)[:, None]
        codes = np.zeros((len(x), 1, 0), np.uint8)
        for book in self.books:
            score = (error[:, :, None] + (book**2).sum(1) - 2 * (left @ book.T)).reshape(len(x), -1)
            keep = min(self.beam, score.shape[1])
            best = np.argpartition(score, keep - 1, axis=1)[:, :keep]
            of, word = best // words, best % words
            row = np.arange(len(x))[:, None]
            codes = np.concatenate([codes[row, of], word[:, :, None].astype(np.uint8)], axis=2)
            left, error = left[row, of] - book[word], score[row, best]
        return codes[np.arange(len(x)), error.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, books, words) inner products."""
        return np.einsum("qd,mwd->qmw", queries.astype(np.float32), self.books, optimize=True)


def build_index(rows: DataFrame, d: int, sample: int = 16384, books: int = 12, beam: int = 4) -> tuple[DataFrame, AdditiveQuantiser]:
    """The index of every row of (vec_id, embedding, ids), and the coder; it is trained on ``sample`` rows at most, by a hash of the id."""
    some = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(sample).select("embedding").toArrow()
    coder = AdditiveQuantiser.trained(matrix(some.column("embedding"), d), books=books, beam=beam)
    words = coder.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AdditiveQuantiser(words, beam)
        for batch in batches:
            x = matrix(batch.column("embedding"), d)
            codes = own.encode(x)
            made = own.decode(codes).astype(np.float64)
            length = np.linalg.norm(made, axis=1)
            scale = np.linalg.norm(x, axis=1) / np.where(length > 0, length, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), batch.column("ids"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(np.linalg.norm(x - scale[:, None] * made, axis=1))],
                names=["vec_id", "embedding", "ids", "codes", "scale", "error"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("vec_id", "embedding", "ids").schema)
    return stored(rows.select("vec_id", "embedding", "ids").mapInArrow(run, f"{fields}, codes binary, scale double, error double")), coder


def distinct_vectors(rows: DataFrame, least: int, salts: int = 32) -> DataFrame:
    """(embedding, vec_id, ids): each different vector with its smallest id, and its ``least`` smallest ids with how often they occur.

    Copies are thinned twice, so that a large group comes into one task as a few ids of each of its ``salts`` parts.
    """
    counted = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("n")).withColumn("salt", F.expr(f"pmod(xxhash64(vec_id), {salts})"))
    for keys in (["embedding", "salt"], ["embedding"]):
        counted = counted.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("at") <= least).drop("at")
    return counted.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))


def _searched(words: np.ndarray, d: int, k: int, deep: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.equal(table.column("role"), 0))
        held = table.filter(pc.equal(table.column("role"), 1)).sort_by("vec_id")
        coder = AdditiveQuantiser(words)
        q, x = matrix(asked.column("embedding"), d), matrix(held.column("embedding"), d)
        out_q, out_v, out_s = [], [], []
        if len(q) and len(x):
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            scale, error = held.column("scale").to_numpy(), held.column("error").to_numpy()
            bulk = np.linalg.norm(words.astype(np.float64), axis=2).max(axis=1).sum()
            reach = error + 1e-5 * scale * bulk  # with the rounding of scores
            ids = held.column("ids").combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            own, many = (c.to_numpy(zero_copy_only=False) for c in ids.flatten().flatten())
            at_id = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
            _, place = np.unique(own, return_inverse=True)
            names = asked.column("vec_id").to_numpy()
            lengths = np.linalg.norm(q, axis=1)
            for at in range(0, len(q), 64):
                part = q[at : at + 64]
                looked = coder.tables(part)
                score = np.zeros((len(part), len(x)), np.float32)
                for m in range(codes.shape[1]):
                    score += looked[:, m, :][:, codes[:, m]]
                for r, code_score in enumerate(score * scale):
                    query, name, length = part[r], names[at + r], lengths[at + r]
                    alone = np.zeros(len(x), bool)  # rows that have the query's id only
                    mine = np.searchsorted(at_id, np.flatnonzero(own == name), side="right") - 1
                    alone[mine] = at_id[mine + 1] - at_id[mine] == 1
                    code_score[alone] = -np.inf
                    keep = min(max(deep, k), len(x))
                    best = np.argpartition(-code_score, keep - 1)[:keep]
                    first = np.sort((x[best] @ query)[~alone[best]])[::-1]
                    rounding = 1e-12 * length
                    least = first[k - 1] - rounding * np.abs(x[best]).sum(axis=1).max() if len(first) >= k else -np.inf
                    near = np.flatnonzero(~(code_score + length * reach < least) & ~alone)
                    close = x[near] @ query
                    if len(near) > k:
                        cut = np.partition(close, len(near) - k)[len(near) - k]
                        near = near[close >= cut - 2 * rounding * np.abs(x[near]).sum(axis=1).max()]
                    exact = dots(np.broadcast_to(query, (len(near), d)), x[near])
                    each = at_id[near + 1] - at_id[near]
                    take = np.repeat(at_id[near] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum()) if len(near) else np.zeros(0, np.int64)
                    found, other = np.repeat(exact, each), own[take] != name
                    take, found = take[other], found[other]
                    order = np.lexsort((place[take], -found))[:k]
                    order = np.repeat(order, many[take[order]])[:k]
                    out_q.append(np.repeat(names[at + r : at + r + 1], len(order)))
                    out_v.append(own[take[order]])
                    out_s.append(found[order])
        return pa.table({"query_id": np.concatenate(out_q or [np.zeros(0, np.int64)]), "vec_id": np.concatenate(out_v or [np.zeros(0, np.int64)]), "score": np.concatenate(out_s or [np.zeros(0)])})

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, asked_block: int = 65536, deep: int = 256, sample: int = 16384, books: int = 12) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, ties to the smaller id.

    ``queries`` has (vec_id, embedding); a row with the query's id is no candidate. Every row is scored by its codes,
    in blocks of ``block`` rows against ``asked_block`` queries; the best ``deep`` of each block and all that may reach
    its k best are scored exactly. Null, zero and non-finite vectors take no part; vectors of each length are searched
    among themselves. Query rows of one id count once, with the smallest of their vectors; repeated candidate rows count
    each. An empty table gives no rows. Other columns, ``rank`` and ``score`` too, are not read.
    """
    rows = df.select("vec_id", "embedding").filter(usable() + " and vec_id is not null")
    asked = queries.select("vec_id", "embedding").filter(usable() + " and vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    id_kind = df.schema["vec_id"].dataType.simpleString()
    found = [_found(rows.filter(F.size("embedding") == d), asked.filter(F.size("embedding") == d), d, k, block, asked_block, deep, sample, books) for d in lengths(rows)]
    if not found:
        return df.sparkSession.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = functools.reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, asked: DataFrame, d: int, k: int, block: int, asked_block: int, deep: int, sample: int, books: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each block of vectors of length d."""
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    index, coder = build_index(stored(distinct_vectors(rows, k + 1)), d, sample, books)
    asked = stored(asked)
    held_blocks, asked_blocks = max(1, -(-index.count() // block)), max(1, -(-asked.count() // asked_block))
    held = index.select(
        F.expr(f"cast(pmod(xxhash64(vec_id, error), {held_blocks}) as int)").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))).alias("a"),
        F.lit(1).alias("role"), "vec_id", "embedding", "ids", "codes", "scale", "error",
    )
    posed = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(held_blocks - 1))).alias("h"), F.expr(f"cast(pmod(xxhash64(vec_id), {asked_blocks}) as int)").alias("a"),
        F.lit(0).alias("role"), "vec_id", "embedding", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("error"),
    )
    return held.union(posed).groupBy("h", "a").applyInArrow(_searched(coder.books, d, k, deep), f"query_id {id_kind}, vec_id {id_kind}, score double")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))
