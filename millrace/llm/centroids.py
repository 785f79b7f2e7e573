"""Centroid clustering of vectors of whole numbers, with scalar lookup tables.

The vectors are stored once in blocks: for each dimension the values that occur in the block, and for each vector the
places of its components among them. A round tabulates, for each dimension, occurring value and centroid, the squared
difference; a vector's distance to a centroid is then a sum of gathered table entries, without any multiplication.
Every round is a job over the stored blocks whose tasks send the sums and counts of their clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.topk import finite, scaled
from millrace.llm.vectors import matrix

#: Differences of values within this, squared and summed over the dimensions and vectors of a block, fit in a long.
_WITHIN = 1 << 20


def _encoded(rows: DataFrame, d: int) -> DataFrame:
    """Blocks of (ids, values, sizes, codes): the occurring values of all dimensions one after another, their numbers, and the place of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), d)
            if x.size and np.abs(x).max() >= _WITHIN:
                raise ArithmeticError("squared distances of these vectors don't fit in a long; scale them by less")
            x = x.astype(np.int64)
            values, codes, sizes = [], np.empty(x.shape, np.int32), []
            before = 0
            for k in range(d):
                own, codes[:, k] = np.unique(x[:, k], return_inverse=True)
                codes[:, k] += before
                before += len(own)
                values.append(own)
                sizes.append(len(own))
            whole = np.concatenate(values or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("vec_id").to_pylist()], pa.list_(batch.column("vec_id").type)), pa.array([whole.tobytes()], pa.binary()), pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([codes.T.tobytes()], pa.binary()),
                ],
                names=["ids", "values", "sizes", "codes"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<{kind}>, values binary, sizes array<int>, codes binary")


def _tabulated(values: np.ndarray, sizes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(centroids, occurring values of all dimensions) squared differences."""
    return (values[None, :] - np.repeat(centroids, sizes, axis=1)) ** 2


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block the ids, the vectors' clusters and distances, and the vectors by dimension."""
    for batch in batches:
        for ids, values, sizes, codes in zip(*(batch.column(c) for c in ("ids", "values", "sizes", "codes")), strict=True):
            values, sizes = np.frombuffer(values.as_py(), np.int64), np.array(sizes.as_py(), np.int64)
            codes = np.frombuffer(codes.as_py(), np.int32).reshape(len(sizes), len(ids.as_py()))
            table = _tabulated(values, sizes, centroids)
            distance = np.zeros((len(centroids), codes.shape[1]), np.int64)
            for own in codes:
                distance += table[:, own]
            cluster = distance.argmin(0)  # the first of equal ones
            yield ids.as_py(), cluster, distance[cluster, np.arange(len(cluster))], values[codes]


def _summed(encoded: DataFrame, centroids: np.ndarray) -> list:
    """Rows of cluster, number of vectors, sum of distances and the sums of each dimension: one row for each cluster that isn't empty."""
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(len(centroids), np.int64), [0] * len(centroids), np.zeros((len(centroids), d), np.int64)
        for _, cluster, distance, x in _blocks(batches, centroids):
            for c in np.unique(cluster):
                mine = cluster == c
                n[c] += mine.sum()
                inertia[c] += int(distance[mine].sum())
                sums[c] += x[:, mine].sum(axis=1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array([str(inertia[c]) for c in some], pa.string()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "inertia", "sums"])

    parts = encoded.mapInArrow(run, "cluster int, n long, inertia string, sums array<long>")
    whole = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(d)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *whole).collect()


def cluster(rows: DataFrame, start: DataFrame, rounds: int = 10) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): Lloyd's rounds on whole numbers.

    ``rows`` has (vec_id, v array<double> of whole numbers), ``start`` the few vectors (vec_id, v) that are the first
    centroids, in order. Each round assigns every vector to the nearest centroid (squared distance, ties to the smaller
    number) and moves centroids to the rounded-down means; empty ones stay. Then vectors are assigned once more. Rows
    whose vector is null or of another length than the centroids take no part; repeated rows count each, a null id
    stays null. Numbers of 2^20 or more raise an ArithmeticError. Without centroids there are no rows. Other columns
    aren't read. Only centroids and one row of sums for each of them reach the driver.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    first = [r["v"] for r in start.select("v").collect()]
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    centroids, d = np.array(first, np.float64).astype(np.int64).reshape(len(first), -1), len(first[0])
    encoded = stored(_encoded(rows.select("vec_id", "v").filter(F.size("v") == d), d))
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _summed(encoded, centroids):
            moved[r["cluster"]] = [int(r[f"s{k}"]) // r["n"] for k in range(d)]
        if (moved == centroids).all():
            break  # all further rounds would change nothing
        centroids = moved
    inertia = {r["cluster"]: int(r["inertia"]) for r in _summed(encoded, centroids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for ids, own, distance, _ in _blocks(iter([batch]), centroids):
                made = [pa.array(ids, id_type), pa.array(own.astype(np.int32)), pa.array(distance), pa.array([inertia[c] for c in own.tolist()], pa.int64()), pa.array([sum(inertia.values())] * len(own), pa.int64())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * d, pa.int32()), pa.array(centroids[own].ravel()))
                yield pa.RecordBatch.from_arrays([*made, lists], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return encoded.mapInArrow(run, schema)


def by_hash(rows: DataFrame, k: int = 8, prefix: str = "3:") -> DataFrame:
    """The k vectors of the smallest SHA-256 of prefix and id, in that order; a null id counts as empty text, rows of one id come by their vector."""
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return rows.orderBy(key, "v").limit(k)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(finite()).filter("size(embedding) = 64").select("vec_id", F.expr(scaled()).alias("v"))
    found = cluster(rows, by_hash(rows))
    return found.withColumn("centroid_sha256", F.expr("sha2(array_join(centroid, ','), 256)")).drop("centroid")
