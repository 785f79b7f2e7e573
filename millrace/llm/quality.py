"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

Cosines of random projections approximate a Gaussian kernel over the standardised statistics. Each partition sums its
part of the normal equations; Spark adds the parts, and the driver solves one small system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import crc_fold, documents, slices, span_hashes, stored, text_bytes, word_spans

_NO_SPACE = np.ones(256, bool)
_NO_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False
_UPPER, _LOWER, _DIGIT, _PUNCT, _END, _WIDE = (np.zeros(256, bool) for _ in range(6))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = _DIGIT[0x30:0x3A] = _WIDE[0x80:] = True
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_END[[ord(c) for c in ".!?"]] = True
_ODD = _PUNCT.copy()
_ODD[[ord(c) for c in ".,;:'\"-()!?"]] = False
STATISTICS = 16


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, STATISTICS): sizes, and shares of characters, words and lines of some kinds. Zeros for an empty text."""
    data, offsets = text_bytes(column)
    rows = len(column)
    length = np.diff(offsets)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(length, 1)

    def spans(inside: np.ndarray) -> tuple[np.ndarray, ...]:
        start, end, doc = word_spans(data, offsets, inside)
        n = np.bincount(doc, minlength=rows)
        key = span_hashes(data, start, end)
        by = np.lexsort((key, doc))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (key[by][1:] != key[by][:-1]) | (doc[by][1:] != doc[by][:-1])
        size = end - start
        mean = np.bincount(doc, weights=size, minlength=rows) / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(np.bincount(doc, weights=size.astype(float) ** 2, minlength=rows) / np.maximum(n, 1) - mean**2, 0))
        return start, end, doc, n, np.bincount(doc[by][fresh], minlength=rows) / np.maximum(n, 1), mean, spread

    start, end, doc, n, different, mean, spread = spans(_NO_SPACE)
    *_, lines, lines_different, line_mean, _ = spans(_LINE)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    letters = np.concatenate([[0], np.cumsum(_LOWER[data] | _WIDE[data], dtype=np.int64)])
    shouted = np.bincount(doc, weights=(upper[end] - upper[start] > 1) & (letters[end] == letters[start]), minlength=rows) / np.maximum(n, 1)
    bare = np.bincount(doc, weights=(letters[end] == letters[start]) & (upper[end] == upper[start]), minlength=rows) / np.maximum(n, 1)
    return np.stack(
        [np.log1p(length), np.log1p(n), np.log1p(lines), mean, spread, different, lines_different, np.log1p(line_mean),
         share(_UPPER), share(_DIGIT), share(_PUNCT), share(_ODD), share(_END), share(_WIDE), shouted, bare], axis=1,
    )


def with_statistics(df: DataFrame) -> DataFrame:
    """(doc_id, statistics) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = pa.FixedSizeListArray.from_arrays(pa.array(statistics(part.column("text")).ravel()), STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "statistics"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, statistics array<double>")


class Kernel:
    """Standardises statistics and maps them to random Fourier features, with a constant at the end."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = 256, width: float = 3.0, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn, self.shift = rng.standard_normal((len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))], axis=1)


def _array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def normal_equations(rows: DataFrame, kernel: Kernel, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fold the sums of z z' and z y over rows (statistics, quality, fold), and its number of rows.

    They are added up in each partition, then row by row of the matrix; the last row of z z' counts, as z ends in one.
    """
    size = len(kernel.shift) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, y, fold = kernel(_array(part.column("statistics"))), part.column("quality").to_numpy(), part.column("fold").to_numpy()
                for k in range(folds):
                    total[k] += z[fold == k].T @ np.concatenate([z, y[:, None]], axis=1)[fold == k]
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), size + 1).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds * size)), sums], names=["i", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.add.reduce([np.asarray(x.values) for x in table.column("sums")])
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([sums])})

    parts = rows.select("statistics", "quality", "fold").mapInArrow(run, "i long, sums array<double>")
    table = parts.groupBy("i").applyInArrow(add, "i long, sums array<double>").toArrow().sort_by("i")
    whole = np.array(table.column("sums").to_pylist()).reshape(folds, size, size + 1)
    return whole[:, :, :-1], whole[:, :, -1], whole[:, -1, -2]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence that is nearest in weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


class QualityModel:
    """The kernel, ridge weights, and knots of the calibration."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, knots: np.ndarray, steps: np.ndarray):
        self.kernel, self.weights, self.knots, self.steps = kernel, weights, knots, steps

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.steps), 0, 1)


def _mapped(rows: DataFrame, f, name: str) -> DataFrame:
    """Rows with statistics replaced by f of them and of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep = [c for c in part.schema.names if c != "statistics"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(f(_array(part.column("statistics")), part))], names=[*keep, name])

    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name != "statistics"]
    return rows.mapInArrow(run, ", ".join([*fields, f"{name} double"]))


def train(rows: DataFrame, ridge: float = 1e-3, bins: int = 512, folds: int = 4) -> QualityModel | None:
    """A model from all rows (doc_id, statistics, quality from 0 to 1), or None without any.

    All rows teach the ridge regression. The isotonic steps are fitted on scores of rows that the scoring weights haven't
    seen: each fold, by the crc32 of the id, is scored by weights from the sums of the others. A fold without others is
    scored by the weights of all.
    """
    fold = F.expr(f"cast(crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 5 % {folds} as int)")
    rows = stored(rows.select("statistics", F.col("quality").cast("double").alias("quality"), fold.alias("fold")))
    each = [f(F.get("statistics", F.lit(k))).alias(f"{n}{k}") for k in range(STATISTICS) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    got = rows.agg(F.count("*").alias("n"), *each).first()
    if not got["n"]:
        return None
    kernel = Kernel(np.array([got[f"m{k}"] for k in range(STATISTICS)]), np.array([got[f"d{k}"] for k in range(STATISTICS)]))
    a, b, n = normal_equations(rows, kernel, folds)

    def solved(parts: list[int]) -> np.ndarray:
        return np.linalg.solve(a[parts].sum(axis=0) + ridge * n[parts].sum() / b.shape[1] * np.eye(b.shape[1]), b[parts].sum(axis=0))

    weights = solved([*range(folds)])
    others = [[j for j in range(folds) if j != k and n[j]] for k in range(folds)]
    unseen = np.stack([solved(parts) if parts else weights for parts in others], axis=1)
    raw = _mapped(rows, lambda x, part: (kernel(x) @ unseen)[np.arange(len(x)), part.column("fold").to_numpy()], "raw")
    binned = raw.withColumn("bin", F.expr(f"cast(floor((least(greatest(raw, -0.5D), 1.5D) + 0.5D) * {bins / 2}D) as int)"))
    sums = sorted(map(tuple, binned.groupBy("bin").agg(F.avg("raw"), F.avg("quality"), F.count("*")).collect()))
    steps = isotonic(np.array([s[2] for s in sums]), np.array([float(s[3]) for s in sums]))
    return QualityModel(kernel, weights, np.array([s[1] for s in sums]), steps)


def predict(df: DataFrame, model: QualityModel | None, into: str = "score") -> DataFrame:
    """Adds the score of each text to rows of any columns; 0.5 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = model.scores(statistics(part.column("text"))) if model else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{into}` double")


def train_on(df: DataFrame, labels: DataFrame) -> tuple[QualityModel | None, DataFrame]:
    """The model from labelled rows whose crc32 of the id isn't 0 modulo 5, and the statistics of all rows."""
    rows = stored(with_statistics(df))
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    return train(rows.filter(crc_fold() != 0).join(known, "doc_id")), rows


def score_quality(df: DataFrame, labels: DataFrame, keep_from: float = 0.3) -> DataFrame:
    """One row for each row of (doc_id, text): held_out, score and predicted.

    Trains on labelled rows whose crc32 of the id isn't 0 modulo 5. Null and empty texts have zero statistics and a
    score like others; without any labels scores are 0.5. Texts of any length are read whole; repeated rows give repeated
    rows, repeated labels of a document count as their mean; other columns, ``score`` and ``predicted`` too, are not read.
    """
    model, rows = train_on(df, labels)
    scored = _mapped(rows, lambda x, _: model.scores(x) if model else np.full(len(x), 0.5), "score")
    return scored.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
