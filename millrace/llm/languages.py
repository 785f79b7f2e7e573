"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed into a fixed number of features. Document frequencies are counted over
all documents; the model is trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample
of labelled documents, and a temperature fitted on a part of the sample that training doesn't see makes its scores
probabilities.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import crc_fold, documents, slices, stored

FEATURES = 1 << 15
UNKNOWN = "und"
#: Hashed features have values far below one; this brings them near it.
_SCALE = 50.0


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else the space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text number) of all n-grams with a letter, texts in order; n-grams and letters of each text."""
    sizes = np.array([len(x) + 2 for x in texts])
    points = _letters()[np.frombuffer("".join([f" {x} " for x in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = points != 32
    found, owner = [], []
    seed = np.zeros(len(points), np.uint32)
    any_letter = np.zeros(len(points), bool)
    for n in range(1, 4):
        m = len(points) - n + 1
        if m <= 0:
            break
        seed = (seed[:m] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
        any_letter = any_letter[:m] | letter[n - 1 :]
        keep = any_letter & (doc[:m] == doc[n - 1 :])
        h = seed[keep]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        found.append((h >> np.uint32(13)) % np.uint32(FEATURES))
        owner.append(doc[:m][keep])
    feature, owner = np.concatenate(found or [np.zeros(0, np.uint32)]), np.concatenate(owner or [np.zeros(0, np.int64)])
    return feature, owner, np.bincount(owner, minlength=len(texts)), np.bincount(doc[letter], minlength=len(texts))


def document_frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for part in slices(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            for at in range(0, len(texts), 128):
                feature, owner, n, _ = grams(texts[at : at + 128])
                seen = np.zeros((len(n), FEATURES), bool)
                seen[owner, feature] = True
                total[:-1] += np.count_nonzero(seen, axis=0)
                total[-1] += np.count_nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "n"])

    counts = np.zeros(FEATURES + 1, np.int64)
    table = df.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return counts[:-1], int(counts[-1])


def labelled_sample(df: DataFrame, each: int, most: int) -> DataFrame:
    """(doc_id, text, lang): up to ``each`` documents of each language, by a hash of their ids; ``most`` in all, or one of each language.

    Repeated rows count once, whole texts teach; so rows of the sample are bounded by the parameters and the number of
    languages, and what a row sends to the driver by the number of features. Rows are first thinned by the hash to about
    half as many again as wanted, so that no language, however large, comes into one task to be ordered. A row is known
    by a hash of its id, language and text.
    """
    rows = df.filter("lang is not null and text is not null and doc_id is not null").withColumn("row", F.xxhash64("doc_id", "lang", "text"))
    keys = stored(rows.select("lang", "row").distinct())
    counts = stored(keys.groupBy("lang").agg(F.count("*").alias("n")))  # of known size before the join, so that a small one is broadcast and keys stay where they are
    thinned = keys.join(counts, "lang").filter(F.expr(f"pmod(row, 1000000) < 1000000D * (1.5D * {each} + 100) / n"))
    order = Window.partitionBy("lang").orderBy(F.expr("pmod(row, 1000000)"), "row")
    placed = stored(thinned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each).select("row", "lang", "place"))
    languages = placed.filter("place = 1").count()
    chosen = placed.orderBy("place", "lang").limit(max(most, languages)).select("row")
    some = rows.join(F.broadcast(chosen), "row").select("row", "doc_id", "lang", "text")
    return some.groupBy("row").agg(F.first(F.struct("doc_id", "text", "lang")).alias("x")).select("x.*")


class LanguageModel:
    """Weights with inverse document frequencies folded in, biases, temperature and names of the classes."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.names, self.weights, self.bias, self.temperature = names, np.ascontiguousarray(weights.T, np.float32), bias, temperature

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes for each text, and its number of letters."""
        feature, owner, n, letters = grams(texts)
        sums = np.stack([np.bincount(owner, weights=w[feature], minlength=len(texts)) for w in self.weights], axis=1)
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), letters


def fit(features: np.ndarray, shares: np.ndarray, ends: np.ndarray, classes: np.ndarray, names: list[str], idf: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 3) -> LanguageModel:
    """Rows one after another: features, their shares of the text's n-grams, where each row ends, its class. Every fifth row only serves the temperature."""
    k = len(names)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        rate = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(z[at]) > l1, (np.sign(z[at]) * l1 - z[at]) / rate, 0.0)

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        f = features[ends[i] : ends[i + 1]]
        return np.append(f, FEATURES), np.append(shares[ends[i] : ends[i + 1]] * idf[f] * _SCALE, 1.0)

    order = np.random.default_rng(3)
    at = np.arange(len(classes))
    learn, fitted = at[at % 5 > 0], at[at % 5 == 0]
    for _ in range(epochs):
        for i in learn[order.permutation(len(learn))]:
            (f, x), c = row(i), classes[i]
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[c] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    w = weights(slice(None))
    logits = np.array([x @ w[f] for f, x in map(row, fitted)]).reshape(len(fitted), k)
    right = classes[fitted]

    doubt = (k - 1) / (len(fitted) + k)  # what is kept for the other classes, so that a faultless sample isn't taken for certainty

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(axis=1, keepdims=True)
        log_p = s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))
        own = log_p[np.arange(len(s)), right]
        return float(-((1 - doubt) * own + doubt / max(1, k - 1) * (log_p.sum(axis=1) - own)).mean())

    temperature = min(np.exp(np.linspace(-3, 3, 121)), key=loss) if len(fitted) else 1.0
    return LanguageModel(names, w[:-1] * idf[:, None] * _SCALE, w[-1], float(temperature))


def train(df: DataFrame, each: int = 1000, most: int = 6000) -> LanguageModel | None:
    """A model from rows (doc_id, text, lang), or None if no row has a language and a letter.

    Weights come from a sample of up to ``each`` rows a language and ``most`` in all, document frequencies from all rows.
    """
    df = df.select("doc_id", "text", "lang")
    df_counts, total = document_frequencies(df)
    idf = np.log((1 + total) / (1 + df_counts)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            feature, owner, n, letters = grams([x or "" for x in part.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum(n)])
            by = np.argsort(owner, kind="stable")
            features, shares = [], []
            for i in range(part.num_rows):
                f, c = np.unique(feature[by[ends[i] : ends[i + 1]]], return_counts=True)
                features.append(f.astype(np.int32))
                shares.append((c / max(1, n[i])).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), pa.array(features, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "lang", "features", "shares"]
            ).filter(pa.array(letters > 0))

    kind = df.schema["doc_id"].dataType.simpleString()
    table = labelled_sample(df, each, most).mapInArrow(run, f"doc_id {kind}, lang string, features array<int>, shares array<float>").toArrow()
    table = table.take(pc.sort_indices(table.select(["doc_id", "lang"]), [("doc_id", "ascending"), ("lang", "ascending")])).combine_chunks()
    langs = table.column("lang").to_pylist()
    names = sorted(set(langs))
    if not names:
        return None
    place = {x: k for k, x in enumerate(names)}
    lists = table.column("features")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    flat = [pc.list_flatten(table.column(c)).to_numpy() for c in ("features", "shares")]
    return fit(*flat, ends, np.array([place[x] for x in langs]), names, idf)


def predict(df: DataFrame, model: LanguageModel | None, label: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds the label and its score to rows with a text; und with score 0 if the text is null or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            if model is None:
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p, letters = model.scores(texts)
                best = p.argmax(axis=1)
                names = [model.names[b] if some else UNKNOWN for b, some in zip(best, letters > 0)]
                score = np.where(letters > 0, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names], pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names, label, score_name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{label}` string, `{score_name}` double")


def identify(df: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text, lang): held_out, lang_pred and score.

    Trains on rows whose crc32 of the id isn't 0 modulo 5. Null texts and those without letters are und with score 0;
    languages that are null teach nothing; of classes with the same score the first by name is taken; texts of any
    length are read whole; repeated rows give repeated rows; other columns, ``lang_pred`` and ``score`` too, are not read.
    """
    model = train(df.filter(crc_fold() != 0))
    return predict(df.select("doc_id", "text"), model).select("doc_id", (crc_fold() == 0).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
