"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a document, from each of its words, are sorted; neighbours in that order are linked by the length of
their longest common prefix (LCP). Links are taken by decreasing LCP, and union-find unites classes of suffixes, each
with its positions in order. When a union at LCP ``l`` makes two positions of a distance ``q`` neighbours, the words
from the first on have period ``q`` for ``q + l`` words, and no shorter period if ``q <= l``: a position between the two
would share more with the first and stand between them. A run with period ``q`` is thus seeded once by its first two
periods; other seeds can be extended to the left and go. Only words whose next five stand elsewhere in the document
too can be in a run of four periods, and only these suffixes are sorted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, mixed, slices, text_bytes, word_spans

#: A run has at least so many words and so many periods; hence two of its suffixes share LEAST words or more.
WORDS, PERIODS, LEAST = 6, 4, 5

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def suffix_order(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ``wanted`` positions in the order of their suffixes, by doubling ranks; only ties are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.searchsorted(ids[order], ids[order])
    step, open_ = 1, order
    while len(open_):
        tied = rank[open_]
        alone = np.ones(len(open_), bool)
        same = tied[1:] == tied[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        open_ = open_[~alone]
        if not len(open_):
            break
        open_ = open_[np.argsort(rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n)], kind="stable")]
        first, second = rank[open_], rank[np.minimum(open_ + step, n)]
        group = np.ones(len(open_), bool)
        group[1:] = first[1:] != first[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        place = np.arange(len(open_))
        begins = np.maximum.accumulate(np.where(group, place, 0))
        rank[open_] = first + np.maximum.accumulate(np.where(part, place, 0)) - begins
        step *= 2
    return wanted[np.argsort(rank[wanted], kind="stable")]


def common_prefixes(ids: list[int], order: list[int]) -> list[int]:
    """Words that each suffix of the order shares with the one before it. A suffix shares one word less at least than the suffix from the word before."""
    before = dict(zip(order[1:], order, strict=False))
    shared, last, length = {}, -2, 0
    for at in sorted(order):
        other = before.get(at, -1)
        length = length - 1 if at == last + 1 and length > LEAST else 0
        last = at
        if other < 0:
            length = 0
            continue
        a, b = at + length, other + length
        end = len(ids)
        while a < end and b < end and ids[a] == ids[b]:
            a += 1
            b += 1
        shared[at] = length = a - at
    return [0] + [shared[at] for at in order[1:]]


def seeds(ids: list[int], order: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among the suffixes of ``order``; ``ids`` differ between documents."""
    shared = common_prefixes(ids, order)
    links = sorted((at for at in range(1, len(order)) if shared[at] >= LEAST), key=lambda at: -shared[at])
    parent, held = list(range(len(order))), [[at] for at in order]
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for link in links:
        length = shared[link]
        big, small = root(link - 1), root(link)
        if len(held[big]) < len(held[small]):
            big, small = small, big
        parent[small] = big
        into, added = held[big], held[small]
        held[small] = None
        last, k = -1, 0
        for n, at in enumerate(added):
            k = bisect_left(into, at, k)
            made = []
            if k and into[k - 1] != last:
                made.append((into[k - 1], at))
            if k < len(into) and (n + 1 == len(added) or added[n + 1] > into[k]):
                made.append((at, into[k]))
            for start, other in made:
                period = other - start
                whole = period + length
                if whole >= WORDS and whole >= PERIODS * period and (start == 0 or ids[start - 1] != ids[other - 1]):
                    found.append((start, whole, period))
            into.insert(k, at)
            last = at
    return found


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    bytes_ = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bytes_))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions whose next LEAST words stand elsewhere in the same document too."""
    n = len(codes) - LEAST + 1
    if n < 2:
        return np.zeros(0, np.int64)
    key = owner[:n].astype(np.uint64)
    for k in range(LEAST):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64))
    place = np.flatnonzero(owner[:n] == owner[LEAST - 1 :])
    order = np.argsort(key[place], kind="stable")
    ordered = key[place][order]
    same = np.zeros(len(order), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:].copy()
    return np.sort(place[order[same]])


def runs_of(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position, length, period) of the runs of several documents, and their documents; positions count through all of them."""
    near = _repeated(codes, owner)
    if not len(near):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    busy = np.zeros(owner[-1] + 1, bool)
    busy[owner[near]] = True
    kept = np.flatnonzero(busy[owner])  # whole documents, so that suffixes end where they do
    ids = owner[kept] * (codes.max() + 1) + codes[kept]
    ids = np.unique(ids, return_inverse=True)[1]
    order = suffix_order(ids, np.searchsorted(kept, near))
    found = np.array(seeds(ids.tolist(), order.tolist()), np.int64).reshape(-1, 3)
    found[:, 0] = kept[found[:, 0]]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found, owner[found[:, 0]]


def _of_batch(column: pa.Array) -> tuple[list, list, list]:
    """Per text: the number of words, its runs, and the text without the repeated periods."""
    data, offsets = text_bytes(column)
    start, end, owner = word_spans(data, offsets, _IN_WORD)
    n = np.bincount(owner, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(n)])
    found, of = runs_of(word_codes(data, start, end), owner) if len(start) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    gone = np.zeros(len(start) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    stay = np.cumsum(gone[:-1]) == 0
    at = np.searchsorted(of, np.arange(len(column) + 1))
    found[:, 0] -= first[of]
    rows = [found[at[k] : at[k + 1]].tolist() for k in range(len(column))]
    start, end, owner = start[stay], end[stay], owner[stay]
    whole = np.zeros(len(data) + 1, np.int8)
    whole[start] += 1
    whole[end] -= 1
    spaces = np.zeros(len(data) + 1, bool)
    later = np.ones(len(start), bool)
    later[:1] = False
    later[1:] = owner[1:] == owner[:-1]
    spaces[start[later] - 1] = True  # white space stands before every word but the first
    kept = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    marked = np.where(spaces[:-1], 0x20, data)[kept | spaces[:-1]].astype(np.uint8).tobytes()
    size = np.concatenate([[0], np.cumsum(kept | spaces[:-1])])[offsets]
    return n.tolist(), rows, [marked[size[k] : size[k + 1]].decode() for k in range(len(column))]


def collapse(df: DataFrame, text: str = "text", words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Adds the number of words, all runs (start, length, period) by start and period, and the text without repeats.

    A run is a stretch of six words or more that has at least four times its smallest period and that no word next to it
    extends. Of each run the first period stays; kept words are joined by one space. Null and empty texts have no words,
    no runs and an empty collapsed text; repeated rows are worked on each by itself. Whole texts are read; a long one is
    worked on alone, in memory of a few hundred bytes for each of its words. Columns of the names to be added are
    replaced; others, whatever their names, stay. An empty table stays empty.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    made = {words: "long", runs: "array<struct<start:long,length:long,period:long>>", collapsed: "string"}
    kept = [f for f in df.schema if f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            n, found, rest = _of_batch(batch.column("__text"))
            columns = [batch.column(f.name) for f in kept]
            found = [[{"start": s, "length": l, "period": p} for s, l, p in rows] for rows in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(found, run_type), pa.array(rest, pa.string())], names=[f.name for f in kept] + list(made))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{k}` {v}" for k, v in made.items()])
    return df.select(*(f"`{f.name}`" for f in kept), F.col(text).alias("__text")).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each document whose crc32(doc_id) ends in 0 the words from the g-th on repeat. A null id changes nothing."""
    word = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, word)).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return some.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(with_planted_runs(documents(spark, sf_dir)))
    higher = "(x, y) -> case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1 when x.start <> y.start then cast(sign(x.start - y.start) as int) else cast(sign(x.period - y.period) as int) end"
    best = found.withColumn("best", F.expr(f"get(array_sort(runs, {higher}), 0)"))
    return best.selectExpr(
        "doc_id", "cast(size(runs) as long) as n_runs", "best.start as start", "best.length as length", "best.period as period",
        "1000 * best.length div best.period as exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) as runs_sha256",
        "sha2(collapsed, 256) as collapsed_sha256",
    )
