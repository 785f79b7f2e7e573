"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most the capacity; full pieces are sequences by themselves. The others are dealt
into groups of bounded size. Several islands evolve packings of each group: a crossover injects whole well-filled
bins of one packing into another, bins that hold a document twice dissolve, and the displaced documents go where they
fit best. After each round every island sends its best packing to the next one. Poorly filled bins of all groups are
opened once more, and their pieces are packed again together.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, mixed, slices, stored, text_bytes, word_spans


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _plain(chunk: str) -> bool:
    """Letters that composing and lower-casing don't change in number."""
    return chunk.isalpha() and (chunk.isascii() or "\u0130" not in chunk and unicodedata.is_normalized("NFC", chunk))


class WordEncoder:
    """Ids of many texts at once; what stands between white space is encoded once while its ids are remembered.

    The tokenizer never joins across white space, so the chunks between ASCII white space are encoded apart, many new
    ones as one text: letters alone are one word and letters with a full stop or comma two, whose last ids are those
    that end a word; between other chunks stands a special token, at which the ids are cut again. Ids stand one after
    another in ``ids``. A chunk of at most 16 bytes is found by its bytes, as two 64-bit words, in one of two places of a table
    that its hash names; a new chunk takes the second place from another. Longer chunks are found in a dictionary.
    Places, ids and the dictionary's bytes are bounded; beyond that all are forgotten.
    """

    def __init__(self, path: str, places: int = 1 << 20, most_ids: int = 1 << 23, most_bytes: int = 1 << 24):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        self.cut, self.cut_id = next(iter(added.items()), (None, None))
        self.mark = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.places, self.most_ids, self.most_bytes = places, most_ids, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.low, self.high = np.zeros(self.places, np.uint64), np.zeros(self.places, np.uint64)
        self.at, self.many = np.zeros(self.places, np.int32), np.full(self.places, -1, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where the ids now stand."""
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk stand, and how many they are."""
        texts = [c.decode() for c in chunks]
        words, marked, alone = [], [], []
        for k, c in enumerate(texts):
            if _plain(c):
                words.append((k, 1))
            elif c[-1] in ".," and _plain(c[:-1]):
                words.append((k, 2))
            elif self.cut is None or self.mark(c):
                alone.append(k)
            else:
                marked.append(k)
        at, many = np.zeros(len(chunks), np.int32), np.zeros(len(chunks), np.int32)

        def keep(ks: list[int], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
            at[ks], many[ks] = self._keep(ids) + starts, ends - starts

        parts = [words[k : k + 512] for k in range(0, len(words), 512)]
        for part, ids in zip(parts, self._ids([" ".join([texts[k] for k, _ in part]) for part in parts])):
            ks, n = map(list, zip(*part))
            stops, last = np.flatnonzero(self.ends_word[ids]) + 1, np.cumsum(n)
            if len(stops) == last[-1] and stops[-1] == len(ids):
                keep(ks, ids, np.concatenate([[0], stops[last[:-1] - 1]]), stops[last - 1])
            else:  # some chunk isn't split as expected
                marked += ks
        parts = [marked[k : k + 512] for k in range(0, len(marked), 512)]
        for part, ids in zip(parts, self._ids([(self.cut or "").join([texts[k] for k in part]) for part in parts])):
            stops = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
            keep(part, ids, np.concatenate([[0], stops[:-1] + 1]), stops)
        for k, ids in zip(alone, self._ids([texts[k] for k in alone])):
            keep([k], ids, np.array([0]), np.array([len(ids)]))
        return at, many

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's with the end id if there is one, and where each text begins (one more at the end)."""
        if self.used > self.most_ids or self.long_bytes > self.most_bytes:
            self._forget()
        data, offsets = text_bytes(column)
        start, end, doc = word_spans(data, offsets, ~_SPACE)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        windows = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        size = end - start
        low = windows[start] & _MASKS[np.minimum(size, 8)]
        high = windows[np.minimum(start + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 8)]
        hashed = mixed(low ^ (high * np.uint64(0x9FB21C651E98DF25)) ^ size.astype(np.uint64))
        one, two = (hashed & np.uint64(self.places - 1)).astype(np.int64), ((hashed >> np.uint64(32)) & np.uint64(self.places - 1)).astype(np.int64)
        place = np.where((self.low[one] == low) & (self.high[one] == high) & (self.many[one] >= 0), one, two)
        at, many = self.at[place], self.many[place]
        short = size <= 16
        new = np.flatnonzero(short & ((self.low[place] != low) | (self.high[place] != high) | (many < 0)))
        if len(new):
            self._learn(new, data, start, end, low, high, one, two, at, many)
        raw = data.tobytes() if not short.all() else b""
        other = [(k, raw[start[k] : end[k]]) for k in np.flatnonzero(~short)]
        missing = list({c for _, c in other if c not in self.long})
        if missing:
            self.long.update(zip(missing, zip(*(x.tolist() for x in self._encoded(missing)))))
            self.long_bytes += sum(len(c) + 100 for c in missing)
        for k, c in other:
            at[k], many[k] = self.long[c]
        count = np.bincount(doc, minlength=len(column))
        if end_id is not None:
            last = np.cumsum(count)
            at, many = np.insert(at, last, self._keep(np.array([end_id], "<u4"))), np.insert(many, last, 1)
            count = count + 1
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        take = np.arange(ends[-1]) + np.repeat(at - ends[:-1], many)
        return self.ids[take], ends[np.concatenate([[0], np.cumsum(count)])]

    def _learn(self, new, data, start, end, low, high, one, two, at, many) -> None:
        """Encodes the different chunks among those at ``new`` and gives them places; fills in where their ids stand."""
        _, first, which = np.unique(np.stack([low[new], high[new]], axis=1).view("u8,u8").ravel(), return_index=True, return_inverse=True)
        chosen = new[first]
        raw = data.tobytes()
        ids_at, ids_many = self._encoded([raw[a:b] for a, b in zip(start[chosen].tolist(), end[chosen].tolist())])
        at[new], many[new] = ids_at[which.ravel()], ids_many[which.ravel()]
        place = np.where(self.many[one[chosen]] < 0, one[chosen], two[chosen])
        for column, values in ((self.low, low[chosen]), (self.high, high[chosen]), (self.at, ids_at), (self.many, ids_many)):
            column[place] = values  # of chunks with the same place the last stays, in all four alike


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _within(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array, bool]]:
    """(ids, texts, whether the text goes on) in parts of at most ``most`` characters a text, cut before white space."""
    for part in slices(batches, limit=most):
        text = part.column("text")
        if part.num_rows > 1 or (pc.binary_length(text)[0].as_py() or 0) <= 4 * most:
            yield part.column("doc_id"), text, False
            continue
        left = text[0].as_py()
        while len(left) > most:
            k = next((m.start() for m in _GAP.finditer(left, most)), len(left))
            if k == len(left):
                break
            yield part.column("doc_id"), pa.array([left[:k]], text.type), True
            left = left[k:]
        yield part.column("doc_id"), pa.array([left], text.type), False


_GAP = re.compile(r"[ \t-\r]")


def pieces(df: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of (doc_id, text): its ids and the end id, cut to the capacity.

    Null and empty texts give one piece, the end id; very long texts are encoded part by part; repeated rows give
    repeated pieces; other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        before = b""
        for doc_ids, texts, more in _within(batches, 1 << 20):
            ids, ends = enc.encode(texts, None if more else end_id)
            if more:
                before += ids.tobytes()
                continue
            raw = memoryview(before + ids.tobytes())
            ends = 4 * ends
            if before:  # a text that came in parts is alone
                ends[-1] += len(before)
                before = b""
            size = np.diff(ends)
            many = -(-size // step)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = ends[row] + piece * step
            to = np.minimum(at + step, ends[row + 1])
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), to.tolist())]
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array((to - at) // 4, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, as tuples that packings share, with their free room."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[tuple[int, ...]] = (), free: list[int] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.bins, self.free = list(bins), list(free)

    def fit(self, items: list[int]) -> None:
        """Places items, largest first, each where the least room is left over."""
        rooms: dict[int, list[int]] = {}
        open_rooms = 0  # bit r is set if a bin with free room r exists
        for b, r in enumerate(self.free):
            if r:
                rooms.setdefault(r, []).append(b)
                open_rooms |= 1 << r
        sizes, bins, free = self.sizes, self.bins, self.free
        for item in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[item]
            fits = open_rooms >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = rooms[r].pop()
                if not rooms[r]:
                    open_rooms ^= 1 << r
                bins[b] += (item,)
            else:
                r, b = self.capacity, len(bins)
                bins.append((item,))
                free.append(r)
            free[b] = left = r - size
            if left:
                rooms.setdefault(left, []).append(b)
                open_rooms |= 1 << left

    def quality(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones among them: sum of squared fills."""
        return -len(self.bins), sum([(self.capacity - f) ** 2 for f in self.free])

    def flat(self) -> list[int]:
        place = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                place[i] = b
        return place

    @classmethod
    def of(cls, sizes: list[int], capacity: int, place: list[int]) -> Packing:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(place):
            bins.setdefault(b, []).append(i)
        return cls(sizes, capacity, [tuple(b) for b in bins.values()], [capacity - sum(map(sizes.__getitem__, b)) for b in bins.values()])


def crossed(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """The mother with some of the father's fullest bins injected. Her bins that hold one of their items dissolve, and a few of her poorest."""
    ranked = np.argsort(father.free, kind="stable")
    fullest = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.choice(fullest, int(rng.integers(1, max(2, len(fullest) // 8))), replace=False).tolist()
    inside = {i for b in chosen for i in father.bins[b]}
    child = Packing(mother.sizes, mother.capacity, [father.bins[b] for b in chosen], [father.free[b] for b in chosen])
    poorest = sorted(mother.free, reverse=True)[min(2, len(mother.free) - 1)]
    displaced: list[int] = []
    for b, free in zip(mother.bins, mother.free):
        if free > poorest or not inside.isdisjoint(b):
            displaced += [i for i in b if i not in inside]
        else:
            child.bins.append(b)
            child.free.append(free)
    child.fit(displaced)
    return child


def evolved(sizes: list[int], capacity: int, seed: int, elite: list[list[int]], population: int, generations: int) -> list[int]:
    """The best packing after some generations, as bin of each item; elite packings take part from the start."""
    rng = np.random.default_rng(seed)
    alive = [Packing.of(sizes, capacity, p) for p in elite]
    if not alive:
        alive.append(Packing(sizes, capacity))
        alive[0].fit([*range(len(sizes))])
    while len(alive) < population:  # best fit in random portions
        made = Packing(sizes, capacity)
        order = rng.permutation(len(sizes)).tolist()
        portion = max(1, len(order) // int(rng.integers(2, 6)))
        for at in range(0, len(order), portion):
            made.fit(order[at : at + portion])
        alive.append(made)
    ranked = sorted([(p.quality(), k, p) for k, p in enumerate(alive)], reverse=True)
    for made in range(generations):
        if not ranked[0][2].bins or max(ranked[0][2].free) == 0:
            break  # all bins are full
        a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist())
        mother, father = (a, b) if rng.random() < 0.7 else (b, a)
        child = crossed(ranked[mother][2], ranked[father][2], rng)
        quality = child.quality()
        if quality > ranked[-1][0] and all(quality != q for q, *_ in ranked):
            ranked[-1] = (quality, population + made, child)
            ranked.sort(reverse=True)
    return ranked[0][2].flat()


def _packed(items: DataFrame, group: int, islands: int, rounds: int, population: int, generations: int, capacity: int, seed: int) -> DataFrame:
    """items: (item, length) of pieces below the capacity. Returns (item, grp, bin).

    A group's items are one row of arrays, of ``group`` on average; rows of (group, island) carry the best packing.
    """
    total = items.count()
    groups = max(1, -(-total // group))
    dealt = items.groupBy(F.expr(f"pmod(xxhash64(item, {seed}), {groups})").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("members"))
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.expr("cast(array() as array<array<int>>)"))
    schema = "grp long, island int, members array<struct<item: long, length: long>>, best array<int>, bins int"

    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    sizes = row.column("members")[0].values.field("length").to_pylist()
                    grp, island = row.column("grp")[0].as_py(), row.column("island")[0].as_py()
                    best = evolved(sizes, capacity, hash((seed, grp, island, turn)) % (1 << 32), row.column("elite")[0].as_py(), population, generations)
                    yield pa.RecordBatch.from_arrays(
                        [row.column("grp"), row.column("island"), row.column("members"), pa.array([best], pa.list_(pa.int32())), pa.array([max(best, default=-1) + 1], pa.int32())],
                        names=["grp", "island", "members", "best", "bins"],
                    )

        kept = stored(state.select("grp", "island", "members", "elite").mapInArrow(run, schema))
        if turn < rounds - 1:
            sent = kept.select("grp", F.expr(f"(island + 1) % {islands}").cast("int").alias("island"), F.col("best").alias("came"))
            state = kept.join(sent, ["grp", "island"]).withColumn("elite", F.expr("array_distinct(array(best, came))"))
    best = kept.groupBy("grp").agg(F.min_by(F.struct("members", "best"), F.struct("bins", "island")).alias("x"))
    return best.select("grp", F.posexplode(F.expr("arrays_zip(x.members, x.best)")).alias("i", "z")).select(F.col("z.members.item").alias("item"), F.col("z.members.length").alias("length"), "grp", F.col("z.best").cast("long").alias("bin"))


def pack(
    cut: DataFrame, capacity: int = 4096, group: int = 2048, islands: int = 2, rounds: int = 2, population: int = 6, generations: int = 24, well_filled: float = 0.98
) -> DataFrame:
    """Adds sequence_id and offset to rows that have a column length, from 1 to the capacity.

    Other columns pass through, but for ``item``, ``sequence_id`` and ``offset``, which are replaced. Equal lengths and
    repeated rows are packed each; no rows give no rows.
    """
    cut = stored(cut.drop("item", "sequence_id", "offset").withColumn("item", F.monotonically_increasing_id()))
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("item") * 2 + 1, "offset": F.lit(0).cast("long")})
    settings = {"group": group, "islands": islands, "rounds": rounds, "population": population, "generations": generations, "capacity": capacity}
    first = stored(_packed(cut.filter(F.col("length") < capacity).select("item", "length"), **settings, seed=1))
    fill = first.groupBy("grp", "bin").agg(F.sum("length").alias("fill"))
    poor = first.join(fill.filter(F.col("fill") < well_filled * capacity), ["grp", "bin"], "left_semi")
    again = stored(_packed(poor.select("item", "length"), **settings, seed=2))
    better = fill.filter(F.col("fill") < well_filled * capacity).count() > again.select("grp", "bin").distinct().count()
    placed = first.select("item", "length", F.lit(0).alias("level"), "grp", "bin")
    if better:
        placed = placed.join(again.select("item"), "item", "left_anti").union(again.select("item", "length", F.lit(1), "grp", "bin"))
    bins = placed.groupBy("level", "grp", "bin").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("members"))  # a bin's pieces fit its capacity
    bins = bins.withColumn("sequence_id", F.expr("((grp * 2 + level) * 4294967296L + bin) * 2"))
    at = F.expr("transform(members, (x, k) -> named_struct('item', x.item, 'offset', aggregate(slice(members, 1, k), 0L, (s, y) -> s + y.length)))")
    offsets = bins.select("sequence_id", F.explode(at).alias("x")).select(F.col("x.item").alias("item"), "sequence_id", F.col("x.offset").alias("offset"))
    rest = cut.filter(F.col("length") < capacity).join(offsets, "item")
    return full.unionByName(rest).drop("item")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty and give one piece, the end id; repeated rows are packed each."""
    return pack(pieces(documents(spark, sf_dir)))
