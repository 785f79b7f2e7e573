"""Scores, hybrid ranking and text search."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import stored

# Weights of vector, keyword, recency, importance and churn for each store.
WEIGHTS = {
    "memory": {"vector": 0.6, "keyword": 0.2, "recency": 0.05, "importance": 0.15, "churn": 0.0},
    "skill": {"vector": 0.7, "keyword": 0.3, "recency": 0.0, "importance": 0.0, "churn": 0.0},
    "context": {"vector": 0.6, "keyword": 0.3, "recency": 0.05, "importance": 0.0, "churn": 0.05},
}


def query_tokens(query: str) -> list[str]:
    """Lower-case ASCII letters and digits, each token once, in order."""
    return list(dict.fromkeys(x for x in re.split(r"[^a-z0-9]+", query.lower()) if x))


def distinct_tokens(column: str) -> Column:
    """query_tokens as an expression."""
    return F.array_distinct(F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda x: x != ""))


def effective_weights(store: str, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Positive overrides replace defaults; the sum is one."""
    w = WEIGHTS[store] | {k: v for k, v in (overrides or {}).items() if v > 0}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else w


def keyword_score(fields: Sequence[str], tokens: Sequence[str], boosts: dict[str, float] | None = None) -> Column:
    """Mean over tokens of the best boost of a field that contains the token; a boost of zero or less is one."""
    if not tokens:
        return F.lit(0.0)
    boost = {f: (boosts or {}).get(f, 1.0) for f in fields}
    boost = {f: b if b > 0 else 1.0 for f, b in boost.items()}
    total = F.lit(0.0)
    for t in tokens:
        hits = [F.when(F.lower(f).contains(t), F.lit(boost[f])).otherwise(0.0) for f in fields]
        total = total + (F.greatest(*hits) if len(hits) > 1 else hits[0])
    return total / F.lit(float(len(tokens)))


def recency_score(ts: str, as_of: Column, days: float = 30.0, decay: float = 0.5) -> Column:
    """decay to the power of age over scale; no time gives 0, the future 1."""
    decay = decay if 0 < decay < 1 else 0.5
    age = F.greatest(F.unix_micros(as_of) - F.unix_micros(F.col(ts)), F.lit(0)) / F.lit(1e6)
    return F.coalesce(F.pow(F.lit(decay), age / F.lit(days * 86400.0)), F.lit(0.0))


def importance_score(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column) / F.lit(10.0)).otherwise(0.0)


def hybrid_keyword_score(keyword: Column, recency: Column, importance: Column, churn: Column, w: dict[str, float]) -> Column:
    return keyword * w["keyword"] + recency * w["recency"] + importance * w["importance"] + churn * w["churn"]


def hybrid_rerank(base: Column, recency: Column, importance: Column, churn: Column, w: dict[str, float]) -> Column:
    """base is in 0 to 1."""
    return base * (w["vector"] + w["keyword"]) + recency * w["recency"] + importance * w["importance"] + churn * w["churn"]


def candidate_limit(df: DataFrame, k: int, path: str = "text", newest: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(newest), key).limit(max(5 * k, 25) if path == "text" else max(2 * k, 20))


def highlight(field: str, tokens: Sequence[str]) -> Column:
    """The first hit of the first token that occurs, between mark tags."""
    out = F.col(field)
    for t in reversed(list(tokens)):
        at = F.expr(f"instr(lower({field}), '{t}')")
        out = F.when(at > 0, F.concat(F.substr(field, F.lit(1), at - 1), F.lit("<mark>"), F.substr(F.col(field), at, F.lit(len(t))), F.lit("</mark>"), F.substr(F.col(field), at + len(t)))).otherwise(out)
    return out


def text_search(df: DataFrame, query: str, store: str, fields: Sequence[str], as_of: Column, k: int = 10, project: str = "", boosts: dict[str, float] | None = None) -> DataFrame:
    """Search without vectors: newest rows that contain the whole query, scored by keywords, recency and importance."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(f).contains(query.lower())
    rows = df.filter(hit)
    rows = rows.filter(F.col("project") == project) if project else rows
    rows = candidate_limit(rows, k)
    w = effective_weights(store)
    score = hybrid_keyword_score(keyword_score(fields, query_tokens(query), boosts), recency_score("created_at", as_of), importance_score("importance"), F.lit(0.0), w)
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(k)


def _shortened(words: Column, times: int) -> Column:
    """The words, and all that is left of them when up to so many letters are taken out."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    for _ in range(times):
        words = F.array_distinct(F.concat(words, F.flatten(F.transform(words, less))))
    return words


def near_words(vocabulary: DataFrame, tokens: Sequence[str], fuzziness: int, word: str = "word") -> DataFrame:
    """(token, word) of the words of a table within an edit distance of some tokens.

    Two texts within n edits have a text in common that up to n deletions lead to. So words and tokens are joined by
    these, and the distance is worked out for the pairs that meet.
    """
    spark = vocabulary.sparkSession
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string").select("token", F.explode(_shortened(F.array("token"), fuzziness)).alias("left"))
    shortened = vocabulary.filter(f"{word} is not null").select(word).distinct().select(word, F.explode(_shortened(F.array(word), fuzziness)).alias("left"))
    met = shortened.join(F.broadcast(wanted), "left").select("token", word).distinct()  # as many rows as the tokens' letters allow
    return met.filter(F.levenshtein("token", word) <= fuzziness)


def fuzzy_terms(df: DataFrame, field: str, tokens: Sequence[str], fuzziness: int = 1, phrase: str = "", boost: float = 1.0) -> DataFrame:
    """Share of tokens with a word within the edit distance, and a bonus for the exact phrase.

    The near words of a token are sought in the vocabulary once. They reach the driver: within one edit of a token of n
    letters there are no more than 73 n + 37 of the words of letters a to z and digits, within two about the square.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(field), "[^a-z0-9]+"), lambda x: x != ""))
    near: dict[str, list[str]] = {}
    for r in near_words(df.select(F.explode(words).alias("word")), tokens, fuzziness).collect():
        near.setdefault(r["token"], []).append(r["word"])
    rows = df.withColumn("__words", words)
    hits = F.lit(0.0)
    for t in tokens:
        if near.get(t):
            hits = hits + F.when(F.arrays_overlap("__words", F.array(*map(F.lit, sorted(near[t])))), 1.0).otherwise(0.0)
    bonus = F.when(F.lower(field).contains(phrase.lower()), F.lit(boost)).otherwise(0.0) if phrase else F.lit(0.0)
    return rows.withColumn("score", F.round(hits / max(1, len(tokens)) + bonus, 6)).drop("__words")


def hybrid_search(
    df: DataFrame, query: str, query_vec: Sequence[float], store: str, fields: Sequence[str], as_of: Column, k: int = 10, project: str = "", overrides: dict[str, float] | None = None, min_score: float = 0.0
) -> DataFrame:
    """Vector and keyword scores blended, then recency, importance and churn; rows have a vector column vec.

    The blend is ratio * (1 + cosine) / 2 + (1 - ratio) * keyword, the ratio being vector's share of both weights.
    """
    from millrace.operators.similarity import cosine

    w = effective_weights(store, overrides)
    rows = df.filter(F.col("project") == project) if project else df
    both = w["vector"] + w["keyword"]
    ratio = w["vector"] / both if both else 0.0
    rows = rows.withColumn("__q", F.array(*[F.lit(float(x)) for x in query_vec]))
    base = ratio * (1 + cosine("vec", "__q")) / 2 + (1 - ratio) * keyword_score(fields, query_tokens(query))
    churn = F.coalesce(F.col("churn"), F.lit(0.0)) if "churn" in df.columns else F.lit(0.0)
    importance = importance_score("importance") if "importance" in df.columns else F.lit(0.0)
    recency = recency_score("created_at", as_of) if "created_at" in df.columns else F.lit(0.0)
    rows = rows.withColumn("score", F.round(hybrid_rerank(base, recency, importance, churn, w), 6)).drop("__q")
    rows = rows.filter(F.col("score") >= min_score) if min_score > 0 else rows
    return rows.orderBy(F.desc("score"), "id").limit(k)


_MIX = np.int64(-7046029254386353131)


def _prefixes(sets: DataFrame, common: list[int], threshold: float, levels: Sequence[int], least: int) -> DataFrame:
    """(num, token, meta) of the first words of sets in a fixed order, the common ones last.

    ``token`` is a hash of the word and of a level of sizes: the set's own one, shifted by each of ``levels``. ``meta``
    holds the set's size, the word's place, and whether a larger set with enough in common must share ``least`` words of this
    part alone; only such words go to the level above, where sets are larger.
    """
    order = np.array(common, np.int64)
    by = np.argsort(order, kind="stable")
    width = max(-math.log(threshold), 1e-6) * (1 + 1e-9)  # sizes that fit lie on the same level or the next

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("tokens")
                size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                place = np.minimum(np.searchsorted(order, tokens, sorter=by), max(0, len(order) - 1))
                rank = np.where(order[by[place]] == tokens, len(order) - by[place], 0) if len(order) else np.zeros(len(tokens), np.int64)
                sorted_ = np.lexsort((tokens, rank, row))
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                n = size[row]
                keep = pos < n - np.ceil(n * threshold - 1e-9) + least
                short = pos < n - np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9) + least
                num = batch.column("num").to_numpy(zero_copy_only=False)
                level = np.floor(np.log(n) / width).astype(np.int64)
                for shift in levels:
                    use = keep & short if shift > 0 else keep
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (num[row[use]], tokens[sorted_][use] ^ (level[use] + shift) * _MIX, n[use] << 32 | pos[use] << 1 | short[use])], names=["num", "token", "meta"])

    return sets.select("num", F.transform("w", lambda w: F.xxhash64(w)).alias("tokens")).mapInArrow(run, "num long, token long, meta long")


def _nearest(threshold: float, kind: str):
    """Of sorted rows (token, i, j, num, id, w), each prompt's nearest memory among the rows of the same (token, i, j): a memory has an id, a prompt none."""

    def best(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, lists = rows.column("id").combine_chunks(), rows.column("w").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words, mark = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.uint8)
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        memory = ids.is_valid().to_numpy(zero_copy_only=False)
        rank = np.empty(len(ids), np.int64)
        rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out: list[tuple[int, int, float]] = []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            here = np.arange(a, b)
            mine, theirs = here[~memory[a:b]], here[memory[a:b]]
            if not len(mine) or not len(theirs):
                continue
            other = np.concatenate([words[end[k] - size[k] : end[k]] for k in theirs])
            at = np.cumsum(size[theirs]) - size[theirs]
            for k in mine:
                own = words[end[k] - size[k] : end[k]]
                mark[own] = 1
                both = np.add.reduceat(mark[other], at, dtype=np.int64)
                mark[own] = 0
                score = both / (size[k] + size[theirs] - both)
                top = score.max()
                if top >= threshold:
                    ties = theirs[score == top]
                    out.append((k, ties[np.argmin(rank[ties])], top))
        mine, theirs, score = (np.array([x[c] for x in out], t) for c, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.RecordBatch.from_arrays([rows.column("num").combine_chunks().take(pa.array(mine)), ids.take(pa.array(theirs)), pa.array(score)], names=["num", "target", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            group = np.stack([rows.column(c).to_numpy() for c in ("token", "i", "j")])
            starts = np.concatenate([[0], 1 + np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0))])
            if len(starts) > 1:
                yield best(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None:
            yield best(held, np.zeros(1, np.int64))

    return run, f"num long, target {kind}, score double"


def route_prompts(prompts: DataFrame, memories: DataFrame, threshold: float = 0.85, common: int = 1 << 17, least: int = 3, words: int = 1 << 18) -> DataFrame:
    """(prompt_id, op, target, importance): update a memory with nearly the same words, else create by what is said.

    Equal sets of words are one, and a prompt with a memory of its own set is decided by that. Other candidates share
    ``least`` (all, if fewer) of the first |set| - ceil(threshold * |set|) + least words in a fixed order, here the ``common``
    most frequent ones last; of the smaller set even of the first |set| - ceil(2 threshold / (1 + threshold) |set|) + least.
    Sizes and places of a shared word must allow enough words in common; then the whole sets decide.

    Candidates travel as numbers. A pair is compared where its smallest shared word is, and there each set comes once for all
    its pairs, in blocks of about so many ``words`` a side. So the sets that travel grow with the texts, not with the pairs.
    """
    from millrace.operators.similarity import word_set

    identity = lambda w: F.unhex(F.sha2(F.array_join(F.array_sort(w), "\n"), 256))
    kind = memories.schema["id"].dataType.simpleString()
    texts = memories.select("id", word_set("content").alias("w")).unionByName(prompts.select(F.lit(None).cast(kind).alias("id"), word_set("prompt").alias("w")))
    whole = texts.filter(F.size("w") > 0).withColumn("key", identity("w")).groupBy("key").agg(F.min("id").alias("id"), F.first("w").alias("w"))
    sets = stored(whole.select(F.monotonically_increasing_id().alias("num"), "key", "id", F.size("w").alias("size"), "w"))
    ms, ps = sets.filter("id is not null"), sets.filter("id is null")

    frequent = ms.select(F.explode("w").alias("word")).groupBy(F.xxhash64("word").alias("token")).count().orderBy(F.desc("count"), "token").limit(common)
    ranks = [r["token"] for r in frequent.collect()]
    x, y = _prefixes(ps, ranks, threshold, (-1, 0, 1), least).alias("x"), _prefixes(ms, ranks, threshold, (0,), least).alias("y")
    n, k, n_at, k_at = (f(F.col(c)) for f in (lambda c: F.shiftright(c, 32), lambda c: F.shiftright(c, 1).bitwiseAND(0x7FFFFFFF)) for c in ("x.meta", "y.meta"))
    smaller = F.when(n <= k, F.col("x.meta")).otherwise(F.col("y.meta")).bitwiseAND(1) == 1
    shared = F.ceil((n + k) * (threshold / (1 + threshold)) - 1e-6)
    fits = (n * threshold <= k + 1e-6) & (k * threshold <= n + 1e-6) & smaller & (least + F.least(n - 1 - n_at, k - 1 - k_at) >= shared)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).groupBy(F.col("x.num").alias("a"), F.col("y.num").alias("b")).agg(F.min("x.token").alias("token"), F.sum(F.when(shared < least, least).otherwise(1)).alias("times")).filter(F.col("times") >= least)

    sides = stored(pairs.select("token", F.explode(F.array("a", "b")).alias("num")).distinct().join(sets.select("num", "size", F.col("id").isNull().alias("asks")), "num"))
    blocks = lambda asks: F.greatest(F.ceil(F.sum(F.when(F.col("asks") == asks, F.col("size"))) / words), F.lit(1)).cast("int")
    dealt = sides.join(sides.groupBy("token").agg(blocks(True).alias("n"), blocks(False).alias("k")), "token")
    own, all_ = (lambda c: F.array(F.pmod(F.xxhash64("num"), F.col(c)).cast("int"))), (lambda c: F.sequence(F.lit(0), F.col(c) - 1))
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("asks"), own("n")).otherwise(all_("n")))).withColumn("j", F.explode(F.when(F.col("asks"), all_("k")).otherwise(own("k"))))
    met = dealt.select("token", "num", "i", "j").join(sets.select("num", "id", "w"), "num").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    near = met.mapInArrow(*_nearest(threshold, kind)).groupBy("num").agg(F.min_by("target", F.struct(-F.col("score"), F.col("target"))).alias("target"))
    best = sets.select("num", "key", "id").join(near, "num", "left").select("key", F.coalesce("id", "target").alias("target")).filter("target is not null")
    low = F.lower("prompt")
    asked = prompts.select("prompt_id", low.contains("remember").alias("remember"), low.contains("skill").alias("skill"), identity(word_set("prompt")).alias("key"))
    remember, skill = F.col("remember"), F.col("skill")
    op = F.when(F.col("target").isNotNull(), "update_memory").when(remember, "create_memory").when(skill, "create_skill").otherwise("create_memory")
    importance = F.when(F.col("target").isNull() & remember, 5).when(F.col("target").isNull() & ~skill, 4)
    return asked.join(best, "key", "left").select("prompt_id", op.alias("op"), "target", importance.alias("importance"))
