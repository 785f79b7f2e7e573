"""Near prompts and memories meet in blocks: what is shuffled grows with the sets, not with the pairs."""

import random

import pytest

from millrace.operators import ranking


def _shuffled(spark) -> int:
    """Bytes that all stages so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    default = lambda k: getattr(store, f"stageList$default${k}")()
    stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, default(2), default(3), default(4), default(5)))
    return sum(s.shuffleWriteBytes() for s in stages)


def _family(n: int, words: int, seed: int) -> list[list[str]]:
    """Variants of one text, each with a few words of its own."""
    r = random.Random(seed)
    base = [f"word{r.randrange(10**9)}" for _ in range(words)]
    return [[w if r.random() > 0.04 else f"own{r.randrange(10**9)}" for w in base] for _ in range(n)]


def _nearest(prompts, memories, threshold):
    out = {}
    for p, v in prompts:
        found = [(-len(set(v) & set(w)) / len(set(v) | set(w)), m) for m, w in memories]
        out[p] = min(found)[1] if -min(found)[0] >= threshold else None
    return out


def _got(spark, prompts, memories, *args, **named):
    rows = lambda sets: [(k, " ".join(w)) for k, w in sets]
    frames = spark.createDataFrame(rows(prompts), "prompt_id int, prompt string"), spark.createDataFrame(rows(memories), "id string, content string")
    return {r.prompt_id: r.target for r in ranking.route_prompts(*frames, *args, **named).collect()}


def test_sets_do_not_travel_once_a_pair(spark):
    """For 60 prompts near 60 memories all 3600 pairs of sets went through a shuffle, 171 MB; now 22 MB do."""
    texts = _family(120, 3000, 3)
    prompts, memories = list(enumerate(texts[:60])), [(f"m{k}", w) for k, w in enumerate(texts[60:])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large to broadcast
    try:
        before = _shuffled(spark)
        got = _got(spark, prompts, memories)
        shuffled = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled < 50_000_000, shuffled
    assert got == _nearest(prompts, memories, 0.85) and sum(t is not None for t in got.values()) > 40


@pytest.mark.parametrize("words, batch", [(60, 3), (1 << 18, 10000)])
def test_blocks_and_batches_lose_no_pair(spark, words, batch):
    r = random.Random(5)
    texts = [t for seed, size in enumerate((2, 6, 7, 12, 13, 30, 70)) for t in _family(14, size, seed)]
    r.shuffle(texts)
    prompts, memories = list(enumerate(texts[:50])), [(f"m{k}", w) for k, w in enumerate(texts[50:])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for threshold in (0.85, 0.6):
            got = _got(spark, prompts, memories, threshold, 20, words=words)
            assert got == _nearest(prompts, memories, threshold) and sum(t is not None for t in got.values()) > 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
