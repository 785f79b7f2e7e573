"""Ordered folds over events, against plain Python, with an id that has most of them."""

import math
import random

from pyspark.sql import functions as F

from millrace.operators import state


def test_feedback_equals_a_plain_fold(spark):
    rng = random.Random(4)
    start = {"a": 5, "b": 40, "c": -3, "d": 7}
    events = [(rng.choice("aaaabc"), rng.randrange(500), n, rng.choice([0.0, 2.0, 7.0, 10.0, 12.5])) for n in range(3000)] + [("a", 3, 9999, None)]
    rows = spark.createDataFrame(list(start.items()), "id string, importance int")
    df = spark.createDataFrame(events, "id string, ts int, event_id long, reward double").repartition(7)
    want = {}
    for key, _, _, reward in sorted((e for e in events if e[3] is not None), key=lambda e: (e[1], e[2])):
        old, n = want.get(key, (start[key], 0))
        want[key] = (min(10, max(1, math.floor(old + 0.5 * (reward - old) + 0.5))), n + 1)
    assert {r.id: (r.importance, r.feedback_count) for r in state.feedback_update(rows, df).collect()} == want
    assert state.feedback_update(rows, df.limit(0)).count() == 0


def test_decay_equals_a_plain_fold(spark):
    rng = random.Random(5)
    start = {"a": 10, "b": 900, "c": 2, "d": 30}
    events = [(rng.choice("aaaabbc"), rng.randrange(500), n, "retrieval" if rng.random() < 0.93 else "feedback") for n in range(4000)] + [("d", k, 5000 + k, "feedback") for k in range(3)]
    rows = spark.createDataFrame(list(start.items()), "id string, importance int")
    df = spark.createDataFrame(events, "id string, ts int, event_id long, kind string").repartition(7)
    want = {}
    for key, _, _, kind in sorted(events, key=lambda e: (e[1], e[2])):
        imp, got, fed = want.get(key, (start[key], 0, 0))
        if kind == "retrieval":
            got += 1
            idle = got - 10 * fed
            if imp > 3 and idle > 0 and idle % 10 == 0:
                imp = max(1, math.floor(imp + 0.1 * (3 - imp) + 0.5))
        else:
            fed += 1
        want[key] = (imp, got, fed)
    assert {r.id: (r.importance, r.retrieval_count, r.feedback_count) for r in state.retrieval_decay(rows, df).collect()} == want
    assert any(imp != start[k] for k, (imp, _, _) in want.items()) and state.retrieval_decay(rows, df.limit(0)).count() == 0


def test_an_id_with_a_million_events(spark):
    events = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 11).cast("double").alias("reward"), F.when(F.col("id") % 50 == 49, "feedback").otherwise("retrieval").alias("kind"))
    rows = spark.createDataFrame([("hot", 9)], "id string, importance int")
    imp = 9
    for n in range(1_000_000 - 110, 1_000_000):  # what came before is forgotten: each step halves a difference
        imp = min(10, max(1, math.floor(imp + 0.5 * (n % 11 - imp) + 0.5)))
    assert [tuple(r) for r in state.feedback_update(rows, events).collect()] == [("hot", imp, 1_000_000)]
    parts = state._in_ranges(events, "reward").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 700_000
    got = state.retrieval_decay(rows, events).collect()
    assert [tuple(r)[2:] for r in got] == [(980_000, 20_000)] and got[0].importance == 8
