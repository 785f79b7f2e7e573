"""Routing compares sets of words, each once; the results are those of all pairs."""

import random
import time

from millrace.operators import ranking


def _plain(prompts, memories, threshold):
    out = {}
    for pid, text in prompts:
        v = set((text or "").split())
        found = [(-len(v & set(t.split())) / len(v | set(t.split())), i) for i, t in memories if t and v]
        best = min(found, default=(0, None))
        out[pid] = best[1] if -best[0] >= threshold else None
    return out


def test_routing_equals_all_pairs(spark):
    r = random.Random(9)
    base = [[f"w{r.randrange(80)}" for _ in range(r.choice([1, 3, 8, 20, 60]))] for _ in range(12)]
    text = lambda: " ".join(w for w in r.choice(base) if r.random() > 0.06)
    prompts = [(i, text()) for i in range(120)] + [(900, None), (901, "")]
    memories = [(f"m{i}", text()) for i in range(120)] + [("m900", None), ("m901", "")]
    got = ranking.route_prompts(spark.createDataFrame(prompts, "prompt_id int, prompt string"), spark.createDataFrame(memories, "id string, content string"), 0.85, 20)
    want = _plain(prompts, memories, 0.85)
    rows = got.collect()
    assert {x.prompt_id: x.target for x in rows} == want and len(rows) == len(prompts)
    assert len({t for t in want.values() if t}) > 10


def test_copies_are_not_compared_pair_by_pair(spark):
    """Of 8000 equal prompts and 8000 equal memories all pairs were compared."""
    began = time.monotonic()
    words = " ".join(f"w{i}" for i in range(40))
    prompts = spark.range(8000).selectExpr("id as prompt_id", f"'{words}' as prompt")
    memories = spark.range(8000).selectExpr("concat('m', id + 1000) as id", f"'{words} ' as content")
    got = ranking.route_prompts(prompts, memories)
    assert {r.target for r in got.collect()} == {"m1000"} and time.monotonic() - began < 60
