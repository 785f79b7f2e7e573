"""The exact search for near duplicates against brute force, where sketches too small miss links."""

import random

from millrace.llm.near_dups import near_duplicates
from millrace.llm.near_dups_exact import exact_near_duplicates


def by_hand(docs, percent):
    sets = {}
    for key, text in docs:
        w = (text or "").lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {key: key for key in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {key: (len(sets[key]), root(key), root(key) == key) for key in keys}


def corpus():
    rng = random.Random(9)
    out = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "One TWO"), (5, "a b c d e")]
    for _ in range(25):
        words = [rng.choice("abcdefghijkl") + str(rng.randrange(40)) for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz")
            out.append((len(out), " ".join(copy)))
    return out


def test_exact_search_finds_what_small_sketches_miss(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = lambda found: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    poor = {"k": 3, "short": 2, "cold": 1, "first": 1, "partners": 1}
    want = by_hand(docs, 80)
    assert rows(near_duplicates(df, 80, **poor)) != want
    assert rows(exact_near_duplicates(df, 80, block=7, **poor)) == want
    assert rows(exact_near_duplicates(df, 80)) == want == rows(near_duplicates(df, 80))


def test_exact_search_of_odd_rows(spark):
    schema = "doc_id long, text string, component string"
    assert exact_near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (2, None, "x"), (3, "a b c d e f g", None)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in exact_near_duplicates(spark.createDataFrame(rows, schema)).filter("doc_id is not null").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False)]
