"""Near duplicates, vectors and classifiers against brute force and held-out labels."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import languages, near_dups, nearest, quality, vector_dups
from millrace.llm.common import documents, stored
from millrace.operators.graph import components


def components_by_hand(docs, percent):
    sets = {}
    for i, t in docs:
        x = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({65 + k: 97 + k for k in range(26)}))
        sets.setdefault(i, frozenset(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if len(x) >= 5 else frozenset([tuple(x)] if x else []))
    inverted, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for v in s:
            inverted.setdefault(v, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for v in s for j in inverted[v] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_at_the_threshold(spark):
    x = [f"w{i}" for i in range(104)]  # 100 shingles
    cases = [x, x[:87] + ["b"], [f"v{i}" for i in range(50)]]
    docs = [(i, " ".join(c)) for i, c in enumerate(cases)]
    for percent in (80, 82, 85, 87):
        want = components_by_hand(docs, percent)
        assert all(tuple(r)[1:] == want[r.doc_id] for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect())
    assert components_by_hand(docs, 82)[1][1] == 0 != components_by_hand(docs, 85)[1][1]


def test_near_duplicates_equal_brute_force(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(4000)]
    passages = [random.choices(words, k=60) for _ in range(4)]
    texts = []
    for _ in range(2):
        base = random.choices(words, k=200)
        for _ in range(120):
            x = list(base)
            for _ in range(random.randint(0, 6)):
                x[random.randrange(200)] = random.choice(words)
            texts.append(" ".join(x))
    texts += [" ".join(random.choice(passages) + random.choices(words, k=random.randint(3, 200))) for _ in range(200)]
    texts += [" ".join(random.choices(words[:3], k=random.randint(0, 7))) for _ in range(150)]
    texts += [None, "", "  ", "a", "A", "a b c d e f g"] * 3
    docs = list(enumerate(texts))
    random.shuffle(docs)
    docs += docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("sketch", F.lit(1))
    for settings in ({}, {"percent": 85}, {"percent": 85, "block": 32, "room": 3000, "short": 6}):
        want = components_by_hand(docs, settings.get("percent", 80))
        rows = near_dups.near_duplicates(df, **settings).collect()
        assert len(rows) == len(docs)
        assert all(tuple(r)[1:] == want[r.doc_id] for r in rows)
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    random.Random(1).shuffle(links)
    for few in (1 << 17, 0, 5):
        got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(7), few=few).collect()))
        assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    names = spark.createDataFrame([("b", "é"), ("é", "a"), ("z", "y")], "a string, b string")
    assert dict(map(tuple, components(names).collect())) == {"a": "a", "b": "a", "é": "a", "y": "y", "z": "y"}
    assert components(names.limit(0)).count() == 0


def vectors():
    rng, rows = np.random.default_rng(1), []
    for _ in range(15):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), (centre + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.3, 0.45])).tolist()))
    for k in range(30):
        rows.append((len(rows), rows[k % 7][1]))
    for odd in (None, [0.0] * 24, [float("nan")] * 24, [1.0, 2.0], [], [1.0] * 23 + [None], [float("inf")] * 24):
        rows.append((len(rows), odd))
    random.Random(1).shuffle(rows)
    return rows


def test_vector_duplicates_equal_brute_force(spark):
    rows = vectors()
    ok = [i for i, (_, x) in enumerate(rows) if x and len(x) == 24 and None not in x and np.isfinite(x).all() and any(x)]
    x = np.array([rows[i][1] for i in ok], np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / np.outer(norm, norm) >= 0.9 - 1e-13
    np.fill_diagonal(linked, False)
    label = np.array([rows[i][0] for i in ok])
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(ok))])
        if (new == label).all():
            break
        label = new
    want = {v: (0, v, True) for v, _ in rows}
    want |= {rows[i][0]: (int(linked[k].sum()), int(label[k]), bool(label[k] == rows[i][0])) for k, i in enumerate(ok)}
    for i, other in ((900, [1.0, 2.0]), (901, [1.0, 2.1]), (902, [-1.0, 2.0])):  # others of another length link among themselves
        rows.append((i, other))
    short = next(v for v, x in rows if x == [1.0, 2.0])
    want |= {short: (2, short, True), 900: (2, short, False), 901: (2, short, False), 902: (0, 902, True)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(2)).withColumn("label", F.lit(1))
    for chunk in (32768, 40):
        assert {r.vec_id: tuple(r)[1:] for r in vector_dups.vector_duplicates(df, chunk=chunk).collect()} == want
    assert vector_dups.vector_duplicates(df.limit(0)).count() == 0


def test_nearest_recall_and_exact_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, df.filter("vec_id % 20 = 0"), block=200, deep=40).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -9
        best = ids[np.lexsort((ids, -score))[:20]]
        found = sorted(got[ids[k]])
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(score[ids == v][0] - s) < 1e-12 for _, v, s in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    odd = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.5, 1.0]), (20, [1.0, 1.0]), (7, [2.0]), (8, [-1.0]), (9, [1.0])]
    odd = spark.createDataFrame(odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(3))
    out = nearest.nearest(odd, odd.filter("vec_id in (1, 7, 3)")).orderBy("rank").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(1, 1, 2), (1, 2, 20), (1, 3, 6), (7, 1, 9), (7, 2, 8)]
    assert nearest.nearest(odd.limit(0), odd.limit(0)).count() == 0


def test_nearest_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(5)
    base, other = rng.standard_normal(8), rng.standard_normal(8)
    rows = [base] * 500 + [other + rng.standard_normal(8) * 1e-4 for _ in range(500)] + list(rng.standard_normal((500, 8)))
    ids = np.random.default_rng(6).permutation(len(rows))
    x = np.array(rows, np.float32).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    df = df.union(df.filter(F.col("vec_id") == int(min(ids[:500]))))  # a repeated row counts twice
    every = np.append(np.arange(len(ids)), np.argmin(ids[:500]))
    got = collections.defaultdict(list)
    asked = [int(ids[k]) for k in (0, int(np.argmin(ids[:500])), 499, 500, 777, 1200)]
    for r in nearest.nearest(df, df.filter(F.col("vec_id").isin(asked)), block=2000, deep=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for name in asked:
        score = vector_dups.dots(x, np.broadcast_to(x[ids == name][0], x.shape))
        some = every[ids[every] != name]
        best = some[np.lexsort((ids[some], -score[some]))[:20]]
        assert got[name] == [(ids[k], score[k]) for k in best]


def test_language_held_out_accuracy(spark, sf):
    docs = documents(spark, sf)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = languages.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", "en"), (4, "abc", None), (4, "abc", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in languages.identify(odd).collect()} == {("und", 0.0)}
    assert languages.identify(odd.limit(0)).count() == 0
    many = spark.range(700).selectExpr("id as doc_id", "repeat(concat(char(97 + id % 26), char(97 + int(id / 26) % 26), 'q '), 3) as text", "concat('l', lpad(id, 3, '0')) as lang")
    assert languages.labelled_sample(many, 5, 100).select("lang").distinct().count() == 700  # one of each language in any case
    copies = many.limit(1).crossJoin(spark.range(3000)).select("doc_id", "text", "lang").union(spark.range(3000).selectExpr("7L", "concat('text ', id)", "'x'"))
    assert languages.labelled_sample(copies, 50, 1000).count() == 51
    twice = spark.createDataFrame([(k, "x " * 5, lang) for k in range(20) for lang in ("b", "a")], "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit(2))
    assert {r.lang_pred for r in languages.identify(twice).collect()} <= {"a", "b"}
    assert [r.lang_pred for r in languages.identify(docs.limit(50).union(spark.createDataFrame([(-1, "the word " * 40000, None, "s", 1)], docs.schema))).collect() if r.doc_id == -1] != ["und"]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.score_quality(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert [r.score for r in quality.score_quality(odd, labels.limit(0)).collect()] == [0.5] * 3
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0]), np.ones(5)).tolist() == [1.0, 7 / 3, 7 / 3, 7 / 3, 5.0]


def test_pipeline_stages(spark, sf):
    docs = documents(spark, sf)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            want = components_by_hand([(r.doc_id, r.text) for r in before.collect()], 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, x in want.items() if x[2]}
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] <= sizes[5]


def test_pipeline_of_odd_rows(spark, sf):
    docs = documents(spark, sf)
    odd = spark.createDataFrame([(None, "the story of an hour in the house", None, None, None), (-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "the word of the day was not that", "en", "s", 1), (-3, "the word of the day was not this", "en", "s", 1)], docs.schema)
    for given in (docs.unionByName(odd).unionByName(docs.limit(3)), docs.limit(0)):
        rows = given
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, sf))
            assert name == "packing" or rows.columns == docs.columns
            if name == "near_duplicates":
                kept = [r.doc_id for r in rows.collect() if r.doc_id is not None]
                assert len(kept) == len(set(kept))
        assert rows.count() > 0 or given.isEmpty()
