"""Periodic runs, exact top-k and centroid clusters against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import centroids, runs, topk


def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and all(any(w[k] != w[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", "  \n ", "a", "a a a a a", "a a a a a a", "ab ab\tab\nab ab  ab", "né ü né ü né ü né ü", "a b " * 300 + "a c " * 200 + "a b " * 3]
    for _ in range(250):
        n, letters = rng.randrange(60), "abcde"[: rng.choice([1, 2, 2, 3, 5])]
        w = [rng.choice(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 6)
            w = [w[min(n - 1, a + (i - a) % p)] if i >= a else w[i] for i in range(n)]
        out.append(rng.choice([" ", "\n", "  ", " \x0b"]).join(w) + rng.choice(["", " "]))
    return out


def test_runs_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = runs.collapse(df).collect()
    assert len(got) == len(rows)
    at = {i: t for i, t, _ in rows}
    seen = 0
    for r in got:
        w = [x for x in (at[r["doc_id"]] or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").split(" ") if x]
        expected = runs_by_hand(w)
        seen += len(expected)
        assert r["n_words"] == len(w) and [tuple(x) for x in r["runs"]] == expected
        assert r["collapsed"] == collapsed_by_hand(w, expected)
    assert seen > 100


def test_runs_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, __x int, collapsed int")
    assert runs.collapse(empty).columns == ["doc_id", "text", "__x", "n_words", "runs", "collapsed"] and runs.collapse(empty).count() == 0
    long = " ".join(random.Random(2).choice("ab") for _ in range(20_000)) + " c" * 100_000
    row = runs.collapse(spark.createDataFrame([(None, long)], "doc_id long, text string")).first()
    assert row["n_words"] == 120_000 and (20_000, 100_000, 1) in [tuple(x) for x in row["runs"]]


def test_planted_runs(spark, sf, tmp_path):
    rows = [(i, " ".join(random.Random(i).choice(["x", "y", "z", "u"]) for _ in range(i % 90))) for i in range(300)] + [(None, "a b c"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = []
    for i, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = runs_by_hand(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        expected.append((i, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(listed), sha(collapsed_by_hand(w, found))))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def vectors(rng, n=700, d=6):
    x = np.concatenate([rng.integers(-40, 40, (n - 300, d)), np.tile(rng.integers(-40, 40, (1, d)), (200, 1)), rng.integers(-1, 2, (100, d))]).astype(float)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def top_by_hand(rows, asked, k):
    out = []
    for name, q in asked:
        scores = sorted((-int(np.dot(q, v)), i) for i, v in rows if i != name and len(v) == len(q))
        out += [(name, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", [{}, {"block": 16, "shard": 4, "group": 8, "pivots": 5}])
def test_top_k_equals_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    rows = vectors(rng) + [(3000 + i, v.tolist()) for i, v in enumerate(rng.integers(-9, 9, (4, 3)).astype(float))] + [(4000, []), (4001, [])]
    rows += [rows[0]] * 15 + [rows[450]]  # repeated rows count each
    asked = [r for r in dict(rows).items() if r[0] % 20 == 0 or r[0] >= 3000]
    schema = "vec_id long, v array<double>, rank string"
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(9, None, "x"), (None, rows[0][1], "x")], schema)
    got = topk.top_k(df, spark.createDataFrame([(*r, "x") for r in asked], schema), 10, **shape).collect()
    assert sorted(map(tuple, got)) == top_by_hand(rows, asked, 10)


def test_top_k_prunes(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (40, 16))
    blocks = [(np.arange(64) + 64 * c, (centre + rng.integers(-30, 30, (64, 16))).astype(float)) for c, centre in enumerate(centres)]
    high, low = np.array([x.max(0) for _, x in blocks]), np.array([x.min(0) for _, x in blocks])
    queries = np.concatenate([x[:2] for _, x in blocks])
    names = np.concatenate([ids[:2] for ids, _ in blocks])
    best, scored = topk.search_blocks(names, queries, np.full(len(names), -np.inf), blocks, high, low, 10)
    assert scored < 0.2 * len(names) * len(blocks)
    everything = [(int(i), v) for ids, x in blocks for i, v in zip(ids, x, strict=True)]
    found = sorted((int(names[q]), int(i), int(s)) for q, i, s in zip(best.query, best.ids, best.scores, strict=True))
    assert found == sorted((a, i, s) for a, _, i, s in top_by_hand(everything, list(zip(names.tolist(), queries, strict=True)), 10))


def test_top_k_of_odd_tables(spark):
    schema = "vec_id long, v array<double>"
    empty, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [2.0])], schema)
    assert topk.top_k(empty, one).count() == 0 and topk.top_k(one, empty).count() == 0 and topk.top_k(one, one).count() == 0
    wide = spark.createDataFrame([(1, [2.0, 70_000.0]), (2, [-3.0, 5.0])], schema)
    assert [tuple(r) for r in topk.top_k(wide, wide).orderBy("query_id").collect()] == [(1, 1, 2, 349_994), (2, 1, 1, 349_994)]
    with pytest.raises(Exception, match="don't fit"):
        topk.top_k(spark.createDataFrame([(1, [1e12]), (2, [1e12])], schema), spark.createDataFrame([(1, [1e12])], schema)).collect()


def clusters_by_hand(rows, start, rounds):
    x = [[int(c) for c in v] for _, v in rows]
    centres = [[int(c) for c in v] for v in start]
    for r in range(rounds + 1):
        distance = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for v in x]
        own = [d.index(min(d)) for d in distance]
        if r < rounds:
            for c in range(len(centres)):
                mine = [v for v, o in zip(x, own, strict=True) if o == c]
                if mine:
                    centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    inertia = [sum(min(d) for d, o in zip(distance, own, strict=True) if o == c) for c in range(len(centres))]
    return sorted((i, o, min(d), inertia[o], sum(inertia), tuple(centres[o])) for (i, _), o, d in zip(rows, own, distance, strict=True))


def test_clusters_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(8))
    rows += rows[:5]
    schema = "vec_id long, v array<double>, cluster string"
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(1, None, "x"), (2, [1.0], "x")], schema).repartition(5)
    start = spark.createDataFrame([(*rows[k], "x") for k in (0, 401, 402, 3, 401)], schema).coalesce(1)  # equal centroids: one stays empty
    got = centroids.cluster(df, start, rounds=4).collect()
    assert sorted((*r[:5], tuple(r["centroid"])) for r in got) == clusters_by_hand(rows, [rows[k][1] for k in (0, 401, 402, 3, 401)], 4)


def test_clusters_of_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, cluster string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert centroids.op13_centroid_clusters(spark, f"{tmp_path}/a").count() == 0 and topk.op12_exact_top_k(spark, f"{tmp_path}/a").count() == 0
    good = [0.25] * 64
    odd = [(1, None, "x"), (2, good[:63], "x"), (3, [*good[:63], None], "x"), (4, [*good[:63], float("nan")], "x"), (5, [*good[:63], float("inf")], "x"), (6, good, "x"), (6, good, "x"), (None, [0.0] * 64, "x")]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    got = centroids.op13_centroid_clusters(spark, f"{tmp_path}/b").collect()
    assert sorted((r["vec_id"] or 0, r["distance"], r["inertia"]) for r in got) == [(0, 0, 0), (6, 0, 0), (6, 0, 0)]
