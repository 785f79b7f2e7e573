"""Memory that doesn't grow with a batch, and steps that don't grow with the square of a group."""

import random
import tracemalloc

from millrace.operators import sessions, similarity


def _plain_print(text):
    words = (text or "").split()
    hashes = []
    for gram in [f"{a} {b}" for a, b in zip(words, words[1:])] or words:
        h = 14695981039346656037
        for b in gram.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        hashes.append(h)
    value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    return value - 2**64 if value >= 2**63 else value


def test_fingerprints_hold_a_few_texts_at_a_time():
    r = random.Random(5)
    texts = [None, "", "one", "two words", "x" * 300 + " ü"] + [" ".join(r.choice(["ab", "über", "c", "much-longer-words"]) for _ in range(r.randrange(60))) for _ in range(100)]
    wanted = [_plain_print(t) for t in texts]
    assert similarity.fingerprints(texts).tolist() == wanted == similarity.fingerprints(texts, 50).tolist()
    peaks = []
    for n in (500, 2000):
        many = [" ".join(str(r.randrange(50_000)) for _ in range(200)) for _ in range(n)]
        tracemalloc.start()
        similarity.fingerprints(many, 1 << 16)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_without_near_duplicates_a_page_is_compared_with_none(monkeypatch):
    """It was compared with every page that its session held."""
    asked = []
    monkeypatch.setattr(sessions.OpenPages, "_alike", lambda self, a, b: bool(asked.append(1)))
    pages = sessions.OpenPages((), 0, 10**9, 10**15, -1)
    events = [pages.add(k, f"u{k % 50}", 0, 10)[0] for k in range(200)]
    assert not asked and [e[2] for e in events] == ["added"] * 50 + ["updated"] * 150 and events[-1][3] == 4


def test_cases_judged_by_label_make_no_list_of_expected_rows(spark):
    """Rows with one label were joined with all cases of it; the metrics are the same."""
    from millrace.operators import evaluation

    labels = spark.createDataFrame([(k, None if k == 9 else f"l{k % 3}" if k < 30 else f"own{k}") for k in range(32)], "id long, label string")
    found = spark.createDataFrame([(c, (c + 7 * r) % 32, r) for c in (0, 9, 15, 30) for r in range(1, 8)], "case_id long, id long, rank int")
    cases = labels.filter("id in (0, 9, 15, 30)")
    expected = cases.withColumnRenamed("id", "case_id").join(labels, "label").filter("id <> case_id").select("case_id", "id")
    wanted = evaluation.wanted_by_label(cases, labels)
    got = evaluation.judged_metrics(evaluation.judged_by_label(found, labels), wanted, 5)
    assert sorted(got.collect()) == sorted(evaluation.metrics(found, expected, 5).collect()) and {r.case_id: r.wanted for r in wanted.collect()} == {0: 8, 15: 8}


def test_a_block_of_queries_is_scored_in_steps(spark):
    """All ties and non-finite vectors come out as in one step."""
    rows = spark.createDataFrame([(k, [float(k % 4), float(k % 3), 1.0] if k % 11 else [float("nan"), 0.0, 0.0]) for k in range(60)], "id long, vec array<float>")
    one, few = (sorted(tuple(r)[:2] + (round(r.score, 9), r.rank) for r in similarity.knn_cosine(rows, rows, 5, step=s).collect()) for s in (1000, 7))
    assert one == few and len(few) == 5 * 54
    one, few = (sorted((r.a, r.b) for r in similarity.pairs_cosine_ge(rows, 0.9, step=s).collect()) for s in (1000, 7))
    assert one == few and few
