"""The classifiers and the bootstrap against plain Python, one row at a time."""

import collections
import math
import random
import re
import zlib

import numpy as np

from millrace.llm import languages, private, quality


def spread(values):
    mean = sum(values) / max(1, len(values))
    return mean, math.sqrt(max(0, sum(v * v for v in values) / max(1, len(values)) - mean * mean))


def statistics_by_hand(text):
    raw = (text or "").encode()
    share = lambda f: sum(map(f, raw)) / max(1, len(raw))
    upper, digit, wide = lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c >= 128
    letter = lambda c: 97 <= c <= 122 or wide(c)
    mark = lambda c: 33 <= c < 127 and not chr(c).isalnum()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), re.findall(rb"[^\n\r]+", raw)
    mean, deviation = spread([len(w) for w in words])
    some = lambda rows, f: sum(map(f, rows)) / max(1, len(rows))
    shouted = some(words, lambda w: sum(map(upper, w)) > 1 and not any(map(letter, w)))
    bare = some(words, lambda w: not any(map(upper, w)) and not any(map(letter, w)))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), mean, deviation, len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)),
        math.log1p(spread([len(x) for x in lines])[0]), share(upper), share(digit), share(mark), share(lambda c: mark(c) and chr(c) not in ".,;:'\"-()!?"), share(lambda c: chr(c) in ".!?"),
        share(wide), shouted, bare,
    ]


def test_quality_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    twice = labels.filter("quality is not null").limit(3).selectExpr("doc_id", "1 - quality as quality", "toxic")
    rows, marks = docs.select("doc_id", "text").collect(), collections.defaultdict(list)
    labels = labels.unionByName(twice)
    for r in labels.collect():
        if r.quality in (0, 1):
            marks[r.doc_id].append(r.quality)
    crc = lambda i: zlib.crc32(str(i).encode())
    x = {r.doc_id: np.array(statistics_by_hand(r.text)) for r in rows}
    learn = [i for i in x if i in marks and crc(i) % 5]
    kernel = quality.Kernel(np.mean([x[i] for i in learn], axis=0), np.std([x[i] for i in learn], axis=0))
    z, y = {i: kernel(v[None])[0] for i, v in x.items()}, {i: np.mean(marks[i]) for i in learn}
    fold = {i: crc(i) // 5 % 4 for i in learn}

    def solved(rows):
        a = sum(np.outer(z[i], z[i]) for i in rows) + 1e-3 * len(rows) / 257 * np.eye(257)
        return np.linalg.solve(a, sum(z[i] * y[i] for i in rows))

    w, unseen = solved(learn), [solved([i for i in learn if fold[i] != k]) for k in range(4)]
    raw = {i: z[i] @ unseen[fold[i]] for i in learn}
    bins = collections.defaultdict(list)
    for i in learn:
        bins[math.floor((min(max(raw[i], -0.5), 1.5) + 0.5) * 256)].append(i)
    groups = [bins[k] for k in sorted(bins)]
    mean = lambda j, k: np.mean([y[i] for g in groups[j : k + 1] for i in g])
    steps = [max(min(mean(j, k) for k in range(p, len(groups))) for j in range(p + 1)) for p in range(len(groups))]
    knots = [np.mean([raw[i] for i in g]) for g in groups]
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    for i in x:
        want = float(np.clip(np.interp(z[i] @ w, knots, steps), 0, 1))
        assert abs(got[i].score - want) < 1e-5 and got[i].held_out == (crc(i) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.3)


def grams_by_hand(text):
    points = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} "]
    out, mask = [], 0xFFFFFFFF
    for n in range(1, 4):
        for k in range(len(points) - n + 1):
            part = points[k : k + n]
            if any(c != " " for c in part):
                h = 0
                for c in part:
                    h = (h * 0x01000193 & mask) ^ (ord(c) * 0x9E3779B1 & mask)
                h ^= h >> 15
                out.append((h * 0x85EBCA6B & mask) >> 13)
    return [h % languages.FEATURES for h in out]


def languages_by_hand(rows, alpha=0.3, beta=1.0, l1=0.05, l2=0.05, scale=50.0):
    """Probabilities of the classes for each text, by the per-coordinate rule of follow-the-regularised-leader."""
    learn = [(i, t, lang) for i, t, lang in sorted(rows) if zlib.crc32(str(i).encode()) % 5]
    seen = [set(grams_by_hand(t)) for _, t, _ in learn]
    df = collections.Counter(f for s in seen for f in s)
    total = sum(map(bool, seen))
    idf = lambda f: math.log((1 + total) / (1 + df[f])) + 1
    names = sorted({lang for *_, lang in learn})

    def values(text, rounded):
        g = grams_by_hand(text)
        return {**{f: (float(np.float32(n / len(g))) if rounded else n / len(g)) * idf(f) * scale for f, n in collections.Counter(g).items()}, languages.FEATURES: 1.0}

    examples = [(values(t, True), names.index(lang)) for _, t, lang in learn]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f, c):
        v = z[f, c]
        return (math.copysign(l1, v) - v) / ((beta + math.sqrt(n[f, c])) / alpha + l2) if abs(v) > l1 else 0.0

    def softmax(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    order, taught = np.random.default_rng(3), [k for k in range(len(examples)) if k % 5]
    for _ in range(3):
        for k in [taught[j] for j in order.permutation(len(taught))]:
            x, own = examples[k]
            w = {(f, c): weight(f, c) for f in x for c in range(len(names))}
            p = softmax([sum(v * w[f, c] for f, v in x.items()) for c in range(len(names))])
            for (f, c), old in w.items():
                g = x[f] * (p[c] - (c == own))
                z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha * old
                n[f, c] += g * g
    raw = lambda x: [sum(v * weight(f, c) for f, v in x.items()) for c in range(len(names))]
    fitted = [(raw(x), own) for k, (x, own) in enumerate(examples) if k % 5 == 0]
    doubt = (len(names) - 1) / (len(fitted) + len(names))

    def loss(t):
        out = 0.0
        for s, own in fitted:
            logs = [math.log(v) for v in softmax([v / t for v in s])]
            out -= (1 - doubt) * logs[own] + doubt / (len(names) - 1) * (sum(logs) - logs[own])
        return out

    t = min(np.exp(np.linspace(-3, 3, 121)), key=loss)
    return {i: dict(zip(names, softmax([v / t for v in raw(values(text, False))]))) for i, text, _ in rows}


def test_languages_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang is not null and length(text) > 30").orderBy("doc_id").limit(90)
    rows = [(r.doc_id, r.text[:160], r.lang) for r in docs.collect()]
    want = languages_by_hand(rows)
    got = {r.doc_id: r for r in languages.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, scores in want.items():
        assert abs(got[i].score - max(scores.values())) < 1e-3 and scores[got[i].lang_pred] > max(scores.values()) - 1e-3


def spans_by_hand(texts, base):
    """Discovered spans of each text; base has (start, k, end) of each text's base spans."""
    edges, candidates = {}, []

    def contexts(text, matches):
        for k, (start, end) in enumerate(matches):
            before = text[matches[k - 1][1] if k else 0 : start].split()[-1:]
            after = text[end : matches[k + 1][0] if k + 1 < len(matches) else len(text)].split()[:1]
            left, right = (before or [""])[0].lower(), (after or [""])[0].lower()
            names = [("before", left)] * bool(left) + [("after", right)] * bool(right) + [("both", left, right)] * bool(left and right)
            yield start, end, left, names

    def add(instance, patterns, seed):
        for p in patterns:
            edges.setdefault(p, {})[instance] = edges.get(p, {}).get(instance, False) or seed

    for d, text in enumerate(texts):
        for k, pattern in enumerate(PATTERNS):
            matches = [m.span() for m in re.finditer(pattern, text)]
            for start, end, _, names in contexts(text, matches):
                if (start, k, end) in base[d]:
                    add(text[start:end], names, True)
        for start, end, left, names in contexts(text, [m.span() for m in re.finditer(r"\S*[0-9]\S*", text)]):
            token = text[start:end]
            if sum(c.isdigit() for c in token) >= 6:
                shape = "".join("0" if c.isdigit() else "A" if c.isupper() else c if not c.isalnum() else "a" for c in token)
                seed = any(b < end and e > start for b, _, e in base[d])
                add(token, [("shape", shape), ("left", left, shape), *names], seed)
                if not seed:
                    candidates.append((d, start, end, token))
    scores = {}
    for _ in range(3):
        sure = {}
        for p, instances in edges.items():
            confidence = sum(1.0 if seed else scores.get(i, 0.0) for i, seed in instances.items()) / (len(instances) + 1)
            if confidence >= 0.9 and sum(instances.values()) >= 3:
                sure[p] = confidence
        doubts = collections.defaultdict(lambda: 1.0)
        for p, confidence in sure.items():
            for i, seed in edges[p].items():
                if not seed:
                    doubts[i] *= 1 - confidence
        scores = {i: 1 - v for i, v in doubts.items()}
    return {(d, start, end) for d, start, end, token in candidates if scores.get(token, 0.0) >= 0.9}


# The contract's expressions.
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_discovered_spans_equal_brute_force(spark):
    random.seed(11)
    texts = []
    for i in range(700):
        before, after = random.choice([("account", "is"), ("Call", "now"), ("ref", "or"), ("write", "soon"), ("", "")])
        kind = random.random() * (1.15 if before in ("account", "Call") else 2)
        thing = f"+1 415 555 {random.randrange(10**4):04d}" if kind < 0.7 else f"u{random.randrange(10**6)}@mail.org" if kind < 1.1 else random.choice([f"AB-{random.randrange(10**6):06d}", f"{random.randrange(10**7):07d}", "12", f"x{random.randrange(10**6):06d}y"])
        texts.append(" ".join(x for x in (random.choice(["the", "a", "so 7"]), before, thing, after, random.choice(["open", "shut", "4"])) if x))
    rows = private.private_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = spans_by_hand(texts, [{tuple(x) for x in r.base} for r in sorted(rows, key=lambda r: r.doc_id)])
    assert {(r.doc_id, x.start, x.end) for r in rows for x in r.spans if x.k == 4} == want and want
