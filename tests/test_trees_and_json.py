"""Trees by doubling pointers, JSON trees and schemas, near words: against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.schemas import compiled
from millrace.operators import evaluation, graph, ranking

NODE = "uri string, parent_uri string"


def stats_by_hand(nodes):
    parent, below = dict(nodes), {}
    for uri, up in nodes:
        below.setdefault(up, []).append(uri)
    out, todo = {}, [(u, 0) for u in below.get(None, [])]
    for uri, depth in todo:
        todo += [(c, depth + 1) for c in below.get(uri, [])]
        out[uri] = [depth, len(below.get(uri, [])), 1, int(uri not in below), 0]
    for uri, _ in reversed(todo):
        up = parent[uri]
        if up is not None:
            out[up][2] += out[uri][2]
            out[up][3] += out[uri][3]
            out[up][4] = max(out[up][4], out[uri][4] + 1)
    return {k: tuple(v) for k, v in out.items()}


def test_trees(spark):
    rng = random.Random(6)
    nodes = [("r0", None), ("r1", None)] + [(f"n{k}", f"n{rng.randrange(max(0, k - 9), k)}" if k > 3 else f"r{k % 2}") for k in range(300)]
    nodes += [(f"hub{k}", "r1") for k in range(200)] + [("ring1", "ring2"), ("ring2", "ring1"), ("under", "ring1"), ("lost", "nowhere"), ("below", "lost"), ("self", "self")]
    df = spark.createDataFrame(nodes, NODE)
    want = stats_by_hand(nodes)
    assert {r.uri: tuple(r)[1:] for r in graph.tree_stats(df).collect()} == want
    assert {r.uri: r.depth for r in graph.node_depth(df).collect()} == {k: v[0] for k, v in want.items()}
    assert graph.tree_stats(df.limit(0)).count() == 0 and graph.node_depth(df.filter("uri = 'lost'")).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    kept = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (rounds.append(1), kept(df))[1])
    chain = spark.range(n).select(F.col("id").cast("string").alias("uri"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_uri"))
    got = graph.node_depth(chain).agg(F.sum("depth"), F.max("depth"), F.count("*")).first()
    assert tuple(got) == (n * (n - 1) // 2, n - 1, n) and len(rounds) <= 16


def diff_by_hand(path, a, b, ignore):
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted({*a, *b} - ignore):
            at = f"{path}.{k}" if path else k
            if k in a and k in b:
                yield from diff_by_hand(at, a[k], b[k], ignore)
            else:
                yield at, "removed" if k in a else "added"
    elif isinstance(a, list) and isinstance(b, list):
        for k in range(max(len(a), len(b))):
            if k < len(a) and k < len(b):
                yield from diff_by_hand(f"{path}[{k}]", a[k], b[k], ignore)
            else:
                yield f"{path}[{k}]", "removed" if k < len(a) else "added"
    elif a != b or isinstance(a, bool) != isinstance(b, bool):
        yield path, "changed"


def tree(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    if kind == 4:
        return {k: tree(rng, depth - 1) for k in rng.sample(["a", "b", "c", "noise"], rng.randrange(4))}
    if kind == 5:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [rng.randrange(3), "x" * rng.randrange(3), None, rng.random() < 0.5][kind]


def test_json_trees_differ_where_they_do(spark):
    rng = random.Random(7)
    pairs = [(k, {"t": tree(rng, 4)}, {"t": tree(rng, 4)}) for k in range(150)]
    pairs += [(1000 + k, a, a) for k, a, _ in pairs[:20]] + [(2000, {"v": 1}, {"v": 1.0}), (2001, {"v": 1}, {"v": True}), (2002, {"v": "1"}, {"v": 1})]
    a, b = (spark.createDataFrame([(p[0], json.dumps(p[side])) for p in pairs], "id long, j string") for side in (1, 2))
    got = sorted((r.id, r.field, r.status) for r in evaluation.json_field_diff(a, b, "id", "j", ["noise"]).collect())

    def bare(value):
        if isinstance(value, dict):
            return {k: bare(v) for k, v in value.items() if k != "noise"}
        return [bare(v) for v in value] if isinstance(value, list) else value

    want = sorted((k, at, status) for k, x, y in pairs for at, status in diff_by_hand("", bare(x), bare(y), {"noise"}))
    assert got == want and {s for _, _, s in want} == {"added", "removed", "changed"}
    one = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "ü"}]}}'), (2, "no json"), (3, None), (4, "[1]")], "id long, j string")
    two = spark.createDataFrame([(1, '{"a": {"b": [1]}}'), (2, '{"x": null}'), (5, '{"y": [true]}'), (4, '{"0": 1}')], "id long, j string")
    rows = sorted(tuple(r) for r in evaluation.json_field_diff(one, two, "id", "j").collect())
    assert rows == [(1, "a.b[1]", '{"c":"ü"}', None, "removed"), (2, "x", None, "null", "added"), (4, "", "[1]", '{"0":1}', "changed"), (5, "y", None, "[true]", "added")]


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": ["string", "null"]}, ['"a"', "null"], ["1", "[]"]), ({"type": "number"}, ["1", "1.5", "1e9"], ['"1"', "true"]), ({"const": {"b": 1, "a": [2]}}, ['{"a":[2],"b":1}'], ['{"a":[2]}', "1"]),
        ({"properties": {"it's": {"type": "string"}}}, ['{"it\'s":"x"}', "{}", "3"], ['{"it\'s":3}']), ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, ['["a",1,2]', "[]"], ["[1]", '["a","b"]']),
        ({"uniqueItems": True, "maxItems": 3}, ["[1,2]", '["a"]'], ["[1,1]", "[1,2,3,4]"]), ({"contains": {"minimum": 5}}, ["[1,6]"], ["[1,2]", "[]"]), ({"multipleOf": 0.5}, ["1.5", "2", '"x"'], ["1.2"]),
        ({"minLength": 2, "maxLength": 3}, ['"ab"', "7"], ['"a"', '"abcd"']), ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}'], ["{}", '{"a":1,"b":2,"c":3}']), ({"propertyNames": {"pattern": "^[a-z]+$"}}, ['{"ab":1}'], ['{"aB":1}']),
        ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": {"type": "string"}}, ['{"n_a":1,"b":"x"}'], ['{"n_a":"x"}', '{"b":1}']), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ['"x"', "3"], ["2"]),
        ({"oneOf": [{"minimum": 3}, {"multipleOf": 2}]}, ["3", "2"], ["4", "1"]), ({"not": {"type": "array"}}, ["1"], ["[]"]), ({"allOf": [{"type": "integer"}, {"maximum": 3}]}, ["3"], ["4", '"a"']),
        ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ['"ab"', "2"], ['"a"', "1"]), ({"$defs": {"a/b": {"exclusiveMinimum": 0}}, "properties": {"x": {"$ref": "#/$defs/a~1b"}}}, ['{"x":1}'], ['{"x":0}']),
        (True, ["1", "null"], []), (False, [], ["1"]), ({"enum": [1, "1", True]}, ["1", "1.0", '"1"', "true"], ["false", "2"]), ({"properties": {"a": {"properties": {"b": {"items": {"required": ["c"]}}}}}}, ['{"a":{"b":[{"c":1}]}}'], ['{"a":{"b":[{"c":1},{}]}}']),
    ],
)
def test_schemas(spark, schema, good, bad):
    rows = spark.createDataFrame([(g, True) for g in good] + [(b, False) for b in bad] + [("nope", False), (None, False)], "j string, ok boolean")
    got = rows.withColumn("got", F.expr(compiled(schema, "try_parse_json(j)"))).collect()
    assert [(r.j, r.got) for r in got] == [(r.j, r.ok) for r in got]


def test_schemas_that_are_not_understood():
    for schema in ({"unevaluatedItems": False}, {"$ref": "other.json"}, {"$ref": "#"}):
        with pytest.raises(ValueError, match="schema|keyword|Schema"):
            compiled(schema, "v")


def test_near_words(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(400)] + [None, "übung", "ubung"]
    tokens = ["abca", "b", "cccabc", "übung", ""]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    table = spark.createDataFrame([(w,) for w in words], "word string")
    for fuzziness in (0, 1, 2):
        want = {(t, w) for t in tokens for w in words if w is not None and distance(t, w) <= fuzziness}
        assert {(r.token, r.word) for r in ranking.near_words(table, tokens, fuzziness).collect()} == want
