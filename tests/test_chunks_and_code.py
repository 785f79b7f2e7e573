"""Chunks, symbols, issue readers and routing on small cases."""

import json

from pyspark.sql import functions as F

from millrace.operators import chunks, code, ranking
from millrace.sources import issues


def test_sentence_chunks(spark):
    assert chunks.sentence_chunks("", 10) == [] and chunks.sentence_chunks(" a b ", 10) == ["a b"]
    assert chunks.sentence_chunks("One two. Three four! Five", 12) == ["One two.", "Three four!", "Five"]
    assert chunks.sentence_chunks("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"]
    assert chunks.sentence_chunks("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert all(len(c.encode()) <= 7 for c in chunks.sentence_chunks("éé éé. ééééééé é", 7))
    chunks.register_tables(spark)
    got = spark.sql("SELECT idx, chunk FROM VALUES ('One two. Three four! Five') t(x), LATERAL chunk_text(x, 12)").collect()
    assert [r.chunk for r in got] == ["One two.", "Three four!", "Five"]


def test_rag_keeps_order(spark):
    docs = spark.createDataFrame([(1, "alpha beta " * 3 + "gamma delta " * 3 + "alpha beta " * 3)], "doc_id int, text string")
    got = chunks.rag_chunks(docs, "alpha beta", 33, 2).orderBy("idx").collect()
    assert got[0].idx == 0 and len(got) == 2 and got[0].score >= got[1].score


def test_symbols_and_outline(spark):
    source = "export class Cat {\n  meow(x) {\n    if (x) { purr(); }\n  }\n}\nfunction feed(c) {}\n"
    files = spark.createDataFrame([("a.ts", source), ("b.go", "func (c *Cat) Run(x int) {}\nfunc main() {}\n"), ("c.py", "def one():\n    pass\n")], "path string, source string")
    symbols = code.extract_symbols(files)
    got = {(r.path, r.id) for r in symbols.collect()}
    assert {("a.ts", "cls:Cat"), ("a.ts", "fn:feed"), ("a.ts", "mtd:Cat.meow"), ("b.go", "fn:Run"), ("b.go", "fn:main"), ("c.py", "fn:one")} <= got
    assert ("a.ts", "mtd:Cat.if") not in got
    tree = {r.id: r.methods for r in code.outline(symbols).filter("path = 'a.ts'").collect()}
    assert "meow" in tree["cls:Cat"] and tree["fn:feed"] == []
    edges = spark.createDataFrame([("c.py", "fn:one", "fn:two")], "path string, src string, dst string")
    text = {r.path: r for r in code.file_summary_text(files, symbols, edges).collect()}
    assert text["c.py"].overview.startswith("File: c.py\nLanguage: py\nSymbols: 1\nEdges: 1") and "## [fn] one" in text["c.py"].content


def test_issue_readers(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"number": 7, "title": "t", "body": "b" * 6000, "state": "open", "html_url": "u", "user": {"login": "me"}, "labels": [{"name": "x"}, {"name": "y"}], "assignees": []}))
    r = issues.issues_to_nodes(spark.read.schema(issues.GITHUB).json(str(tmp_path / "g.json")), "p").first()
    assert (r.uri, r.name, r.abstract) == ("node://p/github/issues/7", "Issue #7: t", "GitHub Issue [open] | Labels: x, y")
    assert r.content.endswith("\n...(truncated)") and "Assignees" not in r.overview
    (tmp_path / "l.json").write_text(json.dumps({"identifier": "A-1", "title": "t", "description": "d", "url": "u", "state": {"name": "Done"}, "priority": 2, "assignee": {"name": "z"}, "labels": {"nodes": []}}))
    df = spark.read.schema(issues.LINEAR).json(str(tmp_path / "l.json"))
    assert issues.linear_to_nodes(df, "p", "done").first().abstract == "Linear Issue [Done] | Priority: 2"
    assert issues.linear_to_nodes(df, "p", "todo").count() == 0


def test_routing(spark):
    memories = spark.createDataFrame([("m1", "tokens expire after one hour"), ("m2", "other")], "id string, content string")
    prompts = spark.createDataFrame([(1, "Tokens expire after one hour!"), (2, "remember the milk"), (3, "a new skill"), (4, "plain")], "prompt_id int, prompt string")
    got = {r.prompt_id: (r.op, r.target, r.importance) for r in ranking.route_prompts(prompts, memories).collect()}
    assert got == {1: ("update_memory", "m1", None), 2: ("create_memory", None, 5), 3: ("create_skill", None, None), 4: ("create_memory", None, 4)}


def test_enrichers_that_fail_leave_nulls(spark):
    df = spark.range(3)
    out = chunks.enriched(df, [lambda d: d.withColumn("a", F.lit(1)), lambda d: d.withColumn("b", F.col("missing"))], {"a": "int", "b": "int"})
    assert [(r.a, r.b) for r in out.collect()] == [(1, None)] * 3


def test_exports_by_language(spark):
    names = [(path, f"fn:{n}", "fn", n, n == "_marked") for path in ("a.go", "b.py", "c.ts") for n in ("Big", "small", "_marked", "Élan")]
    symbols = spark.createDataFrame(names, "path string, id string, kind string, name string, exported boolean")
    got = {p: sorted(r.name for r in code.outline(symbols, exports_only=True).collect() if r.path == p) for p in ("a.go", "b.py", "c.ts")}
    assert got == {"a.go": ["Big", "_marked", "Élan"], "b.py": ["Big", "_marked", "small", "Élan"], "c.ts": ["_marked"]}
    bare = {r.name for r in code.outline(symbols.drop("exported"), exports_only=True).collect() if r.path == "a.go"}
    assert bare == {"Big", "Élan"}
