"""The trigram index against plain scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import scan, trigrams
from millrace.operators.trigrams import Needs, TrigramIndex, needs_of


def met(needs, low):
    held = [p.trigrams() and met(p, low) if isinstance(p, Needs) else p in low for p in needs.of]
    return (any(held) if needs.any else all(held)) if needs.of else True


@pytest.mark.parametrize(
    ("pattern", "grams"),
    [
        ("token", {"tok", "oke", "ken"}), ("(?i)ToKen", {"tok", "oke", "ken"}), (r"\bAND\b", {"and"}), ("abc.*def", {"abc", "def"}), ("ab[cd]e", {"abc", "bce", "abd", "bde"}), ("(?:abc)+x", {"abc"}), ("abc?d", {"abc", "bcd", "abd"}),
        ("abcd|xyz", {"abc", "bcd", "xyz"}), ("a[^b]c", set()), ("abc|x", set()), ("ab*c", set()), (r"[a-z]{3}", set()), ("x{3}", {"xxx"}), ("(ab){2,}", {"aba", "bab"}), ("日本語", {"日本語"}), ("éab", set()), (r"\Qa.c\Ed", set()), ("[a&&b]cde", set()), ("(", set()),
        ("foo(?=bar)", {"foo"}), (r"abc\x20d", {"abc", "bc ", "c d"}),
    ],
)
def test_needed_trigrams(pattern, grams):
    assert needs_of(pattern).trigrams() == grams


def test_needs_hold_for_every_match():
    rng = random.Random(2)
    atoms = ["ab", "c", "[abc]", "[a-d]", ".", "(?:ab|cd)", "(?:a|bc|)", "b+", "(?:ab)*", "c?", "a{2}", "(?:abc){1,2}", "d", "^", "cab", "(?i:AB)"]
    texts = ["".join(rng.choice("abcdAB") for _ in range(rng.randrange(25))) for _ in range(400)]
    hits = refused = 0
    for _ in range(400):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        pattern = f"{pattern}|{rng.choice(atoms)}{rng.choice(atoms)}" if rng.random() < 0.3 else pattern
        needs = needs_of(pattern)
        for text in texts:
            found, left = re.search(pattern, text) is not None, met(needs, text.lower())
            assert left or not found, (pattern, text)
            hits += found
            refused += not left
    assert hits > 1000 and refused > 1000


def test_searches_equal_scans(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("block", F.lit("x")).drop("block")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "ab"), (10**6 + 3, "İstanbul TOKEN\nStraße ΣΑΣ"), (10**6 + 4, "Der Token\nthe license under"), (10**6 + 4, "Der Token\nthe license under")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    index = TrigramIndex.build(docs, str(tmp_path / "i"), ["text"], per_block=16)
    for pattern in ("token", "(?i)token", "licen[cs]e", "^the", "t.k.n", r"\d{4}-\d\d", "ΣΑΣ", "zzzzzz", "[a-z]"):
        want = scan.grep(scan.line_table(docs), pattern)
        assert sorted(index.grep(pattern).collect()) == sorted(want.collect()), pattern
    for text in ("TOKEN", "straße", "σας", "İst", "i̇s", "", "an", "license under"):
        low = F.lower(F.lit(text))
        want = docs.filter(F.coalesce(F.lower("text").contains(low), F.lit(False))).select("doc_id")
        assert sorted(index.containing(text, ["text"]).select("doc_id").collect()) == sorted(want.collect()), text


def test_only_blocks_with_candidates_are_read(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common words and "), F.when(F.col("id").isin(17, 3999), "a quokka").otherwise("a wombat")).alias("text"))
    index = TrigramIndex.build(rows, str(tmp_path / "i"), ["text"], per_block=100)
    assert index.candidates(needs_of("quok+a")).count() == 2
    found = index.matching("quok+a", "text")
    assert sorted(r.doc_id for r in found.collect()) == [17, 3999]
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*block#\d+ IN \(([\d,]+)\)", plan) or re.search(r"block#\d+ = (\d+)\)", plan)
    assert len(set(read[1].split(","))) <= 2 and index.texts.select("block").distinct().count() == 40
    assert index.matching("nowhere", "text").count() == 0
    empty = TrigramIndex.build(rows.limit(0), str(tmp_path / "e"), ["text"])
    assert empty.matching("quokka", "text").count() == 0


def test_folders_do_not_grow_with_small_blocks(spark, tmp_path):
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    index = TrigramIndex.build(df, str(tmp_path / "many"), ["text"], "doc_id", per_block=2)
    assert len(list((tmp_path / "many/texts").glob("block=*"))) <= trigrams.SMALL_BLOCKS
    assert {r.doc_id for r in index.containing("number 29", ["text"]).collect()} == {29, *range(290, 300)}
    assert index.containing("absent", ["text"]).count() == 0
