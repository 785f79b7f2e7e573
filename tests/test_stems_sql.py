"""The SQL of stemmed_search states the published rules, not the forms that a small table happens to have."""

import random

import duckdb

from millrace.functions.stems import BEGINNINGS, STAY, STEP_2, STEP_3, STEP_4, WHOLE, porter2
from millrace.plans import judging, registry


def test_sql_stems_by_the_same_rules():
    r = random.Random(3)
    endings = ["", "s", "y", "e", "ll", "ied", "ies", "sses", "us", "eed", "eedly", "ed", "edly", "ing", "ingly", *STEP_2, *STEP_3, *STEP_4]
    words = {"".join(r.choice("abdeilnrstyuxzpü") for _ in range(r.randrange(1, 8))) + "".join(r.choice(endings) for _ in range(r.randrange(3))) for _ in range(20_000)}
    words |= {b + e for b in (*BEGINNINGS, "hop", "thattion", "erinor", "analog", "happ") for e in endings} | set(WHOLE) | set(STAY) | {s + "s" for s in STAY}
    words = sorted(words - {""})
    c = duckdb.connect()
    c.execute("create table v as select unnest($1) as term", [words])
    got = dict(c.execute(f"WITH {judging._PORTER2} SELECT term, stem FROM p").fetchall())
    assert {w: got[w] for w in words if got[w] != porter2(w)} == {} and len(got) == len(words)


def test_stemmed_search_equals_its_sql_on_endings_of_larger_tables(spark, tmp_path):
    texts = ["thattionlyed x", "thattioneation error", "thattionates", "thattionating thattionated", "thattioneable bugs", "erinorers exceptions", "other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = sorted(c.execute(registry.oracle_sql()["stemmed_search"]).fetchall())
    assert theirs == sorted(map(tuple, registry.queries()["stemmed_search"](spark, str(tmp_path)).collect())) and len(theirs) == 6
