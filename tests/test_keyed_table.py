"""The table that takes in batches of changes, against a plain dictionary."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.sources.keyed import KeyedTable

SCHEMA = "kind string, id long, value string, at long"


def table(spark, path, **more):
    return KeyedTable(spark, str(path), SCHEMA, ["kind", "id"], "at", **more)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def batch(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, gone boolean")


def test_batches_equal_a_dictionary(spark, tmp_path):
    rng, held, at = random.Random(1), {}, 0
    index = table(spark, tmp_path, buckets=5, most_parts=3)
    assert index.versions() == [] and index.rows().count() == 0
    for number in range(9):
        rows = []
        for _ in range(40):
            at += 1
            rows.append((rng.choice("ab"), rng.randrange(30), str(at), at, rng.random() < 0.3))
        rng.shuffle(rows)
        assert index.apply(batch(spark, rows), number, F.col("gone"))
        for kind, key, value, when, gone in sorted(rows, key=lambda r: r[3]):
            held.pop((kind, key), None) if gone else held.update({(kind, key): (value, when)})
        got = {(r.kind, r.id): (r.value, r.at) for r in index.rows().collect()}
        assert got == held
        assert max(map(len, index.parts().values())) <= 3
    index.compact(gone_before=at + 1)
    index.clear(1)
    assert {(r.kind, r.id): (r.value, r.at) for r in index.rows().collect()} == held
    assert index.versions() == [(8, 1)] and len(files(tmp_path / "parts")) <= 5


def test_small_batch_writes_its_buckets_only(spark, tmp_path):
    index = table(spark, tmp_path, buckets=32)
    index.apply(batch(spark, [("a", k, "x", 1, False) for k in range(3000)]), 0, F.col("gone"))
    before = files(tmp_path / "parts")
    assert len(before) == 32
    index.apply(batch(spark, [("a", k, "y", 2, False) for k in range(10)]), 1, F.col("gone"))
    after = files(tmp_path / "parts")
    assert {k: after[k] for k in before} == before and len(after) - len(before) <= 10
    keys = spark.createDataFrame([("a", 3), ("a", 5000)], "kind string, id long")
    near = index.of_keys(keys)
    assert [(r.id, r.value) for r in near.collect()] == [(3, "y")]
    assert len(near.inputFiles()) <= 4
    assert [r.value for r in index.rows(0).filter("id = 3").collect()] == ["x"]


def test_repeated_and_broken_batches(spark, tmp_path):
    index = table(spark, tmp_path, buckets=4)
    index.apply(batch(spark, [("a", 1, "x", 1, False)]), 0, F.col("gone"))
    first = files(tmp_path)
    assert not index.apply(batch(spark, [("a", 1, "other", 9, False)]), 0, F.col("gone"))
    assert files(tmp_path) == first and index.rows().first().value == "x"

    class Breaks(KeyedTable):
        def _commit(self, version, parts):
            raise RuntimeError("the driver went away")

    broken = Breaks(spark, str(tmp_path), SCHEMA, ["kind", "id"], "at", 4)
    with pytest.raises(RuntimeError):
        broken.apply(batch(spark, [("a", 1, "half", 2, False), ("a", 2, "half", 2, False)]), 1, F.col("gone"))
    assert [r.value for r in index.rows().collect()] == ["x"]
    assert index.apply(batch(spark, [("a", 1, "y", 2, False)]), 1, F.col("gone"))
    assert [(r.id, r.value) for r in index.rows().collect()] == [(1, "y")]


def test_late_changes_and_odd_rows(spark, tmp_path):
    index = table(spark, tmp_path, buckets=2)
    index.apply(batch(spark, [("a", 1, None, 5, True), (None, None, "n", 1, None), ("a", 2, None, 5, False)]), 3, F.col("gone"))
    index.apply(batch(spark, [("a", 1, "late", 4, False), ("a", 2, "late", 4, False), (None, None, "m", 2, False)]), 7, F.col("gone"))
    assert sorted((r.id or 0, r.value) for r in index.rows().collect()) == [(0, "m"), (2, None)]
    index.apply(batch(spark, []), 8, F.col("gone"))
    assert index.rows().count() == 2 and [v[0] for v in index.versions()] == [3, 7, 8]
    with pytest.raises(ValueError, match="no commit"):
        index.rows(5)
