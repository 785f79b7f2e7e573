"""Retrieval metrics, answer checks and table comparisons."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.schemas import compiled
from millrace.functions.text import is_json


def judged(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, id, rank) with is_rel: whether (case_id, id) is expected."""
    return results.join(expected.select("case_id", "id", F.lit(True).alias("is_rel")), ["case_id", "id"], "left").withColumn("is_rel", F.coalesce("is_rel", F.lit(False)))


def metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """MRR, recall and precision at k, NDCG at k and average precision of each case, in one pass over the results."""
    return judged_metrics(judged(results, expected), expected.groupBy("case_id").agg(F.count_distinct("id").alias("wanted")), k)


def judged_by_label(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, id, rank) with is_rel where all other rows with a case's label are expected: no list of them is made. Labels are (id, label) of all rows, cases among them."""
    one = labels.groupBy("id").agg(F.collect_set("label").alias("labels"))
    rows = results.join(one.withColumnRenamed("labels", "__x"), "id", "left").join(one.select(F.col("id").alias("case_id"), F.col("labels").alias("__y")), "case_id", "left")
    return rows.withColumn("is_rel", (F.col("id") != F.col("case_id")) & F.coalesce(F.arrays_overlap("__x", "__y"), F.lit(False))).drop("__x", "__y")


def wanted_by_label(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, wanted) of cases (id, label) with an expected row: how many other rows have the case's label."""
    counts = labels.select("id", "label").distinct().groupBy("label").agg(F.count("*").alias("wanted"))
    return cases.select("id", "label").distinct().join(counts, "label").select(F.col("id").alias("case_id"), (F.col("wanted") - 1).alias("wanted")).filter("wanted > 0")


def judged_metrics(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The metrics of judged rows (case_id, id, rank, is_rel) and of the number of expected rows of each case."""
    hits = F.sum(F.col("is_rel").cast("int")).over(Window.partitionBy("case_id").orderBy("rank"))
    rows = rows.withColumn("hits", hits)
    inside = F.col("is_rel") & (F.col("rank") <= k)
    sums = rows.groupBy("case_id").agg(
        F.min(F.when(F.col("is_rel"), F.col("rank"))).alias("first"), F.count_if(inside).alias("found"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("is_rel"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    both = wanted.join(sums, "case_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return both.select(
        "case_id", zero(1 / F.col("first")).alias("mrr"), zero(F.col("found") / F.col("wanted")).alias("recall"), zero(F.col("found") / F.lit(float(k))).alias("precision"),
        zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("ap") / F.col("wanted")).alias("average_precision"),
    )


def summary(per_case: DataFrame, min_mrr: float, min_recall: float) -> DataFrame:
    names = ("mrr", "recall", "precision", "ndcg", "average_precision")
    means = per_case.agg(F.count("*").alias("cases"), *[F.round(F.avg(n), 6).alias(n) for n in names])
    return means.withColumn("passed", (F.col("mrr") >= min_mrr) & (F.col("recall") >= min_recall))


def evaluate(cases: DataFrame, expected: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int) -> DataFrame:
    """Metrics of any search function, from cases and a depth to (case_id, id, rank)."""
    return metrics(search(cases, k).filter(F.col("rank") <= k), expected, k)


def decide(candidates: DataFrame, decider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The decisions that a function gives for batches of candidates; what asks a model is as good as a rule."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield decider(part)

    return candidates.mapInPandas(run, schema)


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "`", "")))


def check_exact(expected: str, actual: str) -> Column:
    return _plain(expected) == _plain(actual)


def check_includes(expected: str, actual: str) -> Column:
    return F.lower(actual).contains(F.lower(expected))


def check_regex(expected: str, actual: str) -> Column:
    return F.expr(f"{actual} rlike {expected}")


def check_valid_json(actual: str) -> Column:
    return F.coalesce(is_json(F.col(actual)), F.lit(False))


def check_json_path(path: str, expected: str, actual: str) -> Column:
    return F.coalesce(F.get_json_object(actual, path) == F.col(expected), F.lit(False))


def check_json_schema(actual: str, fields: dict[str, str]) -> Column:
    """Every named field is there and reads as its type."""
    ok = check_valid_json(actual)
    for name, kind in fields.items():
        ok = ok & F.expr(f"try_variant_get(try_parse_json({actual}), '$.{name}', '{kind}') is not null")
    return ok


def matches_json_schema(actual: str, schema: dict | str) -> Column:
    """Whether an answer is JSON, a code fence around it apart, that meets a JSON Schema."""
    fenced = rf"try_parse_json(regexp_replace({actual}, '(?s)^\\s*```[a-z]*\\s*(.*?)\\s*```\\s*$', '$1'))"
    return F.expr(compiled(schema, fenced))


def answer_summary(df: DataFrame) -> DataFrame:
    """Counts, pass rate, cost and tokens of rows (passed, tokens, price)."""
    cost = F.round(F.sum(F.col("tokens") * F.col("price") / 1000), 6)
    return df.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), cost.alias("cost"), F.sum("tokens").alias("tokens"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has more of them."""
    return a.exceptAll(b).withColumn("side", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def _same(a, b) -> bool:
    """Equality of JSON values: numbers by value, and true is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return a == b


def _json_text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _differences(a, b, ignore: frozenset[str]) -> Iterator[tuple[str, str | None, str | None, str]]:
    """(path, before, after, status): objects by name, arrays by index, to any depth."""

    def kept(value):
        if isinstance(value, dict):
            return {k: kept(v) for k, v in value.items() if k not in ignore}
        return [kept(v) for v in value] if isinstance(value, list) else value

    todo = [("", a, b)]
    while todo:
        path, x, y = todo.pop()
        if isinstance(x, dict) and isinstance(y, dict):
            pairs = [(f"{path}.{k}" if path else k, k in x, k in y, x.get(k), y.get(k)) for k in {**x, **y} if k not in ignore]
        elif isinstance(x, list) and isinstance(y, list):
            pairs = [(f"{path}[{k}]", k < len(x), k < len(y), x[k] if k < len(x) else None, y[k] if k < len(y) else None) for k in range(max(len(x), len(y)))]
        else:
            x, y = kept(x), kept(y)
            if not _same(x, y):
                yield path, _json_text(x), _json_text(y), "changed"
            continue
        for at, before, after, v, w in pairs:
            if before and after:
                todo.append((at, v, w))
            elif before:
                yield at, _json_text(kept(v)), None, "removed"
            else:
                yield at, None, _json_text(kept(w)), "added"


def json_field_diff(a: DataFrame, b: DataFrame, key: str, column: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(key, field, before, after, status): what differs between the JSON trees of one key, to any depth.

    Fields are paths such as ``meta.tags[2]``. A branch that one side lacks is one row with its whole text. Names in
    ``ignore`` are left out at every depth. Strings are shown bare, other values as JSON text with sorted names. A text
    that is missing or no JSON counts as an empty object. Keys should differ within a side.
    """
    left_out = frozenset(ignore)
    kind = a.schema[key].dataType.simpleString()

    def read(text: str | None):
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            value = None
        return {} if value is None else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *d) for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for d in _differences(read(x), read(y), left_out)]
            types = [batch.schema.field(0).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "field", "before", "after", "status"])

    both = a.select(key, F.col(column).alias("__a")).join(b.select(key, F.col(column).alias("__b")), key, "full_outer")
    return both.filter(~F.col("__a").eqNullSafe(F.col("__b"))).mapInArrow(run, f"`{key}` {kind}, field string, before string, after string, status string")


def quality_checks(df: DataFrame, checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(check, rows, violations) of named checks (name, filter, assertion), all counted in one pass."""
    counts = [c for n, where, holds in checks for c in (F.count_if(F.expr(where)).alias(f"{n}__r"), F.count_if(F.expr(f"({where}) and not ({holds})")).alias(f"{n}__v"))]
    one = df.agg(*counts)
    each = [F.struct(F.lit(n).alias("check"), F.col(f"{n}__r").alias("rows"), F.col(f"{n}__v").alias("violations")) for n, _, _ in checks]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")
