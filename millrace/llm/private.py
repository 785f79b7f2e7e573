"""Personal data by patterns and by bootstrapped contexts, in DataFrame and SQL functions only.

Base entities (email, ip, card, phone) are found by expressions and checks. They are the seeds of a bootstrap: every
base entity and every token with enough digits is an instance, its neighbours and its shape are patterns, together and
alone. In each round a pattern's
confidence is the share of its instances that is believed, and an instance is believed as far as its patterns are
sure. Unseen instances that the high-confidence patterns discover become spans of kind id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, stored

# The contract's expressions. Repetitions are possessive where nothing that follows could give back a
# character, and runs are entered at their first character or after a match, so that each text is read once.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the expression to match at all.
_NEEDS = {"email": "instr({t}, '@') > 0", "ip": r"{t} rlike r'[0-9]\.[0-9]'", "card": r"{t} rlike r'[0-9][\x20-]?[0-9]'", "phone": r"{t} rlike r'\+[0-9]'"}
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, int(substr(reverse({d}), i, 1)), "
    "int(substr('0246813579', int(substr(reverse({d}), i, 1)) + 1, 1)))) % 10 = 0"
)
_CHECKS = {
    "email": "true",
    "ip": r"forall(split({m}, r'\.'), p -> length(regexp_replace(p, '^0+(?=.)', '')) <= 3 and int(right(concat('00', p), 3)) <= 255)",
    "card": "length({d}) between 14 and 19 and " + _LUHN,
    "phone": "length({d}) between 10 and 15",
}
_TOKEN = r"(?:(?<!\S)|\G)[^\s0-9]*+[0-9]\S*+"


#: SQL for the last and the first word of a text x.
_LAST, _FIRST = r"lower(reverse(regexp_extract(reverse(x), r'^\s*(\S+)', 1)))", r"lower(regexp_extract(x, r'^\s*(\S+)', 1))"
#: Matches whose places are summed up in one go; an array that grows is copied at each step.
_CHUNK = 128


def _found(text: str, pattern: str, needs: str) -> str:
    """SQL for array<struct<m, l, r, start>>: all matches, the words before and after them, as far as the next match, and where they start."""
    matches, between = f"regexp_extract_all({text}, r'{pattern}', 0)", f"split({text}, r'{pattern}', -1)"
    words = f"transform({between}, x -> named_struct('n', length(x), 'l', {_LAST}, 'r', {_FIRST}))"
    rows = f"filter(zip_with(zip_with({matches}, {words}, (m, w) -> named_struct('m', m, 'n', w.n, 'l', w.l)), slice({words}, 2, 1000000000), (a, w) -> named_struct('m', a.m, 'n', a.n, 'l', a.l, 'r', w.r)), a -> a.m is not null)"
    one = "struct<m: string, l: string, r: string, start: int>"
    part = (
        f"aggregate(part, named_struct('at', 0, 'out', cast(array() as array<{one}>)), (a, x) -> named_struct('at', a.at + x.n + length(x.m), "
        "'out', concat(a.out, array(named_struct('m', x.m, 'l', x.l, 'r', x.r, 'start', a.at + x.n)))))"
    )
    parts = f"transform(transform(sequence(0, int((size(rows) - 1) / {_CHUNK})), g -> slice(rows, g * {_CHUNK} + 1, {_CHUNK})), part -> {part})"
    whole = (
        f"flatten(aggregate({parts}, named_struct('at', 0, 'out', cast(array() as array<array<{one}>>)), (a, p) -> named_struct('at', a.at + p.at, 'out', "
        "concat(a.out, array(transform(p.out, x -> named_struct('m', x.m, 'l', x.l, 'r', x.r, 'start', x.start + a.at))))), a -> a.out))"
    )
    return f"case when {needs.format(t=text)} then flatten(transform(array({rows}), rows -> if(size(rows) = 0, cast(array() as array<{one}>), {whole}))) else cast(array() as array<{one}>) end"


#: The patterns of a context: its left word, its right word, and both; a missing word is no pattern.
_CONTEXTS = "if(x.l = '', null, xxhash64('before', x.l)), if(x.r = '', null, xxhash64('after', x.r)), if(x.l = '' or x.r = '', null, xxhash64('both', x.l, x.r))"


def _base(text: str) -> Column:
    """array<struct<start, k, end, instance, patterns>> of the base entities in a never-null text column; k is the place in KINDS."""
    parts = []
    for k, kind in enumerate(KINDS):
        digits = _DIGITS.format(m="x.m")
        check = _CHECKS[kind].format(m="x.m", d=digits)
        parts.append(
            f"transform(filter({_found(text, PATTERNS[kind], _NEEDS[kind])}, x -> {check}), x -> named_struct('start', x.start, 'k', {k}, 'end', x.start + length(x.m), "
            f"'instance', xxhash64(x.m), 'patterns', array_compact(array({_CONTEXTS}))))"
        )
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _tokens(text: str, least_digits: int) -> Column:
    """array<struct> of the tokens with at least so many digits: place, text's hash, patterns of shape and context."""
    found = _found(text, _TOKEN, f"{{t}} rlike '[0-9]'")
    shape = r"regexp_replace(regexp_replace(regexp_replace(x.m, '[0-9]', '0'), '\\p{Lu}', 'A'), '[^0A\\p{Punct}]', 'a')"
    return F.expr(
        f"transform(filter({found}, x -> length({_DIGITS.format(m='x.m')}) >= {least_digits}), x -> "
        f"named_struct('start', x.start, 'end', x.start + length(x.m), 'instance', xxhash64(x.m), "
        f"'patterns', array_compact(array(xxhash64('shape', {shape}), xxhash64('left', x.l, {shape}), {_CONTEXTS}))))"
    )


def bootstrapped(tokens: DataFrame, rounds: int = 3, sure: float = 0.9, believed: float = 0.9, support: int = 3) -> DataFrame:
    """Unseen instances that high-confidence patterns discover, from rows (instance, patterns, seed).

    A pattern counts if ``support`` different seeds induce it. Its confidence is the sum of its instances' scores over
    their number plus one; an instance's score is one less the product of its sure patterns' doubts, a seed's is one.
    """
    edges = tokens.select("instance", "seed", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    scores = None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.lit(0.0)) if scores is None else edges.join(scores, "instance", "left")
        patterns = scored.groupBy("pattern").agg((F.sum(score) / (F.count("*") + 1)).alias("confidence"), F.count_if("seed").alias("seeds"))
        patterns = stored(patterns.filter((F.col("confidence") >= sure) & (F.col("seeds") >= support)).select("pattern", "confidence"))
        doubt = F.product(1 - F.col("confidence"))
        scores = stored(edges.filter(~F.col("seed")).join(patterns, "pattern").groupBy("instance").agg((1 - doubt).alias("score")))
    return scores.filter(F.col("score") >= believed).select("instance")


def private_spans(df: DataFrame, rounds: int = 3, least_digits: int = 6) -> DataFrame:
    """One row for each row of (doc_id, text): base spans and all spans, as array<struct<start, k, end>> and sorted.

    k is 0 to 3 for KINDS and 4 for id. Places are code points, the end exclusive. Null and empty texts have none, an
    empty table gives none; texts, words and tokens of any length are read whole; repeated rows give repeated rows.
    Other columns than text are passed on, but for ``base`` and ``spans``, which are replaced.
    """
    given = [c for c in df.columns if c not in ("text", "base", "spans")]
    text = df.select(F.struct(*[F.col(f"`{c}`") for c in given], F.lit(0).alias("__")).alias("given"), F.coalesce("text", F.lit("")).alias("__text"))
    known = text.select("given", _base("__text").alias("seeds"), _tokens("__text", least_digits).alias("tokens"))
    known = known.withColumn("base", F.expr("transform(seeds, x -> named_struct('start', x.start, 'k', x.k, 'end', x.end))"))
    known = stored(known.withColumn("row", F.monotonically_increasing_id()))
    tokens = known.select("row", "base", F.explode("tokens").alias("x")).select(
        "row", "x.start", "x.end", "x.instance", "x.patterns", F.expr("exists(base, b -> b.start < x.end and b.end > x.start)").alias("seed")
    )
    seeds = known.select("row", F.explode("seeds").alias("x")).select("row", "x.start", "x.end", "x.instance", "x.patterns", F.lit(True).alias("seed"))
    found = bootstrapped(tokens.union(seeds), rounds)
    spans = tokens.filter(~F.col("seed")).join(found, "instance").groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("k"), "end")).alias("found"))
    whole = known.join(spans, "row", "left").withColumn("spans", F.expr("array_sort(concat(base, coalesce(found, array())))"))
    return whole.select(*[F.col("given")[c].alias(c) for c in given], "base", "spans")


def _listed(spans: str, kinds: tuple[str, ...]) -> str:
    names = ", ".join(f"'{x}'" for x in kinds)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.start, ':', x.end)), ',')"


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = private_spans(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(F.expr(_listed("base", KINDS)), 256).alias("base_sha256"), F.expr(_listed("spans", (*KINDS, "id"))).alias("spans"))


def masked(df: DataFrame, rounds: int = 3) -> DataFrame:
    """The same rows with every span's text replaced by its kind in brackets; overlapping spans become one."""
    row = df.withColumn("__whole", F.struct(*df.columns)).select("__whole", "text")
    spans = private_spans(row.select("text", "__whole"), rounds)
    names = ", ".join(f"'[{x.upper()}]'" for x in (*KINDS, "ID"))
    cut_out = (
        "aggregate(spans, named_struct('at', 0, 'out', cast('' as string)), (a, x) -> if(x.end <= a.at, a, named_struct('at', x.end, 'out', "
        f"concat(a.out, substr(__whole.text, a.at + 1, greatest(x.start - a.at, 0)), if(x.start < a.at, '', element_at(array({names}), x.k + 1)))))"
        ", a -> concat(a.out, substr(__whole.text, a.at + 1)))"
    )
    text = F.expr(f"case when size(spans) = 0 then __whole.text else {cut_out} end")
    return spans.select(*[(text if c == "text" else F.col("__whole")[c]).alias(c) for c in df.columns])
