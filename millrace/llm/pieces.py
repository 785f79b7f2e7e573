"""SentencePiece BPE encoding with a prefix table, and decoding.

Merges run in order of merge type, that is of the piece they make; so a text has exactly one encoding, and so has
each of its prefixes. The table stores the last token of each prefix's encoding. A token that ends at a place is
that last token if the pair of it and the last token of the prefix before it stands: no merge across their border
comes before the merges that make them. An automaton finds the tokens that end at each place. The ids follow by
walking the table backwards.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import documents

SPACE = "▁"
_NEVER = float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encodes and decodes with the pieces of a SentencePiece BPE model with byte fallback and identity normalising."""

    def __init__(self, model_file: str, cache_size: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.is_byte = [bool(model.is_byte(i)) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if self.is_byte[i]}
        self.id_of = {self.text[i]: i for i in normal}
        self.rank = {i: -model.get_score(i) for i in normal}
        self.space_id = self.id_of[SPACE]
        self.runs = {x: i for x, i in self.id_of.items() if set(x) == {SPACE}}
        self.run_lengths = {len(x) for x in self.runs}
        tokens = {x: i for x, i in self.id_of.items() if x not in self.runs or x == SPACE}
        if any(SPACE in x[1:] for x in tokens):
            raise ValueError("a piece has a space inside; words can't be encoded apart")
        self.left, self.right = {}, {}
        self._split(sorted((x for x in tokens if len(x) > 1), key=lambda x: self.rank[tokens[x]]), tokens)
        self.automaton = ahocorasick.Automaton()
        for x, i in tokens.items():
            if len(x) == 1 or i in self.left:
                self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        self.known = {x for x in tokens if len(x) == 1}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.cache_size = cache_size

    def _split(self, words: list[str], tokens: dict[str, int]) -> None:
        """For each piece the two pieces that its last merge joins; pieces that merging never makes get none."""
        for word in words:
            parts = [*word]
            if not all(x in tokens for x in parts):
                continue
            while len(parts) > 2:
                made = [(self.rank[tokens[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]
                if not made:
                    break
                k = min(made)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                self.left[tokens[word]], self.right[tokens[word]] = tokens[parts[0]], tokens[parts[1]]

    def stands(self, a: int, b: int) -> bool:
        """Whether the encoding of the text of a followed by that of b is a, b."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self._stands(a, b)
        return known

    def _stands(self, a: int, b: int) -> bool:
        lefts, rights = [a], [b]  # the pieces that touch the border, from the last made to the first
        while lefts[-1] in self.right:
            lefts.append(self.right[lefts[-1]])
        while rights[-1] in self.left:
            rights.append(self.left[rights[-1]])
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            made = self.id_of.get(self.text[lefts[i]] + self.text[rights[j]])
            across = self.rank[made] if made is not None else _NEVER
            grow_left = self.rank[lefts[i - 1]] if i else _NEVER
            grow_right = self.rank[rights[j - 1]] if j else _NEVER
            if across < grow_left and across <= grow_right:
                return False
            if i == 0 and j == 0:
                return True
            if grow_left <= grow_right:
                i -= 1
            else:
                j -= 1

    def _known(self, text: str) -> list[int]:
        """Ids of a text without unknown characters and without runs of spaces: the prefix table, read backwards."""
        last = [-1] * (len(text) + 1)
        length = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(text):
            start = end + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get((before, token))
                if not (self.stands(before, token) if ok is None else ok):
                    continue
            last[end + 1], length[end + 1] = token, size
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def _spaces(self, n: int) -> list[int]:
        """Ids of a run of n spaces: all these merges have one rank, so the leftmost goes first each time.

        What stands to the right of the last part is untouched, so a part grows by one space as long as that makes a
        piece, and after each step by joining the part before it.
        """
        parts = [1] if n else []
        for _ in range(n - 1):
            if parts[-1] + 1 not in self.run_lengths:
                parts.append(1)
                continue
            parts[-1] += 1
            while len(parts) > 1 and parts[-2] + parts[-1] in self.run_lengths:
                last = parts.pop()
                parts[-1] += last
        return [self.runs[SPACE * x] for x in parts]

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of some spaces, written as the space sign, and then a word."""
        word = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(word)
        if not word:
            return self._spaces(spaces)
        text, ids, at = (SPACE if spaces else "") + word, [], 0
        unknown = [k for k, c in enumerate(text) if c not in self.known]
        for k in [*unknown, len(text)]:
            if at < k:
                ids += self._known(text[at:k])
            if k < len(text):
                ids += [self.byte_id[b] for b in text[k].encode()]
            at = k + 1
        if spaces > 1:
            alone = ids[0] == self.space_id
            ids = self._spaces(spaces if alone else spaces - 1) + ids[alone:]
        return ids

    def _cached(self, chunk: str) -> tuple[str, str]:
        got = self.old.get(chunk)
        if got is None:
            ids = self._chunk(chunk)
            got = (",".join(map(str, ids)), self._text(ids))
        if len(chunk) > 256:
            return got  # so that the number of chunks bounds the cache's bytes
        if len(self.young) >= self.cache_size:
            self.old, self.young = self.young, {}
        self.young[chunk] = got
        return got

    def _text(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if self.is_byte[i]:
                pending.append(int(self.text[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            out.append(self.text[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    _chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

    def _parts(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        find, young = self._cached, self.young.get
        chunks = self._chunks(SPACE + text.replace(" ", SPACE))
        return [young(x) or find(x) for x in chunks]

    def encode(self, text: str) -> list[int]:
        return [int(i) for x, _ in self._parts(text) for i in x.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts in front goes."""
        text = self._text(ids)
        return text[1:] if ids and self.text[ids[0]].startswith(SPACE) else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of what they decode to."""
        parts = self._parts(text)
        ids = ",".join([x for x, _ in parts])
        decoded = "".join([x for _, x in parts])
        if parts:
            decoded = decoded[1:]  # the first chunk begins with the space put in front
        n = ids.count(",") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec for each Python worker."""
    return PieceCodec(model_file)


def encode_documents(df: DataFrame, text: str = "text", model_file: str | None = None, into: str = "piece_ids") -> DataFrame:
    """Adds the ids of each text as array<int>. Null and empty texts give an empty array."""
    from pyspark.sql import functions as F

    path = model_file or default_model()

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for part in parts:
            yield part.map(lambda x: c.encode(x or ""))

    return df.withColumn(into, ids(F.col(text)))


def decode_ids(df: DataFrame, ids: str = "piece_ids", model_file: str | None = None, into: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids. Null gives an empty text."""
    from pyspark.sql import functions as F

    path = model_file or default_model()

    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for part in parts:
            yield part.map(lambda x: c.decode([] if x is None else [int(i) for i in x]))

    return df.withColumn(into, decoded(F.col(ids)))


def piece_digests(df: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row for each row of (doc_id, text): number of ids, and digests of the ids and of the decoded text.

    Null and empty texts have no ids; repeated rows give repeated rows; other columns are not read.
    """
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [c.digest(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))
