"""A table by key that takes batches of changes without being written anew.

Rows are dealt to a fixed number of buckets by a hash of the key. A batch adds one small part for each bucket that it
touches; a bucket with too many parts is merged into one. A commit lists the parts of every bucket; it is written last,
so a batch that broke off has changed nothing, is done again by writing its parts over, and a batch whose commit is
there is not done twice. Readers see the newest commit. There is one writer, such as one streaming query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The partition column of the parts.
_BUCKET = "bucket__"
_COMMIT = "bucket int, parts array<string>"


class KeyedTable:
    """Rows of ``schema`` (DDL text), of which ``keys`` name a row and ``order`` says which of two changes is the later one.

    ``order`` is a column of the changes that grows, such as an outbox id; the later change wins in whatever batch it
    comes. Deleted keys stay as markers without values, so that an older change that comes late doesn't bring them back,
    until ``compact`` is told to drop markers from before some point.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str, buckets: int = 64, most_parts: int = 8):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), order
        self.buckets, self.most_parts = buckets, most_parts
        self.schema = StructType.fromDDL(schema)
        self.stored = StructType.fromDDL(schema).add("__gone", "boolean")

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), lambda *parts: self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[tuple[int, int]]:
        """The commits that are complete: the batch's number, and how often the table was compacted since."""
        fs, place = self._files()
        if not fs.exists(place("commits")):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place("commits"))]
        return sorted(tuple(map(int, n.split("."))) for n in names if fs.exists(place("commits", n, "_SUCCESS")))

    def parts(self, number: int | None = None) -> dict[int, list[str]]:
        """The parts of each bucket after a batch, oldest first: as many entries as there are buckets at most."""
        there = [v for v in self.versions() if number is None or v[0] == number]
        if not there:
            if number is not None:
                raise ValueError(f"there is no commit of batch {number}")
            return {}
        return self._parts(there[-1])

    def _parts(self, version: tuple[int, int]) -> dict[int, list[str]]:
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/{version[0]}.{version[1]}").collect()
        return {r["bucket"]: list(r["parts"]) for r in rows}

    def _commit(self, version: tuple[int, int], parts: dict[int, list[str]]) -> None:
        rows = self.spark.createDataFrame(sorted(parts.items()), _COMMIT)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{version[0]}.{version[1]}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, parts: dict[int, list[str]]) -> DataFrame:
        """All changes in these parts, with their bucket."""
        paths = [f"{self.path}/parts/{part}/{_BUCKET}={bucket}" for bucket, of in parts.items() for part in of]
        schema = StructType(list(self.stored.fields)).add(_BUCKET, "integer")
        if not paths:
            return self.spark.createDataFrame([], schema)
        by_part: dict[str, list[str]] = {}
        for p in paths:
            by_part.setdefault(p.rsplit("/", 1)[0], []).append(p)
        frames = [self.spark.read.schema(schema).option("basePath", base).parquet(*of) for base, of in by_part.items()]
        while len(frames) > 1:
            frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) // 2 * 2 :]
        return frames[0]

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last change of each key. Of two with the same order one that deletes counts, else the greater one."""
        rest = [c for c in self.stored.fieldNames() if c not in self.keys and c != "__gone"]
        rest.remove(self.order)
        one = F.max(F.struct(self.order, "__gone", *rest)).alias("x")
        return rows.groupBy(_BUCKET, *self.keys).agg(one).select(_BUCKET, *self.keys, *[F.col(f"x.{c}").alias(c) for c in self.stored.fieldNames() if c not in self.keys])

    def _write(self, rows: DataFrame, part: str) -> set[int]:
        """The buckets that the part has; one file for each."""
        made = rows.repartition(self.buckets, _BUCKET)
        made.select(*self.stored.fieldNames(), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/parts/{part}")
        fs, place = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(place("parts", part))]
        return {int(n.split('=')[1]) for n in names if n.startswith(f"{_BUCKET}=")}

    def apply(self, batch: DataFrame, number: int, gone: Column | None = None) -> bool:
        """Takes in a batch of changes; ``gone`` marks deletes. False if a batch of this number or a later one is in already.

        Only buckets of the batch's keys are written: a part of the batch's own rows, or the whole bucket when its parts
        are too many.
        """
        there = self.versions()
        if there and there[-1][0] >= number:
            return False
        names = [c for c in self.schema.fieldNames() if c not in self.keys and c != self.order]
        marked = batch.withColumn("__gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        marked = marked.select(*self.keys, self.order, "__gone", *[F.when(~F.col("__gone"), F.col(c)).alias(c) for c in names]).withColumn(_BUCKET, self._bucket())
        parts = self._parts(there[-1]) if there else {}
        for bucket in self._write(self._last(marked), f"n={number}"):
            parts.setdefault(bucket, []).append(f"n={number}")
        full = {b: of for b, of in parts.items() if len(of) > self.most_parts}
        if full:
            self._write(self._last(self._read(full)), f"m={number}")
            parts |= {b: [f"m={number}"] for b in full}
        self._commit((number, 0), parts)
        return True

    def _live(self, parts: dict[int, list[str]]) -> DataFrame:
        """Buckets of one part need no merging: their keys differ."""
        whole = {b: of for b, of in parts.items() if len(of) == 1}
        merged = self._last(self._read({b: of for b, of in parts.items() if len(of) > 1}))
        columns = [_BUCKET, *self.stored.fieldNames()]
        return self._read(whole).select(columns).unionByName(merged.select(columns)).filter(~F.col("__gone")).select(*self.schema.fieldNames())

    def rows(self, number: int | None = None) -> DataFrame:
        """The rows of the newest commit, or those after an older batch that hasn't been cleared away."""
        return self._live(self.parts(number))

    def of_keys(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The rows of some keys. Only their buckets are read; the driver sees the buckets' numbers."""
        touched = {r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        rows = self._live({b: of for b, of in self.parts(number).items() if b in touched})
        return rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def compact(self, gone_before=None) -> None:
        """Merges every bucket into one part. Markers of deletes from before ``gone_before`` go."""
        there = self.versions()
        if not there:
            return
        number, step = there[-1]
        rows = self._last(self._read(self._parts(there[-1])))
        if gone_before is not None:
            rows = rows.filter(~(F.col("__gone") & (F.col(self.order) < F.lit(gone_before))))
        part = f"c={number}.{step + 1}"
        self._commit((number, step + 1), {b: [part] for b in self._write(rows, part)})

    def clear(self, keep: int = 2) -> None:
        """Deletes commits but the newest ``keep``, and parts that none of those names."""
        fs, place = self._files()
        there = self.versions()
        named = {p for v in there[-keep:] for of in self._parts(v).values() for p in of}
        for number, step in there[:-keep]:
            fs.delete(place("commits", f"{number}.{step}"), True)
        if fs.exists(place("parts")):
            for f in fs.listStatus(place("parts")):
                if f.getPath().getName() not in named:
                    fs.delete(f.getPath(), True)
