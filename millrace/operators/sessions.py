"""Browsing sessions page by page: updates, near-duplicates and eviction, in batch and as a stream's state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields of an event besides the session.
EVENT = "page_id long, url string, action string, revision int, seq long"


class OpenPages:
    """The pages that a session holds, oldest first: url to (page_id, fingerprint, revision, bytes).

    A page of an address that is held replaces it with the next revision, in the same place, unless their fingerprints
    are alike. A page of a new address goes if it is like one that is held; else it is added, and the oldest go until
    number and bytes are within their bounds, the new page too if it alone is too large.
    """

    def __init__(self, held: Iterable[tuple[str, tuple[int, int, int, int]]] = (), seq: int = 0, max_pages: int = 100, max_bytes: int = 8 << 20, max_bits: int = 3):
        self.held, self.seq = dict(held), seq
        self.max_pages, self.max_bytes, self.max_bits = max_pages, max_bytes, max_bits
        self.bytes = sum(v[3] for v in self.held.values())

    def _alike(self, a: int, b: int) -> bool:
        return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= self.max_bits

    def add(self, page_id: int, url: str, print_: int, size: int) -> list[tuple[int, str, str, int, int]]:
        """The events of one more page: duplicate, updated or added, and evicted ones."""
        old = self.held.get(url)
        if self.max_bits >= 0 and (self._alike(old[1], print_) if old else any(self._alike(v[1], print_) for v in self.held.values())):
            return [self._event(page_id, url, "duplicate", 0)]
        revision = old[2] + 1 if old else 1
        self.held[url] = (page_id, print_, revision, size)
        self.bytes += size - (old[3] if old else 0)
        events = [self._event(page_id, url, "updated" if old else "added", revision)]
        while not old and self.held and (len(self.held) > self.max_pages or self.bytes > self.max_bytes):
            gone = next(iter(self.held))
            page = self.held.pop(gone)
            self.bytes -= page[3]
            events.append(self._event(page[0], gone, "evicted", page[2]))
        return events

    def _event(self, page_id: int, url: str, action: str, revision: int) -> tuple[int, str, str, int, int]:
        self.seq += 1
        return page_id, url, action, revision, self.seq


def session_events(pages: DataFrame, max_pages: int = 100, max_bytes: int = 8 << 20, max_bits: int = 3) -> DataFrame:
    """(session_id, page_id, url, ts, simhash, bytes) to the events of each session, in order of time and page.

    Pages are sorted by session and time and read as they come, so a session of any length takes the memory of its open
    pages. A null fingerprint counts as 0, null bytes too; pages without an address go.
    """
    kind = pages.schema["session_id"].dataType.simpleString()
    columns = ["session_id", "page_id", "url", "simhash", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, open_, started = None, OpenPages((), 0, max_pages, max_bytes, max_bits), False
        for batch in batches:
            of, out = [], []
            for key, page_id, url, print_, size in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if not started or key != session:
                    session, started, open_ = key, True, OpenPages((), 0, max_pages, max_bytes, max_bits)
                events = open_.add(page_id, url, print_ or 0, size or 0)
                out += events
                of += [key] * len(events)
            made = [pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(of, batch.schema.field("session_id").type), made[0].cast(pa.int64()), *made[1:3], made[3].cast(pa.int32()), made[4].cast(pa.int64())], names=["session_id", "page_id", "url", "action", "revision", "seq"])

    rows = pages.filter("url is not null").select("session_id", F.col("page_id").cast("long").alias("page_id"), "url", F.col("simhash").cast("long").alias("simhash"), F.col("bytes").cast("long").alias("bytes"), "ts")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "ts", "page_id").mapInArrow(run, f"session_id {kind}, {EVENT}")


def open_pages(events: DataFrame) -> DataFrame:
    """The pages that each session holds at its end."""
    last = events.filter("action <> 'duplicate'").groupBy("session_id", "url").agg(F.max_by(F.struct("page_id", "revision", "action"), "seq").alias("x"))
    return last.filter("x.action <> 'evicted'").select("session_id", "url", "x.page_id", "x.revision")


def navigation(events: DataFrame) -> DataFrame:
    """Newly added pages in order, with the address before as referrer."""
    order = Window.partitionBy("session_id").orderBy("at")
    return events.filter("action = 'added'").withColumnRenamed("seq", "at").select("session_id", "page_id", F.row_number().over(order).alias("seq"), "url", F.lag("url").over(order).alias("referrer"))
