"""Structured Streaming forms of the library's operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions import redact
from millrace.operators import history
from millrace.operators.sessions import EVENT, OpenPages
from millrace.sources.keyed import KeyedTable

RECORD = "command string, exit_code int, duration_ms int, cwd string, timestamp timestamp, project string, output string"


def read_records(spark: SparkSession, path: str, ends_at_bad_line: bool = False) -> DataFrame:
    """Newline-delimited JSON shell records; a line that doesn't parse keeps its text in _corrupt_record.

    Each file is a connection. With ``ends_at_bad_line`` its first bad line ends it: that line and those after it are not
    read. A file is then read as one row, so it has to fit in a task.
    """
    parse = lambda line: F.from_json(line, f"{RECORD}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    if not ends_at_bad_line:
        return spark.readStream.text(path).select(parse("value").alias("r")).select("r.*")
    whole = spark.readStream.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    bad = F.array_position(F.transform(lines, lambda line: F.coalesce(F.try_parse_json(line).isNull() | ~F.trim(line).startswith("{"), F.lit(True))), True)
    good = F.when(bad > 0, F.slice(lines, F.lit(1), (bad - 1).cast("int"))).otherwise(lines)
    return whole.select(F.explode(good).alias("line")).select(parse("line").alias("r")).select("r.*")


def redacted(records: DataFrame) -> DataFrame:
    """Commands and outputs through all layers of redaction. A record whose command that hollows out goes; an output gives way to a marker."""
    rows = records.filter("_corrupt_record is null and command is not null")
    rows = redact.redact_pipeline(rows, "command", command=True).filter(~F.col("dropped")).drop("dropped", "embedding_safe")
    return redact.redact_pipeline(rows, "output").drop("dropped", "embedding_safe")


def append_history(rows: DataFrame, path: str, batch: int, importance: int = 5) -> None:
    """Appends shell records (project, timestamp, ...) as one batch of the history, with an importance where they have none.

    Each batch number counts once: a batch that is written again takes its own place. Readers of ``path`` get the columns
    batch, project and day with the rows; records without a project or a time lie in Spark's default partition.
    """
    given = F.coalesce(F.col("importance"), F.lit(importance)) if "importance" in rows.columns else F.lit(importance)
    dated = rows.withColumn("importance", given.cast("int")).withColumn("day", F.to_date("timestamp"))
    dated.write.mode("overwrite").partitionBy("project", "day").parquet(f"{path}/batch={batch}")


def stream_redact_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, markers: DataFrame | None = None, ends_at_bad_line: bool = False) -> StreamingQuery:
    """Shell records, redacted, to a history. A record without a project gets that of its folder, by ``markers`` (root, marker) and as ``history.resolve_project`` finds it."""

    def take(batch: DataFrame, number: int) -> None:
        rows = batch
        if markers is not None:
            found = history.resolve_project(batch.drop("project").filter("cwd is not null").select("cwd").distinct(), markers).withColumnRenamed("project", "__found")
            rows = batch.join(found, "cwd", "left").withColumn("project", F.coalesce(F.nullif("project", F.lit("")), "__found")).drop("__found")
        append_history(rows, sink, number)

    rows = redacted(read_records(spark, source, ends_at_bad_line))
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


OUTBOX = "entity_type string, entity_id string, payload string, id long"


def index_table(spark: SparkSession, path: str, buckets: int = 64, most_parts: int = 8) -> KeyedTable:
    """The index that a projector keeps: the latest payload of each entity by the id of its last operation."""
    return KeyedTable(spark, path, OUTBOX, ["entity_type", "entity_id"], "id", buckets, most_parts)


def project(index: KeyedTable, operations: DataFrame, number: int) -> bool:
    """Takes a batch of outbox operations into the index. Each batch number counts once; operations may come in any order."""
    rows = operations.select("entity_type", F.col("entity_id").cast("string").alias("entity_id"), "payload", F.col("id").cast("long").alias("id"), "op_type")
    return index.apply(rows, number, F.col("op_type") == "delete")


def stream_projector(outbox: DataFrame, index_path: str, checkpoint: str, buckets: int = 64, most_parts: int = 8, every: str | None = None) -> StreamingQuery:
    """Keeps the latest state of each entity. A batch writes the buckets of its own keys only.

    ``every`` is the time between batches, such as "3 seconds"; without it the stream ends with what is there.
    """

    def merge(batch: DataFrame, number: int) -> None:
        project(index_table(batch.sparkSession, index_path, buckets, most_parts), batch, number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return outbox.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Expiring(StatefulProcessor):
    """State that goes when a key has been idle for so many milliseconds of the machine's clock; never, if that is 0.

    Timers keep a stream going: with an idle time its trigger has to be a processing time, not all that is available now.
    """

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def watch(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.idle_ms:
            self.until = handle.getValueState("until", "at long")

    def touch(self, timerValues) -> None:
        """Sets the timer anew. State whose time is up before its timer has fired goes now."""
        if self.idle_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            if self.until.exists():
                (old,) = self.until.get()
                if old <= now:
                    self.forget()
                self.handle.deleteTimer(old)
            self.until.update((now + self.idle_ms,))
            self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.forget()
            self.until.clear()
        yield from ()

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _mode(idle_ms: int) -> str:
    return "ProcessingTime" if idle_ms else "None"


class PageSessions(Expiring):
    """Per session: the pages that it holds, in the order in which they came first."""

    def __init__(self, max_pages: int = 100, max_bytes: int = 8 << 20, max_bits: int = 3, idle_ms: int = 0):
        super().__init__(idle_ms)
        self.bounds = max_pages, max_bytes, max_bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch(handle)
        self.pages = handle.getMapState("pages", "url string", "page_id long, print long, revision int, bytes long, at long")
        self.count = handle.getValueState("count", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.touch(timerValues)
        seq = self.count.get()[0] if self.count.exists() else 0
        held = sorted(((k[0], v) for k, v in self.pages.iterator()), key=lambda x: x[1][4])
        places = {url: v[4] for url, v in held}
        before = {url: tuple(map(int, v[:4])) for url, v in held}
        open_ = OpenPages(before.items(), seq, *self.bounds)
        arrived = pd.concat(list(rows)).sort_values(["ts", "page_id"])
        sizes = arrived["bytes"].fillna(0) if "bytes" in arrived else [0] * len(arrived)
        events = []
        for page_id, url, print_, size in zip(arrived["page_id"], arrived["url"], arrived["simhash"], sizes):
            made = open_.add(int(page_id), url, int(print_), int(size))
            if made[0][2] == "added":
                places[url] = made[0][4]
            events += made
        for url in before.keys() - open_.held.keys():
            self.pages.removeKey((url,))
        for url, page in open_.held.items():
            if before.get(url) != page:
                self.pages.updateValue((url,), (*page, places[url]))
        self.count.update((open_.seq,))
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["session_id", "page_id", "url", "action", "revision", "seq"]).astype({"revision": "int32"})

    def forget(self) -> None:
        self.pages.clear()
        self.count.clear()


def stream_page_session(pages: DataFrame, max_pages: int = 100, max_bytes: int = 8 << 20, idle_ms: int = 0) -> DataFrame:
    """(session_id, page_id, url, ts, simhash, bytes if there) to the events of each session, as ``sessions.session_events`` has them.

    A session without pages for ``idle_ms`` milliseconds begins anew; 0 keeps all. A null fingerprint is not allowed here.
    """
    return pages.groupBy("session_id").transformWithStateInPandas(PageSessions(max_pages, max_bytes, 3, idle_ms), outputStructType=f"session_id long, {EVENT}", outputMode="Append", timeMode=_mode(idle_ms))


class Importance(StatefulProcessor):
    """Per id: importance that feedback moves and idle retrievals let sink; emitted after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "importance int, got int, fed int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        imp, got, fed = self.value.get() if self.value.exists() else (int(arrived["start"].iloc[0]), 0, 0)
        for kind, reward in zip(arrived["kind"], arrived["reward"]):
            if kind == "feedback":
                fed += 1
                imp = min(10, max(1, int(imp + 0.5 * (reward - imp) + 0.5)))
            else:
                got += 1
                idle = got - 10 * fed
                if imp > 3 and idle > 0 and idle % 10 == 0:
                    imp = max(1, int(imp + 0.1 * (3 - imp) + 0.5))
        self.value.update((int(imp), int(got), int(fed)))
        yield pd.DataFrame({"id": [key[0]], "importance": [imp], "retrieval_count": [got], "feedback_count": [fed]}).astype({"importance": "int32", "retrieval_count": "int32", "feedback_count": "int32"})

    def close(self) -> None:
        pass


def stream_feedback(events: DataFrame) -> DataFrame:
    """(id, ts, event_id, kind, reward, start) to the importance after each batch."""
    schema = "id string, importance int, retrieval_count int, feedback_count int"
    return events.groupBy("id").transformWithStateInPandas(Importance(), outputStructType=schema, outputMode="Update", timeMode="None")


class Stuck(Expiring):
    """Per actor: its last calls, by tool and a hash of their arguments where rows have one, and the verdict on them; a call of reset clears them."""

    def __init__(self, window: int = 20, idle_ms: int = 0):
        super().__init__(idle_ms)
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch(handle)
        self.calls = handle.getListState("calls", "tool string")

    @staticmethod
    def verdict(calls: list[str]) -> str:
        run = next((k for k, c in enumerate(reversed(calls)) if c != calls[-1]), len(calls))
        if run >= 4:
            return "stop" if run >= 8 else "nudge"
        if len(calls) >= 6 and calls[-1] != calls[-2]:
            backwards = calls[::-1]
            steps = next((k for k, c in enumerate(backwards) if c != backwards[k % 2]), len(calls))
            steps -= steps % 2
            if steps >= 6:
                return "stop" if steps >= 8 else "nudge"
        return "ok"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.touch(timerValues)
        calls = [c[0] for c in self.calls.get()]
        arrived = pd.concat(list(rows)).sort_values("seq")
        arguments = arrived["args_hash"].fillna("") if "args_hash" in arrived else [""] * len(arrived)
        for tool, hashed in zip(arrived["tool"], arguments):
            calls = [] if tool == "reset" else [*calls, f"{tool} {hashed}"][-self.window :]
        self.calls.put([(c,) for c in calls])
        yield pd.DataFrame({"actor": [key[0]], "verdict": [self.verdict(calls) if calls else "ok"]})

    def forget(self) -> None:
        self.calls.clear()


def stream_stuck_detector(calls: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The verdict of each actor after each batch. An actor without calls for ``idle_ms`` milliseconds begins anew; 0 keeps all."""
    return calls.groupBy("actor").transformWithStateInPandas(Stuck(idle_ms=idle_ms), outputStructType="actor long, verdict string", outputMode="Update", timeMode=_mode(idle_ms))


def stream_minute_dedup(pages: DataFrame, lateness: str = "2 minutes") -> DataFrame:
    """One page for each (url, content, minute)."""
    rows = pages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.withColumn("minute", F.date_trunc("minute", "ts")).withColumn("content", F.sha1("html")).dropDuplicatesWithinWatermark(["url", "content", "minute"])


class Settled(StatefulProcessor):
    """Per path: its latest change, put out when no further one has come for the window, on the clock of the changes."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "fingerprint int, content_hash string, seq long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["ts", "seq"])
        state, out = None, []
        if self.last.exists():
            state = self.last.get()
            self.handle.deleteTimer(state[3])
        for fingerprint, content_hash, seq, ts in zip(arrived["fingerprint"], arrived["content_hash"], arrived["seq"], arrived["ts"]):
            at = int(ts.timestamp() * 1000)
            if state and at >= state[3]:  # it was quiet before this change
                out.append(state[:3])
                state = None
            state = (*max((int(fingerprint), content_hash, int(seq)), tuple(state[:3]) if state else (0, "", -1), key=lambda x: x[2]), max(at + self.window_ms, state[3] if state else 0))
        self.last.update(state)
        self.handle.registerTimer(state[3])
        if out:
            yield self.settled(key, out)

    @staticmethod
    def settled(key, changes: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in changes], columns=["path", "fingerprint", "content_hash", "seq"]).astype({"fingerprint": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        self.last.clear()
        yield self.settled(key, [state[:3]])

    def close(self) -> None:
        pass


SNAPSHOT = "path string, fingerprint int, content_hash string, seq long"


def settled_changes(files: DataFrame, window: str, lateness: str = "0 seconds") -> DataFrame:
    """(path, fingerprint, content_hash, seq, ts timestamp): changes of a path that follow each other within the window are one."""
    millis = int(files.sparkSession.sql(f"SELECT CAST(INTERVAL {window} AS INTERVAL DAY TO SECOND) AS w").first()["w"].total_seconds() * 1000)
    rows = files.withWatermark("ts", lateness).select("path", "fingerprint", "content_hash", F.col("seq").cast("long").alias("seq"), "ts")
    return rows.groupBy("path").transformWithStateInPandas(Settled(millis), outputStructType=SNAPSHOT, outputMode="Append", timeMode="EventTime")


def stream_file_changes(files: DataFrame, snapshot_path: str, checkpoint: str, seen: Callable[[DataFrame, int], None], window: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Each batch of (path, fingerprint, content_hash, seq) against the snapshot that batches build up.

    A batch reads and writes the buckets of its own paths only. With ``window``, such as "'500' MILLISECOND", changes have
    a timestamp ``ts`` and a path is compared when it has been quiet for that long. ``seen`` gets the differences before
    the snapshot takes them in, so that a batch that is done again gives the same ones.
    """

    def step(batch: DataFrame, number: int) -> None:
        snapshot = KeyedTable(batch.sparkSession, snapshot_path, SNAPSHOT, ["path"], "seq", buckets)
        latest = batch.groupBy("path").agg(F.max_by(F.struct("fingerprint", "content_hash", "seq"), "seq").alias("x")).select("path", "x.fingerprint", "x.content_hash", F.col("x.seq").cast("long").alias("seq"))
        there = [v[0] for v in snapshot.versions() if v[0] < number]
        before = snapshot.of_keys(latest, there[-1] if there else None) if there or not snapshot.versions() else latest.limit(0)
        seen(history.incremental_diff(latest, before), number)
        snapshot.apply(latest, number)

    rows = settled_changes(files, window) if window else files
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_shell_windows(stream: DataFrame, window: str, lateness: str, slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Runs, mean duration and share of good ends per window and command: tumbling, sliding, or sessions with a gap."""
    rows = stream.withWatermark("ts", lateness)
    by: Column = F.session_window("ts", gap) if gap else F.window("ts", window, slide) if slide else F.window("ts", window)
    stats = (F.count("*").alias("n"), F.floor(F.avg("duration_ms")).cast("long").alias("avg_ms"), F.avg(F.when(F.col("exit_code") == 0, 1.0).otherwise(0.0)).alias("success"))
    return rows.groupBy(by.alias("w"), "command").agg(*stats)


