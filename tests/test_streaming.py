"""Streams read to their end give what the batch operators give."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import history, sessions, state, web
from millrace.sources.views import view
from millrace.streaming import jobs


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def as_stream(spark, df, path, files=2):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def collected(stream, path, mode="append"):
    out = []

    def keep(batch, number):
        out.extend(batch.collect())

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()
    return out


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"command": "curl -u me:pw https://example.org/a/rather/long/path", "project": "p", "timestamp": "2024-01-01T00:00:00Z", "output": "ok"}, {"command": "echo done with it all", "project": "p", "timestamp": "2024-01-01T00:00:00Z", "output": "the secret is aB3dE5gH7jK9mN1pQ2sT4vX6 in a long line of words that are not"}, {"command": "vault kv get x", "project": "p", "timestamp": "2024-01-01T00:00:00Z"}]
    (tmp_path / "in/a.json").write_text("\n".join([*map(json.dumps, rows), "{bad"]))
    jobs.stream_redact_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.command, r.output) for r in got} == {
        ("curl -u [REDACTED:basic_auth] https://example.org/a/rather/long/path", "ok"),
        ("echo done with it all", "the secret is [REDACTED:high_entropy] in a long line of words that are not"),
    }
    assert {r.importance for r in got} == {5}


def test_ingest_keeps_hollow_outputs_and_finds_projects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    token = "aB3dE5gH7jK9mN1pQ2sT4vX6"
    record = lambda **r: json.dumps({"command": "make all of it now", "timestamp": "2024-01-01T00:00:00Z", **r})
    (tmp_path / "in/a.json").write_text("\n".join([record(cwd="/w/app/src", output=f"{token} {token[::-1]}"), record(cwd="/tmp/deep"), "{bad", record(cwd="/w/app", project="own")]))
    (tmp_path / "in/b.json").write_text("\n".join([record(cwd="/w/app", project="given"), "[]", record(project="after")]))
    markers = spark.createDataFrame([("/w/app", "git")], "root string, marker string")
    jobs.stream_redact_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), markers, ends_at_bad_line=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.project, r.output or "") for r in got) == [("app", "[REDACTED:damage_cap]"), ("deep", ""), ("given", "")]
    assert {r.importance for r in got} == {5} and {str(r.day) for r in got} == {"2024-01-01"}


def test_a_batch_is_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", None), ("b", None, 7)], "command string, project string, importance int").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    for batch in (0, 1, 1, 0):  # a restart between write and commit sends a batch again
        jobs.append_history(rows, str(tmp_path / "h"), batch)
    got = spark.read.parquet(str(tmp_path / "h"))
    assert sorted((r.batch, r.command, r.importance) for r in got.collect()) == [(0, "a", 5), (0, "b", 7), (1, "a", 5), (1, "b", 7)]


def test_projector(spark, sf, tmp_path):
    box = view(spark, sf, "outbox_v")
    jobs.stream_projector(as_stream(spark, box.repartition(3), tmp_path / "in", 3), str(tmp_path / "i"), str(tmp_path / "c"), buckets=4, most_parts=2).awaitTermination()
    index = jobs.index_table(spark, str(tmp_path / "i"), 4, 2)
    assert len(index.versions()) == 3 and max(map(len, index.parts().values())) <= 2
    want = state.cdc_latest_state(box).selectExpr("entity_type", "cast(entity_id as string)", "payload", "id")
    assert sorted(index.rows().collect()) == sorted(want.collect()) and want.count() > 0


def test_minute_dedup(spark, sf, tmp_path):
    pages = view(spark, sf, "sessions_v").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    got = collected(jobs.stream_minute_dedup(as_stream(spark, twice, tmp_path / "in")), tmp_path / "c")
    assert len(got) == web.minute_dedup(twice).count()


def test_feedback(spark, sf, tmp_path):
    rows = view(spark, sf, "feedback_v").join(view(spark, sf, "memories_v").select("id", F.col("importance").alias("start")), "id").withColumn("ts", F.col("ts").cast("timestamp"))
    only = rows.filter("kind = 'feedback'")
    got = collected(jobs.stream_feedback(as_stream(spark, only.coalesce(1), tmp_path / "in", 1)), tmp_path / "c", "update")
    want = state.feedback_update(view(spark, sf, "memories_v").select("id", "importance"), only).collect()
    assert {(r.id, r.importance, r.feedback_count) for r in got} == {tuple(r) for r in want}


def test_stuck(spark, sf, tmp_path):
    calls = view(spark, sf, "calls_v").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    got = collected(jobs.stream_stuck_detector(as_stream(spark, calls, tmp_path / "in", 1)), tmp_path / "c", "update")
    assert {r.actor: r.verdict for r in got} == {r.actor: r.verdict for r in history.stuck_runs(calls).collect()}


def page_rows():
    rng = random.Random(3)
    prints = [rng.getrandbits(63) for _ in range(12)]
    return [(n % 3, n, rng.choice("abcdefgh"), n // 4, prints[rng.randrange(12)] ^ (1 << rng.randrange(60)), rng.choice([1, 10, 400])) for n in range(150)]


PAGE = "session_id long, page_id long, url string, ts long, simhash long, bytes long"


def by_hand(rows, max_pages, max_bytes, max_bits=3):
    events = []
    for session in sorted({r[0] for r in rows}):
        held, seq = [], 0  # [url, page, print, revision, bytes]
        for _, page, url, _, print_, size in sorted((r for r in rows if r[0] == session), key=lambda r: (r[3], r[1])):
            old = [h for h in held if h[0] == url]
            near = [h for h in (old or held) if bin(h[2] ^ print_).count("1") <= max_bits]
            made = []
            if near:
                made.append((page, url, "duplicate", 0))
            elif old:
                old[0][1:] = [page, print_, old[0][3] + 1, size]
                made.append((page, url, "updated", old[0][3]))
            else:
                held.append([url, page, print_, 1, size])
                made.append((page, url, "added", 1))
                while held and (len(held) > max_pages or sum(h[4] for h in held) > max_bytes):
                    gone = held.pop(0)
                    made.append((gone[1], gone[0], "evicted", gone[3]))
            for e in made:
                seq += 1
                events.append((session, *e, seq))
    return sorted(events)


def test_page_sessions(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), PAGE)
    want = by_hand(page_rows(), 4, 900)
    assert {e[3] for e in want} == {"added", "updated", "duplicate", "evicted"}
    assert sorted(map(tuple, sessions.session_events(df.repartition(5), 4, 900).collect())) == want
    ordered = df.orderBy("ts", "page_id").coalesce(1)
    ordered.filter("ts < 20").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = collected(jobs.stream_page_session(stream, 4, 900), tmp_path / "c")
    ordered.filter("ts >= 20").write.mode("append").parquet(str(tmp_path / "in"))
    got += collected(jobs.stream_page_session(stream, 4, 900), tmp_path / "c")
    assert sorted(map(tuple, got)) == want


def test_open_pages_and_navigation(spark):
    df = spark.createDataFrame(page_rows() + [(None, 900, "a", 1, None, None), (1, 901, None, 1, 1, 1)], PAGE)
    events = sessions.session_events(df, 4, 900)
    want = by_hand(page_rows(), 4, 900)
    held = {}
    for session, page, url, action, revision, _ in sorted(want, key=lambda e: (e[0], e[5])):
        if action == "evicted":
            del held[session, url]
        elif action != "duplicate":
            held[session, url] = (page, revision)
    assert {(r.session_id, r.url): (r.page_id, r.revision) for r in sessions.open_pages(events).filter("session_id is not null").collect()} == held
    added = [e for e in sorted(want, key=lambda e: (e[0], e[5])) if e[3] == "added"]
    steps = sessions.navigation(events).filter("session_id = 1").orderBy("seq").collect()
    assert [r.url for r in steps] == [e[2] for e in added if e[0] == 1] and [r.referrer for r in steps] == [None, *[r.url for r in steps][:-1]]
    assert sessions.session_events(df.limit(0)).count() == 0


def test_idle_sessions_go(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep a stream that reads to its end going
    page = lambda session, page, ts: spark.createDataFrame([(session, page, "a", ts, 7 * session, 1)], PAGE).coalesce(1)
    actions, kept = [], []
    for batch in (page(1, 1, 1), page(2, 2, 2), page(1, 3, 3)):
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PAGE).parquet(str(tmp_path / "in"))
        actions += [(r.page_id, r.action) for r in collected(jobs.stream_page_session(stream, idle_ms=1500), tmp_path / "c")]
        kept.append({r.key[0] for r in spark.read.format("statestore").option("stateVarName", "count").load(str(tmp_path / "c")).select("key").collect()})
        time.sleep(2)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert actions == [(1, "added"), (2, "added"), (3, "added")] and kept == [{1}, {2}, {1}]


def test_file_changes(spark, tmp_path):
    schema = "path string, fingerprint int, content_hash string, seq long"
    seen = {}
    for rows in ([("a", 1, "x", 1), ("b", 1, "y", 1), ("a", 2, "x", 2)], [("a", 3, "x", 3), ("b", 2, "z", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_file_changes(stream, str(tmp_path / "s"), str(tmp_path / "c"), lambda d, n: seen.update({n: {r.path: r.status for r in d.collect()}}), buckets=8).awaitTermination()
    assert seen == {0: {"a": "new", "b": "new"}, 1: {"a": "touched", "b": "changed"}}


def test_file_changes_settle(spark, tmp_path):
    schema = "path string, fingerprint int, content_hash string, seq long, ts timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s // 10, s % 10 * 100_000)
    changes = [("a", 1, "x", 1, at(0)), ("a", 2, "y", 2, at(3)), ("b", 1, "z", 3, at(4)), ("a", 3, "u", 4, at(30)), ("c", 1, "w", 5, at(200))]
    out = []
    for row in changes:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_file_changes(stream, str(tmp_path / "s"), str(tmp_path / "c"), lambda d, n: out.extend((r.path, r.status) for r in d.collect()), "'0.5' SECOND").awaitTermination()
    assert sorted(out) == [("a", "changed"), ("a", "new"), ("b", "new")]  # two changes of a within the window were one


def test_windows(spark, sf, tmp_path):
    shell = view(spark, sf, "shell_v").select("command", "exit_code", "duration_ms", F.col("created_at").cast("timestamp").alias("ts"))
    total = shell.count()
    got = collected(jobs.stream_shell_windows(as_stream(spark, shell, tmp_path / "in", 1), "1 day", "60 days"), tmp_path / "c", "complete")
    assert sum(r.n for r in got) == total
