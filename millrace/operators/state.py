"""State changes: upserts, patches, feedback, decay, the outbox, moderation events and audits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import stored

# The operations that a plan may hold.
KNOWN_OPS = ("create_memory", "update_memory", "delete_memory", "create_skill", "update_skill", "delete_skill", "create_node", "update_node", "delete_node")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace those of the same key and raise the version; new ones begin at version 1."""
    fields = [c for c in current.columns if c not in (key, "version")]
    renamed = incoming.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = current.join(renamed, key, "full_outer")
    version = F.when(F.col("__new") & F.col("version").isNotNull(), F.col("version") + 1).otherwise(F.coalesce("version", F.lit(1)))
    return both.select(key, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields], version.cast("long").alias("version"))


def partial_update(current: DataFrame, patch: DataFrame, key: str, texts: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """Empty texts and numbers of 0 or less keep the old value."""
    renamed = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in (*texts, *numbers)])
    new = {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in texts}
    new |= {c: F.when(F.col(f"__{c}") > 0, F.col(f"__{c}")).otherwise(F.col(c)) for c in numbers}
    return current.join(renamed, key, "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in current.columns])


def delete_keys(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def _in_ranges(events: DataFrame, *columns: str) -> DataFrame:
    """Events dealt by ranges of (id, ts, event_id), so that an id with many events lies in several ranges, one after another."""
    return events.select("id", "ts", "event_id", *columns).repartitionByRange("id", "ts", "event_id")


def _moved(importance: Column, reward: Column, alpha: float) -> Column:
    return F.least(F.greatest(F.floor(importance + F.lit(alpha) * (reward - importance) + 0.5).cast("int"), F.lit(1)), F.lit(10))


def _composed(alpha: float):
    """Of each id in a sorted range: its first reward, and where the rewards after it take each importance from 1 to 10."""
    values = np.arange(1, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, ts, event_id, first reward, map, number) of the id that the next batch may go on with
        kinds = None

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "ts", "event_id", "first", "onto", "n"])

        for batch in batches:
            kinds = [*batch.schema.types[:3], pa.float64(), pa.list_(pa.int32()), pa.int64()]
            out = []
            ids, rewards = batch.column("id").to_pylist(), batch.column("reward").to_numpy(zero_copy_only=False)
            steps = np.clip(np.floor(values + alpha * (rewards[:, None] - values) + 0.5), 1, 10).astype(np.int32)
            for k, key in enumerate(ids):
                if held and held[0] == key:
                    held[4], held[5] = steps[k][held[4] - 1], held[5] + 1
                else:
                    if held:
                        out.append(held)
                    held = [key, batch.column("ts")[k].as_py(), batch.column("event_id")[k].as_py(), float(rewards[k]), values.astype(np.int32), 1]
            if out:
                yield made(out)
        if held:
            yield made([held])

    return run


def feedback_update(rows: DataFrame, feedback: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Each reward moves the importance half-way towards it, in order of time, between 1 and 10.

    What a stretch of rewards does to an importance is a map of ten values to ten after its first reward, and maps of
    stretches compose. So the events of an id are folded where they lie, and only one map of each range meets in a task.
    Events without a reward don't count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in feedback.schema}
    events = _in_ranges(feedback.filter("reward is not null").withColumn("reward", F.col("reward").cast("double")), "reward").sortWithinPartitions("id", "ts", "event_id", "reward")
    parts = events.mapInArrow(_composed(alpha), f"id {kinds['id']}, ts {kinds['ts']}, event_id {kinds['event_id']}, first double, onto array<int>, n long")
    # as many maps of an id as there are ranges at most; its own row comes first
    place = Window.partitionBy("id").orderBy("ts", "event_id")
    numbered = parts.withColumn("at", F.row_number().over(place))
    whole = numbered.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("at", F.struct("first", "onto")))).alias("maps"), F.sum("n").alias("n"))
    through = lambda v, x: F.element_at(x["onto"], _moved(v, x["first"], alpha))
    fold = F.aggregate(F.sequence(F.lit(1), F.size("maps")), F.col("importance").cast("int"), lambda v, at: through(v, F.element_at("maps", at)))
    return rows.join(whole, "id").select("id", fold.alias("importance"), F.col("n").cast("int").alias("feedback_count"))


def retrieval_decay(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Counts retrievals and feedback in order; every tenth retrieval without reward lets an importance over 3 sink.

    When an importance sinks depends on the counts before alone. Ranges of events are counted first, each range then
    counts on from those before it, and an id's importance sinks as often as its ranges found.
    """
    hit = F.col("kind") == "retrieval"
    part = stored(_in_ranges(events, "kind").withColumn("part", F.spark_partition_id()))
    counts = part.groupBy("id", "part").agg(F.count_if(hit).alias("got"), F.count_if(~hit).alias("fed"))
    earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("id", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("got", "fed")])
    running = Window.partitionBy("id", "part").orderBy("ts", "event_id", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got, fed = (F.col(f"{c}_before") + F.sum(F.when(k, 1).otherwise(0)).over(running) for c, k in (("got", hit), ("fed", ~hit)))
    idle = part.join(before, ["id", "part"]).withColumn("idle", got - 10 * fed)
    sinks = idle.groupBy("id").agg(F.count_if(hit & (F.col("idle") > 0) & (F.col("idle") % 10 == 0)).alias("sinks"), F.count_if(hit).alias("got"), F.count_if(~hit).alias("fed"))
    sunk = lambda v: F.when(v > 3, F.greatest(F.floor(v + F.lit(0.1) * (3 - v) + 0.5).cast("int"), F.lit(1))).otherwise(v)
    # an int of any size stands still after 256 steps of a tenth each
    fold = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(256)), 1, F.least("sinks", F.lit(256)).cast("int")), F.col("importance").cast("int"), lambda v, _: sunk(v))
    return rows.join(sinks, "id").select("id", fold.alias("importance"), F.col("got").cast("int").alias("retrieval_count"), F.col("fed").cast("int").alias("feedback_count"))


def outbox_backlog(outbox: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    """Due pending rows in order, with the state that a failure would give them."""
    due = outbox.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)).orderBy("id").limit(limit)
    retry = F.col("retry_count") + 1
    return due.select("id", "op_type", retry.alias("retry_count"), F.when(retry >= 8, "dead").otherwise("pending").alias("state"), F.pow(F.lit(2), F.least(F.lit(6), retry)).cast("int").alias("delay_s"))


def outbox_effects(outbox: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """The outbox after attempts (id, ok, error): done ones, failed ones that wait for their next attempt, and dead letters.

    A failed row waits 2^n seconds after its n-th attempt, for n up to 6, and is dead after eight; its error is cut to
    800 characters. Several results of one row count as one failure if one of them failed; without a result nothing changes.
    """
    tried = results.groupBy("id").agg(F.min("ok").alias("__ok"), F.max_by("error", ~F.col("ok")).alias("__error"))
    rows = outbox.join(tried, "id", "left")
    failed, retry = F.coalesce(~F.col("__ok"), F.lit(False)), F.col("retry_count") + 1
    wait = F.make_dt_interval(secs=F.pow(F.lit(2), F.least(F.lit(6), retry)))
    status = F.when(F.col("__ok"), "done").when(failed & (retry >= 8), "dead_letter").otherwise(F.col("status"))
    return rows.withColumns({
        "status": status, "retry_count": F.when(failed, retry).otherwise(F.col("retry_count")), "next_attempt_at": F.when(failed, as_of + wait).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(failed, F.substring("__error", 1, 800)),
    }).drop("__ok", "__error")


def outbox_counts(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count("*").alias("n"), F.max("retry_count").alias("most_retries"))


def cdc_latest_state(outbox: DataFrame) -> DataFrame:
    """The last operation of each entity; deleted ones are gone."""
    last = outbox.groupBy("entity_type", "entity_id").agg(F.max_by(F.struct("op_type", "payload"), "id").alias("x"), F.max("id").alias("id"))
    return last.filter("x.op_type <> 'delete'").select("entity_type", "entity_id", F.col("x.payload").alias("payload"), "id")


def payload_changes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """md5 of the payload, and whether it repeats the entity's one before."""
    rows = df.withColumn("payload_hash", F.md5(payload))
    before = F.lag("payload_hash").over(Window.partitionBy("entity_id").orderBy("id"))
    return rows.withColumn("noop", F.coalesce(before == F.col("payload_hash"), F.lit(False)))


def moderation_events(df: DataFrame, policy: str = "v1") -> DataFrame:
    needed = F.col("status") != "clean"
    return df.select(F.col("id").alias("entity_id"), F.col("status").alias("decision"), needed.alias("review_required"), F.when(needed, "pending").otherwise("auto_approved").alias("review_status"), F.lit(policy).alias("policy_version"))


def moderation_queue(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.filter("review_status = 'pending'").orderBy(F.desc("created_at"), "entity_id").limit(limit)


def moderation_review(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """The latest decision of each event makes it reviewed."""
    latest = reviews.groupBy("entity_id").agg(F.max_by("reviewer_decision", "reviewed_at").alias("reviewer_decision"))
    done = F.col("reviewer_decision").isNotNull()
    return events.join(latest, "entity_id", "left").withColumn("review_status", F.when(done, "reviewed").otherwise(F.col("review_status")))


def audit_trail(df: DataFrame, action: str, actor: str) -> DataFrame:
    return df.select(F.lit(action).alias("action"), F.lit(actor).alias("actor"), F.col("id").alias("entity_id"), F.to_json(F.struct("id")).alias("details"))


def has_content(column: str) -> Column:
    """Whether a text holds anything but spaces of whatever width; line ends and tabs are content, as for SQL's trim."""
    return F.coalesce(F.col(column).rlike(r"\P{Zs}"), F.lit(False))


def create_with_rules(df: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with defaults, and rejected ones: without content, or rejected by moderation."""
    rows = df.withColumn("moderation_status", status)
    ok = has_content("content") & (F.col("moderation_status") != "reject_hard")
    defaults = {"importance": F.when(F.coalesce("importance", F.lit(0)) <= 0, 1).otherwise(F.col("importance")), "category": F.coalesce(F.nullif("category", F.lit("")), F.lit("observation")), "owner": F.coalesce(F.nullif("owner", F.lit("")), F.lit("agent"))}
    return rows.filter(ok).withColumns(defaults), rows.filter(~ok)


def mutation_plan_filter(ops: DataFrame, max_ops: int) -> DataFrame:
    """Known operations with a description, the first few of each plan."""
    good = ops.filter(F.col("op").isin(*KNOWN_OPS) & (F.trim("description") != ""))
    place = F.row_number().over(Window.partitionBy("plan").orderBy("pos"))
    return good.withColumn("place", place).filter(F.col("place") <= max_ops).drop("place")


def apply_mutations(rows: DataFrame, ops: DataFrame, key: str = "id") -> DataFrame:
    """create, update and delete operations (id, op, content, pos) on (id, content): the last one of a key wins."""
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", "content"), "pos").alias("x"))
    both = rows.join(last, key, "full_outer")
    keep = F.coalesce(F.col("x.op") != "delete", F.lit(True)) & (F.col("content").isNotNull() | F.coalesce(F.col("x.op") == "create", F.lit(False)))
    return both.filter(keep).select(key, F.coalesce(F.nullif(F.col("x.content"), F.lit("")), F.col("content")).alias("content"))


def apply_dedup_decisions(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Memories (id, content, created_at, ...) after decisions (memory_id, candidate_id, action, merged_content).

    MERGE gives the newer one the merged text, unless that is blank, and removes the older one; CONTRADICTION removes
    the older one. Of equal age the memory is the older one. Several texts for one row: the one of the largest pair of
    ids; a removed row stays removed.
    """
    ages = memories.select(F.col("id").alias("memory_id"), F.col("created_at").alias("m_at"))
    others = memories.select(F.col("id").alias("candidate_id"), F.col("created_at").alias("c_at"))
    rows = decisions.join(ages, "memory_id").join(others, "candidate_id")
    candidate_first = F.col("c_at") < F.col("m_at")
    rows = rows.select(
        "action", "merged_content", F.struct("memory_id", "candidate_id").alias("pair"), F.when(candidate_first, F.col("candidate_id")).otherwise(F.col("memory_id")).alias("older"),
        F.when(candidate_first, F.col("memory_id")).otherwise(F.col("candidate_id")).alias("newer"),
    )
    merged = rows.filter("action = 'MERGE' and trim(coalesce(merged_content, '')) <> ''")
    gone = merged.select(F.col("older").alias("id")).union(rows.filter("action = 'CONTRADICTION'").select("older")).distinct()
    texts = merged.groupBy(F.col("newer").alias("id")).agg(F.max_by("merged_content", "pair").alias("__text"))
    return memories.join(gone, "id", "left_anti").join(texts, "id", "left").withColumn("content", F.coalesce("__text", "content")).drop("__text")
