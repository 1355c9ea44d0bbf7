"""Session capture: hook events to committed turns, as a stream and as its batch twin, and coalesced event logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 24 * 3600
COMMITTED = "session_id bigint, commit_id bigint, event_id bigint, kind string, place bigint"


def committed_turns(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(session_id, commit_id, event_id, kind, place): turns that a stop commits, in order, the stop itself last.

    prompt and tool events wait; stop commits what waits, discard drops it; what waited longer than ttl seconds is dropped.
    events: (session_id, event_id, ts, kind).
    """
    ahead = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    ends = F.col("kind").isin("stop", "discard")
    rows = events.where(F.col("kind").isin("prompt", "tool", "stop", "discard")).withColumn("_end", F.first(F.when(ends, F.struct("event_id", "kind", "ts")), ignorenulls=True).over(ahead))
    rows = rows.where(F.col("_end.kind") == "stop").where(F.col("_end.ts").cast("double") - F.col("ts").cast("double") <= ttl)
    place = F.row_number().over(Window.partitionBy("session_id", "_end.event_id").orderBy("ts", "event_id")).cast("long")
    return rows.select("session_id", F.col("_end.event_id").alias("commit_id"), "event_id", "kind", place.alias("place"))


def expired_turns(events: DataFrame, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    """(session_id, event_id): waiting turns that are older than ttl at as_of and that no stop or discard has met."""
    ahead = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    rows = events.withColumn("_ends", F.max(F.col("kind").isin("stop", "discard").cast("int")).over(ahead))
    return rows.where(F.col("kind").isin("prompt", "tool") & (F.col("_ends") == 0) & (F.lit(as_of).cast("timestamp").cast("double") - F.col("ts").cast("double") > ttl)).select("session_id", "event_id")


def stream_committed_turns(events: DataFrame, ttl: int = TTL_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """committed_turns over a stream: waiting turns are state, which an event-time timer clears after ttl."""

    def step(key, frames, state: GroupState):
        waiting = list(zip(*state.get)) if state.exists and not state.hasTimedOut else []
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for e in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
            now = e.ts.timestamp()
            if e.kind in ("prompt", "tool"):
                waiting.append((int(e.event_id), e.kind, now))
            elif e.kind == "stop":
                live = [(i, k) for i, k, t in waiting if now - t <= ttl] + [(int(e.event_id), "stop")]
                out += [(key[0], int(e.event_id), i, k, n + 1) for n, (i, k) in enumerate(live)]
                waiting = []
            elif e.kind == "discard":
                waiting = []
        if waiting:
            state.update(tuple(list(x) for x in zip(*waiting)))
            last = int(max(t for _, _, t in waiting) * 1000) + ttl * 1000
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "commit_id", "event_id", "kind", "place"])

    rows = events.select("session_id", "event_id", "ts", "kind").withWatermark("ts", watermark)
    return rows.groupBy("session_id").applyInPandasWithState(step, COMMITTED, "ids array<bigint>, kinds array<string>, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced(events: DataFrame, group: str = "session_id", kind: str = "kind") -> DataFrame:
    """(group, island, kind, n, first_id, last_id): runs of consecutive events of one kind, as one record with a count."""
    w = Window.partitionBy(group).orderBy("ts", "event_id")
    rows = events.withColumn("_new", F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("long"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "island", kind).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def stream_new_content(docs: DataFrame, time_col: str, text_col: str, watermark: str = "1 day") -> DataFrame:
    """A stream of documents without those whose text has come within the watermark."""
    return docs.withColumn("content_hash", F.sha2(text_col, 256)).withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["content_hash"])


def ingest_batches(stream: DataFrame, target: str, key: list[str]):
    """Starts a query that appends to a Parquet table the rows whose key it does not hold yet; a repeated batch adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        try:
            new = new.join(spark.read.parquet(target).select(*key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(one)


def subscribed(events: DataFrame, subscriptions: DataFrame, kind: str = "kind") -> DataFrame:
    """Events with each subscriber that asked for their kind, or for all by ``*``; subscriptions: (subscriber, kind). A subscriber has an event once."""
    s = subscriptions.select("subscriber", F.col("kind").alias("_asked")).distinct()
    own = events.join(s, events[kind] == F.col("_asked")).drop("_asked")
    every = s.where("_asked = '*'").groupBy().agg(F.collect_set("subscriber").alias("_all"))
    rest = events.withColumn("subscriber", F.explode(F.coalesce(every.select("_all").scalar(), F.array().cast("array<string>"))))
    return own.unionByName(rest).distinct()


def deliver(stream: DataFrame, handlers: dict, kind: str = "kind"):
    """Starts a query that hands each batch of events to the handlers of their kind, and to those of ``*``."""

    def one(batch: DataFrame, number: int) -> None:
        for name, handler in handlers.items():
            handler(batch if name == "*" else batch.where(F.col(kind) == name), number)

    return stream.writeStream.foreachBatch(one)
