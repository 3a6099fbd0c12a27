"""Incremental ingestion on Structured Streaming, and the state tables beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwick.operators.records import latest, upsert


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], key: str, stamp: str, digest: str, checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch to a store: read gives its rows or None, write gets the whole new state and the batch's number, which makes a retry idempotent.

    Of several rows for a key in one batch the last by stamp counts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        stored = read()
        incoming = latest(batch, key, [stamp, digest])
        if stored is None:
            write(incoming, number)
            return
        changed = upsert(stored, incoming, key, stamp, digest).filter("outcome = 'changed'").drop("outcome")
        write(stored.join(changed.select(key), key, "left_anti").unionByName(changed), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_windows(spark: SparkSession, start: str, end: str, days: int = 120, overlap_minutes: int = 5) -> DataFrame:
    """start and end of consecutive windows of at most so many days, each beginning a little before the last one's end."""
    bounds = spark.range(1).select(F.to_timestamp(F.lit(start)).alias("s"), F.to_timestamp(F.lit(end)).alias("e"))
    starts = bounds.filter("s < e").select(F.explode(F.expr(f"sequence(s, e - interval 1 microsecond, interval {days} days)")).alias("w"), "s", "e")
    early = F.expr(f"w - interval {overlap_minutes} minutes")
    return starts.select(F.when(F.col("w") == F.col("s"), F.col("w")).otherwise(early).alias("start"), F.least(F.expr(f"w + interval {days} days"), F.col("e")).alias("end"))


def delta_latest(log: DataFrame, cursor_time: str | None, cursor_id: str | None) -> DataFrame:
    """The newest entry per id of a delta log (id, fetch_time, updated, url) behind a cursor."""
    after = log
    if cursor_time is not None:
        after = log.filter((F.col("fetch_time") > cursor_time) | ((F.col("fetch_time") == cursor_time) & (F.col("id") > (cursor_id or ""))))
    return after.groupBy("id").agg(F.max_by(F.struct("fetch_time", "updated", "url"), F.struct("fetch_time", "updated")).alias("x")).select("id", "x.*")


def record_failures(queue: DataFrame, failed: DataFrame, resolved: DataFrame) -> DataFrame:
    """The failure queue (id, attempts, error) after a round: resolved ids go, failed ones count one more."""
    both = queue.join(resolved.select("id"), "id", "left_anti").select("id", "attempts", "error", F.lit(0).alias("new"))
    both = both.unionByName(failed.select("id", F.lit(1).alias("attempts"), "error", F.lit(1).alias("new")))
    return both.groupBy("id").agg(F.sum("attempts").alias("attempts"), F.max_by("error", "new").alias("error"))


def event_windows(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts by event type in time windows with a watermark; an addition of this engine, for batch and stream alike."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def resumed(payloads: DataFrame, after: str | None) -> DataFrame:
    """Payloads (path, payload) behind the last path that a complete round has seen, in order of path."""
    return payloads if after is None else payloads.filter(F.col("path") > after)


def next_position(seen: DataFrame, failed: DataFrame, before: str | None) -> str | None:
    """Where the next round begins: the last path seen, or, if any failed, where this one began."""
    return before if failed.limit(1).count() else (seen.agg(F.max("path").alias("p")).first().p or before)


def log_stream(spark: SparkSession, path: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Lines (path, value) of a folder of logs that only grows, in batches of the files not yet read; ends when all are."""
    lines = spark.readStream.format("text").schema("value string").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned(history: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The history (artifact_id, content_sha256, content, seen_at) with the versions of artifacts that it lacks; no version ever goes."""
    fresh = artifacts.select(*history.columns).dropDuplicates(["artifact_id", "content_sha256"]).join(history.select("artifact_id", "content_sha256"), ["artifact_id", "content_sha256"], "left_anti")
    return history.unionByName(fresh)


def relinked(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Links (artifact_id, vuln_id) after artifacts (artifact_id, cve_ids) came in: theirs are replaced, others stay."""
    new = artifacts.select("artifact_id", F.explode(F.array_distinct(F.transform("cve_ids", F.upper))).alias("vuln_id"))
    return links.join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_anti").unionByName(new.distinct())


def collection_status(latest_rows: DataFrame, history: DataFrame, cursors: DataFrame, failures: DataFrame) -> DataFrame:
    """what, name and n: latest records by source, rows of history, cursors by source and stream, and failures still open."""
    sources = latest_rows.groupBy("source").agg(F.count("*").alias("n")).select(F.lit("source_records").alias("what"), F.col("source").alias("name"), "n")
    one = lambda df, what, name: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(name).alias("name"), "n")
    positions = cursors.groupBy("source", "stream").agg(F.count("*").alias("n")).select(F.lit("cursor").alias("what"), F.concat_ws(":", "source", "stream").alias("name"), "n")
    return sources.unionByName(one(history, "history_records", "all")).unionByName(positions).unionByName(one(failures, "unresolved_failures", "all"))
