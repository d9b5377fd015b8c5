"""Streaming queries over the stored tables: each works off what is there and gives its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_path
from millrace.sources.tables import table
from millrace.streaming import state


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, in the order of the files."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")  # one file or a folder of files
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _worked_off(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    with state.rocksdb(spark), state.no_idle_batches(spark):
        return state.run_to_table(stream, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-check"), mode)


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, at_ms): events of users that weren't let through in the two days before, over a stream."""
    seen = state.first_seen_again(event_stream(spark, d).select("user_id", "ts"), "user_id", "ts", 2 * 86_400)
    return _worked_off(spark, seen).select("user_id", F.unix_millis("ts").alias("at_ms"))


def stream_throttled(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, at_ms): alerts that pass a throttle of six hours a type, over a stream."""
    passed = state.throttled(event_stream(spark, d).select("event_type", "ts"), "event_type", "ts", 6 * 3600)
    return _worked_off(spark, passed).select("event_type", F.unix_millis("ts").alias("at_ms"))


def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """(slot_ms, event_type, n) of the hours that are over when the stream ends: a watermark of one hour closes them."""
    counts = state.tumbling_counts(event_stream(spark, d).select("event_type", "ts"), "ts", ["event_type"], "1 hour", "1 hour")
    done = state.run_to_table(counts, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-check"))
    return done.select(F.unix_millis("slot").alias("slot_ms"), "event_type", "n")


def stream_slot_queue(spark: SparkSession, d: str) -> DataFrame:
    """(slot, seq, op, payload): a queue of one payload an hour: purchases are put, clicks peek, errors take."""
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "take").otherwise("peek")
    commands = event_stream(spark, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("slot"), F.col("event_id").cast("long").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("payload"))
    return _worked_off(spark, state.slot_queue(commands))


def stream_failures(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, n): failures of each user, counted over a stream with a time to live by the clock."""
    failed = event_stream(spark, d).where("event_type = 'error'").select("user_id")
    return _worked_off(spark, state.failure_counts(failed, "user_id", mode="Append"))
