"""Tables with expiry in place of a key-value store: point lookups, upserts, tombstones, throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def latest(log: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last row of each key of an append-only log (last write wins): one aggregation with map-side combine."""
    rest = [c for c in log.columns if c not in key]
    top = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return top.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def live(log: DataFrame, key: list[str], version: list[str], now: Column, expires: str = "expires_ts", deleted: str | None = None) -> DataFrame:
    """Rows that a lookup at *now* finds: the last version of each key, unless expired or deleted."""
    rows = latest(log, key, version).where(F.col(expires).isNull() | (F.col(expires) > now))
    return rows.where(~F.coalesce(deleted, F.lit(False))) if deleted else rows


def put(rows: DataFrame, path: str, now: Column, seconds: int | None = None) -> None:
    """Append rows to the log under *path* as values written *now* that expire after *seconds*; nothing is rewritten."""
    _append(with_expiry(rows, now, seconds).withColumn("deleted", F.lit(False)), path, now)


def delete(keys: DataFrame, path: str, now: Column) -> None:
    """Append tombstones for the keys."""
    _append(with_expiry(keys, now, None).withColumn("deleted", F.lit(True)), path, now)


def _append(rows: DataFrame, path: str, now: Column) -> None:
    rows.withColumn("written_ts", now.cast("timestamp")).write.mode("append").parquet(path)


def with_expiry(rows: DataFrame, now: Column, seconds: int | None) -> DataFrame:
    """Rows with ``expires_ts``; no seconds, no expiry."""
    at = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + seconds * 1_000_000) if seconds is not None else F.lit(None).cast("timestamp")
    return rows.withColumn("expires_ts", at)


def throttled(events: DataFrame, kind: str, at: str, seconds: int) -> DataFrame:
    """Events that pass when each kind may pass once in *seconds*: an event passes if that long went by since the last
    one that did. The chain depends on order, so each kind's distinct times are sorted and streamed through one task, which
    keeps nothing of a kind but its last pass; the sort may spill, so a kind's size isn't bounded by memory."""
    schema = events.select(kind, F.col(at).cast("timestamp").alias(at)).schema
    t = F.unix_micros(F.col(at).cast("timestamp")).alias("_t")
    times = events.select(kind, t).where("_t is not null").distinct().repartition(kind).sortWithinPartitions(kind, "_t")
    gap = seconds * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            kept = []
            for i, (k, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is None or k != now or x - last >= gap:
                    now, last = k, x
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    passed = times.mapInArrow(fold, StructType([schema[kind], StructField("_t", LongType())]))
    return passed.select(kind, F.timestamp_micros("_t").alias(at))


def age_minutes(at: Column, now: Column) -> Column:
    """Whole minutes since *at*, halves rounded up."""
    return F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 60_000 + 0.5)


def first_success(attempts: DataFrame, row: str, order: list[str], ok: str = "ok") -> DataFrame:
    """Of each row's attempts, the first that succeeded."""
    return attempts.where(ok).withColumn("_n", F.row_number().over(W.partitionBy(row).orderBy(*order))).where("_n = 1").drop("_n")
